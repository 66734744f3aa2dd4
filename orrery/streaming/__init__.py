"""What runs over streams: session risk, and the index that follows micro-batches of files."""

from orrery.engine import current_index, index_stream
from orrery.operators.sessions import session_risk_stream, session_windows

__all__ = ["current_index", "index_stream", "session_risk_stream", "session_windows"]
