"""Time windows, interval joins, conversations, sessions (families C, E, H, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.windows import sliding
from orrery.plans.registry import query, relational, table

_DURATION = "(conv_id % 97 + 3)"


@query(
    "ok1_media_windows",
    f"SELECT DISTINCT conv_id, i::DOUBLE AS start, least(i + 30, {_DURATION})::DOUBLE AS stop FROM conversations, range(0, 105, 15) t(i) WHERE i < {_DURATION} OR i = 0",
)
def media_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 s every 15 s from the media's start, at least one, the last end clipped."""
    media = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 97 + 3).cast("double").alias("duration")).distinct()
    return sliding(media, "conv_id", "duration", 30, 15)


relational("oe11_last_turns", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) WHERE rn <= 4")
relational("oe15_running_offset", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM {conversations}")


relational("ext_window_events", "SELECT window.start AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
relational("ext_cube", "SELECT source, lang, count(*) AS n FROM {documents} GROUP BY CUBE (source, lang)")
relational("ext_rollup", "SELECT source, lang, sum(n_chars) AS n FROM {documents} GROUP BY ROLLUP (source, lang)", "SELECT source, lang, sum(n_chars)::BIGINT AS n FROM documents GROUP BY ROLLUP (source, lang)")
