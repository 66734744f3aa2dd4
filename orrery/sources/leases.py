"""Leases on folders of intermediate tables: a run keeps its own alive, a sweeper takes away those of dead runs."""

from __future__ import annotations

import atexit
import contextlib
import threading
import time
import uuid

from pyspark.sql import SparkSession

from orrery.sources.files import Store

#: Seconds that a folder outlives the last sign of its run.
SECONDS = 3_600
PREFIX = "run-"


class Lease:
    """A folder of one run below ``root``. Its file ``lease-<seconds>`` is written anew every third of that time, by a thread, until ``release``."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = SECONDS):
        self.store, self.seconds = Store(spark, root), seconds
        self.path = f"{self.store.root}/{PREFIX}{uuid.uuid4().hex}"
        self._over = threading.Event()
        self.renew()
        threading.Thread(target=self._keep, daemon=True).start()

    def renew(self) -> None:
        self.store.write(f"{self.path}/lease-{self.seconds:g}", "")

    def _keep(self) -> None:
        while not self._over.wait(self.seconds / 3):
            with contextlib.suppress(Exception):  # the store may be away for a while, or the JVM gone
                self.renew()

    def release(self) -> None:
        """Ends the run: its folder goes."""
        self._over.set()
        self.store.delete(self.path)


def sweep(spark: SparkSession, root: str, now: float | None = None) -> list[str]:
    """Takes away the folders below ``root`` whose lease is over, and names them. A folder without a lease file counts from its own last change."""
    store, now, gone = Store(spark, root), time.time() if now is None else now, []
    for name, changed in store.list(root):
        if not name.startswith(PREFIX):
            continue
        held = [(n, t) for n, t in store.list(f"{root}/{name}") if n.startswith("lease-")]
        last, seconds = max(((t, float(n[6:])) for n, t in held), default=(changed, SECONDS))
        if now - last > seconds:
            store.delete(f"{root}/{name}")
            gone.append(name)
    return gone


_held: dict[tuple[str, str], Lease] = {}


def of_run(spark: SparkSession, root: str) -> Lease:
    """The lease of this application below ``root``, made when first asked for. Then dead runs' folders are swept; its own goes when Python ends."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _held:
        with contextlib.suppress(Exception):  # another sweeper may come first
            sweep(spark, root)
        _held[key] = lease = Lease(spark, root)
        atexit.register(_end, lease)
    return _held[key]


def _end(lease: Lease) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone: then a sweeper does it
        lease.release()
