"""Where intermediate and indexed tables go: below the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.sources import leases
from orrery.sources.files import Store

_own = ""


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in this run's folder below ``spark.checkpoint.dir``; without that setting, in a local folder, which only a local master may use.

    The folder is leased: it goes when Python ends, or by another run's sweep once its lease is over.
    """
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own = "file://" + tempfile.mkdtemp(prefix="orrery-")
            atexit.register(shutil.rmtree, _own.removeprefix("file://"), True)
        found = _own
    return f"{leases.of_run(spark, found.rstrip('/')).path}/{name}-{uuid.uuid4().hex}"


_stored: dict[tuple, object] = {}


def once(spark: SparkSession, df: DataFrame, name: str, make):
    """What ``make()`` gives, made once in this application for a version of the data that ``df`` reads: its files, their sizes and times."""
    files = sorted(df.inputFiles())
    folders = sorted({f.rpartition("/")[0] for f in files})
    version = tuple((f, n, t) for f in folders for n, t in Store(spark, f).list(f))
    key = (spark.sparkContext.applicationId, name, version)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]
