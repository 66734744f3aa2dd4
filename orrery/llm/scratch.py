"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back: one pass over the input, and a lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orrery.sources.workdir import fresh

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, the session's Arrow batches bounded: Spark's own 10,000 texts make some 20 MB in the executor and as much in each worker. A setting that someone made stays."""
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, rows)
    return df


class Scratch:
    """Tables of one operator run: ``save`` writes and rereads, ``drop`` removes what is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = fresh(spark, name)
        self._n = 0

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a saved table. Nothing that is still to run may read it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def aside(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not hold, in whatever case."""
    held = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in held:
        name += "_"
    return name


def others(cols: list[str], new: tuple[str, ...]) -> list[str]:
    """The columns without those that share a name with a new one, in whatever case: Spark could not tell them apart."""
    return [c for c in cols if c.lower() not in new]


def extended(df: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """The schema of ``keep`` columns with the fields of ``ddl`` behind them."""
    return T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])
