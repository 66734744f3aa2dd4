"""Best documents by a sum of term impacts, exactly, from stored postings: lists that cannot bring a document into the best are only looked up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.workdir import fresh

#: Documents of a block.
BLOCK = 1_024
#: Postings of a query's weightiest terms that set its first bar.
FIRST = 4_000
#: A query of so few postings is summed up at once.
FULL = 100_000
#: Rounding that a bar must bear.
EASE = 1e-7


@dataclass
class Postings:
    """terms (t, df, mx): each term's documents and largest impact. blocks (t, block, n, mx, docs array<doc, impact>): its documents by block, with the block's largest impact."""

    terms: DataFrame
    blocks: DataFrame
    n_blocks: int

    @property
    def block(self):
        return F.pmod(F.xxhash64("doc"), F.lit(self.n_blocks)).cast("int")


def build(impacts: DataFrame, n_docs: int) -> Postings:
    """Stores impacts (t, doc, impact), a row for each term of a document, impacts being positive.

    A block holds the documents of one hash range, some BLOCK of them, so no group grows with a term's documents.
    """
    spark, path = impacts.sparkSession, fresh(impacts.sparkSession, "postings")
    made = Postings(impacts, impacts, max(1, -(-n_docs // BLOCK)))
    rows = impacts.select("t", "doc", "impact").withColumn("block", made.block)
    blocks = rows.groupBy("t", "block").agg(F.count("*").cast("int").alias("n"), F.max("impact").alias("mx"), F.collect_list(F.struct("doc", "impact")).alias("docs"))
    blocks.write.parquet(f"{path}/blocks")
    made.blocks = spark.read.parquet(f"{path}/blocks")
    made.blocks.groupBy("t").agg(F.sum("n").alias("df"), F.max("mx").alias("mx")).write.parquet(f"{path}/terms")
    made.terms = spark.read.parquet(f"{path}/terms")
    return made


def _bar(partial: DataFrame, k: int) -> DataFrame:
    """(item, bar): the k-th best sum so far; what a document must reach. No row for an item of fewer documents."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s")))
    return partial.withColumn("place", place).where(F.col("place") == k).select("item", F.col("s").alias("bar"))


def _opened(p: Postings, asked: DataFrame, on: list[str]) -> DataFrame:
    """(item, doc, impact) of the blocks of asked terms (item, t, ...)."""
    return p.blocks.join(asked, on).select("item", F.explode("docs").alias("d")).select("item", "d.doc", "d.impact")


def best(p: Postings, queries: DataFrame, k: int, digits: int = 8, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """((item, doc, s, rank), (item, postings)): the k best documents of each query (item, t) by the sum of its terms' impacts, and how many postings were read for it.

    A query of ``full`` postings or fewer is summed up at once. Of others

    1. the terms of largest impact, up to FIRST postings or the first alone, give sums; the k-th is a bar that the best reach;
    2. a query's terms of small impact, as many as together stay below the bar, cannot bring a document
       there alone. Only the lists of the others are opened; of their documents those stay that would
       reach the bar with all the small terms, of which the blocks they are in say what each can add;
    3. for these the small terms are looked up, in the blocks that hold such a document only.

    Sums that are equal in ``digits`` digits are ranked by document. Repeated terms of a query count once.
    """
    q = queries.select("item", "t").distinct().join(p.terms, "t").select("item", "t", "df", "mx")
    q = q.withColumn("of", F.sum("df").over(Window.partitionBy("item")))
    few, many = q.where(F.col("of") <= full), q.where(F.col("of") > full)
    total = _opened(p, few.select("item", "t"), ["t"]).groupBy("item", "doc").agg(F.sum("impact").alias("s"))
    read = few.groupBy("item").agg(F.first("of").alias("postings"))
    if not many.isEmpty():
        some, opened = _bounded(p, many, k)
        total, read = total.unionByName(some), read.unionByName(opened)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.round("s", digits).desc(), "doc"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k), read


def _bounded(p: Postings, q: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((item, doc, s) of the documents that may be among the best, (item, postings)) by the three steps."""
    spark = q.sparkSession
    path = fresh(spark, "search")
    order = Window.partitionBy("item").orderBy(F.desc("mx"), "df", "t")
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("item").orderBy("mx", F.desc("df"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumns({"before": F.coalesce(F.sum("df").over(up), F.lit(0)), "below": F.sum("mx").over(down)})  # below: what it and all smaller terms can bring
    q.write.parquet(f"{path}/terms")
    q = spark.read.parquet(f"{path}/terms")
    opening = (F.col("before") + F.col("df") <= FIRST) | (F.col("before") == 0)
    _opened(p, q.where(opening).select("item", "t"), ["t"]).groupBy("item", "doc").agg(F.sum("impact").alias("s")).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    _bar(first, k).write.parquet(f"{path}/bar")
    q = q.join(spark.read.parquet(f"{path}/bar"), "item", "left").withColumn("small", ~opening & F.coalesce(F.col("below") < F.col("bar") - EASE, F.lit(False)))
    large, small = q.where(~opening & ~F.col("small")), q.where("small")
    reach = q.groupBy("item").agg(F.max("bar").alias("bar"), F.coalesce(F.max(F.when(F.col("small"), F.col("below"))), F.lit(0.0)).alias("rest"))
    sums = first.union(_opened(p, large.select("item", "t"), ["t"])).groupBy("item", "doc").agg(F.sum("s").alias("s")).join(reach, "item")
    sums.where(F.col("bar").isNull() | (F.col("s") + F.col("rest") >= F.col("bar") - EASE)).select("item", "doc", "s").withColumn("block", p.block).write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    # a better bar, and what the small terms can add in each block
    wanted = sums.select("item", "block").distinct().join(small.select("item", "t"), "item")
    add = wanted.join(p.blocks.select("t", "block", "mx"), ["t", "block"]).groupBy("item", "block").agg(F.sum("mx").alias("rest"))
    near = sums.join(_bar(sums, k), "item", "left").join(add, ["item", "block"], "left")
    near.where(F.col("bar").isNull() | (F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("bar") - EASE)).select("item", "doc", "block", "s").write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    asked = near.select("item", "block").distinct().join(small.select("item", "t"), "item")
    more = _opened(p, asked, ["t", "block"]).join(near.select("item", "doc"), ["item", "doc"], "left_semi")
    total = near.select("item", "doc", "s").union(more).groupBy("item", "doc").agg(F.sum("s").alias("s"))
    looked = asked.join(p.blocks.select("t", "block", "n"), ["t", "block"]).select("item", F.col("n").cast("long").alias("n"))
    read = q.where(opening).select("item", F.col("df").alias("n")).union(large.select("item", F.col("df").alias("n"))).union(looked)
    return total, read.groupBy("item").agg(F.sum("n").alias("postings"))
