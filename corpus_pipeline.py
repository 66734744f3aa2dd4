"""The documents' way to training text: five stages, each written and read again.

Every stage takes texts of any length whole, works on all rows that its predecessor kept, and carries
columns that it does not use, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, near_dup, quality, queries, secrets, spm
from orrery.llm.scratch import Scratch


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score below one half go.

    Null text counts as empty, and scores as such; equal texts score alike; an empty table stays empty.
    """
    ranker = quality.fit(docs, queries.table(spark, sf_dir, "labels"), ~queries.held_out())
    return quality.score(docs, ranker).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 with five-word shingles: of each group the document of the smallest id stays.

    A row without an id stays; of rows that share a kept id one stays, that of the smallest text.
    """
    found = near_dup.near_duplicates(docs, k=5, similarity=0.8)
    drop = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = Scratch(spark, "again").save(again)
    once = docs.join(drop, "doc_id", "left_anti").join(again, "doc_id", "left_anti")
    if again.isEmpty():
        return once.select(*docs.columns)
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    several = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("r")).select([F.col(f"r.{c}").alias(c) for c in docs.columns])
    return once.select(*docs.columns).unionByName(several)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go. Null and empty texts hold none; an empty benchmark leaves all."""
    return decontam.scan(docs, queries.table(spark, sf_dir, "benchmark")).where("size(hits) = 0").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every secret, encoded ones too, becomes [SECRET]; n_chars follows. Null text stays null; overlapping secrets become one mark."""
    found = secrets.scan(docs, redact=True)
    changed = F.size("base_spans") + F.size("added_spans") > 0
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the texts' token ids, for every row; null and empty texts have none."""
    return spm.encode(docs, queries.model_bytes(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", reject_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("sentencepiece encoding", encode_pieces),
]

#: No SQL has MinHash groups, a fitted ranker or merges of pieces; tests/llm holds the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = scratch.save(stage(spark, docs, sf_dir))
        if n:
            scratch.drop(docs)
        docs = out
    return docs
