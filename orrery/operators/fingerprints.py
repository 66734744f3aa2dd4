"""Fingerprints (arrays of 32-bit words): the tracks that a print is near to, and its likest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.operators.axis_search import _Best
from orrery.operators.clustered import _ranked
from orrery.sources.workdir import fresh

#: From this similarity on fewer bits differ than there are words, so a word agrees.
WORD = 1 - 1 / 32


def near(prints: DataFrame, tracks: DataFrame, least: float = 0.97) -> DataFrame:
    """(qid, row_id, score) of all pairs of prints (qid, fp) and tracks (row_id, fp) of similarity ``least`` or more.

    At such a similarity 32 (1 - least) n bits at most differ over the n words that both have, fewer than n: some word
    is the same at its place. So words are posted by (place, word), both sides joined on that and
    confirmed; pairs that share several words count once. Both sides may be of any number. Empty and null prints are
    near to nothing.
    """
    if least <= WORD:
        raise ValueError(f"a similarity above {WORD} is needed; use best for lower ones")
    post = lambda df, key: df.where(F.size("fp") > 0).select(key, F.posexplode("fp").alias("place", "word"))
    pairs = post(prints, "qid").join(post(tracks, "row_id"), ["place", "word"]).select("qid", "row_id").distinct()
    both = pairs.join(prints.select("qid", "fp"), "qid").join(tracks.select("row_id", F.col("fp").alias("other")), "row_id")
    return both.select("qid", "row_id", S.fingerprint_similarity(F.col("fp"), F.col("other")).alias("score")).where(F.col("score") >= least)


def best(ids: np.ndarray, prints: list[np.ndarray], tracks: DataFrame, k: int, digits: int = 6, own: bool = True) -> DataFrame:
    """(qid, rank, row_id, score): each print's k likest tracks (row_id, fp), by similarity in ``digits`` digits, then id.

    The prints go to every task, which counts the differing bits of whole batches and keeps k tracks a
    print. Without ``own`` a track of the print's id is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(ids), k)
        for b in batches:
            fp, rows = b.column("fp"), b.column("row_id").to_numpy()
            off = np.concatenate([[0], np.cumsum(fp.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            words = fp.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32)
            for n in np.unique(np.diff(off)) if len(rows) else ():
                some = np.flatnonzero(np.diff(off) == n)
                block = words[off[some][:, None] + np.arange(n)]
                for at, q in enumerate(prints):
                    m = min(int(n), len(q))
                    score = np.zeros(len(some)) if not m else np.floor((1 - np.bitwise_count(block[:, :m] ^ q[None, :m]).sum(1, dtype=np.int64) / (32.0 * m)) * 10**digits + 0.5) / 10**digits
                    if not own:
                        score[rows[some] == ids[at]] = -np.inf
                    top.add(np.array([at]), score[:, None], rows[some], lambda r, c, score=score: (score[r], np.zeros((len(r), 0))))
        top.cut()
        q, place = np.nonzero(np.isfinite(top.score))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(top.row[q, place]), pa.array(top.score[q, place])], ["qid", "row_id", "score"])

    path = fresh(tracks.sparkSession, "prints")
    tracks.select(F.col("row_id").cast("long").alias("row_id"), F.col("fp").cast("array<long>").alias("fp")).mapInArrow(run, "qid long, row_id long, score double").write.parquet(path)
    return _ranked(tracks.sparkSession.read.parquet(path), k).select("qid", "rank", "row_id", "score")
