"""Texts as arrays of lower-case letters, for features over many texts at once."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 20
#: Separates texts, and is no letter.
GAP = "\0\0\0"


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: letter, and letter or mark."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in runs of about CHUNK_CHARS of text."""
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).cumsum().to_numpy() // CHUNK_CHARS
        for _, part in batch.groupby(sizes):
            yield part


class Letters:
    """Lower-case letters and marks of texts; everything else is one blank a run.

    ``points`` holds the code points, ``firsts`` and ``stops`` each text's place. After each text
    come three zeros, so that no run of up to four code points that starts in a text reaches the next.
    """

    def __init__(self, texts: list[str | None]):
        letter, kept = _kinds()
        joined = GAP.join([*(f" {text or ''} ".lower() for text in texts), ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        zero = points == 0
        if np.count_nonzero(zero) != len(GAP) * len(texts):  # a text holds zeros of its own
            cleaned = [(text or "").replace("\0", " ") for text in texts]
            joined = GAP.join([*(f" {text} ".lower() for text in cleaned), ""])
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            zero = points == 0
        word = kept[points]
        blank = ~word & ~zero
        keep = ~(blank & np.concatenate(([False], blank[:-1])))
        self.points = np.where(blank, np.uint32(32), points)[keep]
        self.word = word[keep]
        self.zero = zero[keep]
        ends = np.flatnonzero(self.zero)[:: len(GAP)]
        self.stops = ends
        self.firsts = np.concatenate(([0], ends[:-1] + len(GAP))) if len(ends) else ends
        counts = np.concatenate(([0], np.cumsum(letter[self.points])))
        self.has_letter = counts[self.stops] > counts[self.firsts]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and each word's text."""
        before = np.concatenate(([False], self.word[:-1]))
        starts = np.flatnonzero(self.word & ~before)
        ends = np.flatnonzero(~self.word & before)
        return starts, ends, np.searchsorted(self.stops, starts)


def smallest_by_hash(rows: DataFrame, group: str, most: int, groups: int = 200) -> DataFrame:
    """Up to ``most`` rows a group, those with the smallest hashes of doc_id: a sample that reruns share.

    ``rows`` has doc_id, text and ``group``, null groups left out; more than ``groups`` groups
    are an error. A threshold from the groups' sizes thins the rows before anything is sorted,
    so that the shuffle carries a few times the sample whatever the input.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(group).isNotNull())
    sizes = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(groups + 1).collect()
    if len(sizes) > groups:
        raise ValueError(f"{group} has more than {groups} values; allow more, or leave some out")
    if not sizes:
        return rows.limit(0)
    kind = rows.schema[group].dataType.simpleString()
    limits = spark.createDataFrame(
        [(r[0], float(min(1.0, 2.0 * most / r[1] + 20.0 / r[1]))) for r in sizes],
        f"sample_group {kind}, sample_share double",
    )
    place = F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    unit = (F.shiftrightunsigned(place, 11) / float(1 << 53)).alias("sample_at")
    thinned = (
        rows.select("*", unit)
        .join(F.broadcast(limits), F.col(group) == F.col("sample_group"))
        .where(F.col("sample_at") < F.col("sample_share"))
    )
    order = W.partitionBy(group).orderBy("sample_at", F.xxhash64("text"))
    return (
        thinned.withColumn("sample_rank", F.row_number().over(order))
        .where(F.col("sample_rank") <= most)
        .select(*rows.columns)
    )
