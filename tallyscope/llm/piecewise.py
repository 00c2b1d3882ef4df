"""Context-triggered piecewise hashing of texts, and its comparison by edit distance.

A rolling hash over seven bytes ends a piece wherever it is -1 modulo the block size, so that an
edit moves no boundary away from it; each piece gives one character. A fingerprint holds the
signatures at its block size and at twice that: ``block:signature:signature``. The block size is a
power of two, the smallest that fits the text into 64 pieces, halved while under 32 pieces come out;
the 64th character stands for the whole rest, so no byte is left out.

Fingerprints are compared where their block sizes meet: likeness is 1 - edit distance / longer
length, the best over the shared sizes, and 0 when no size is shared.

Defined cases: a null or empty text has the fingerprint ``1::``; equal texts have equal
fingerprints; documents are ordered by id (of any type that Spark orders, by that order), nulls last, rows with the same id by a hash of the text;
the document after the last is the first, in a table of one row itself. An empty table gives an empty
result. Other columns are not read. A task holds arrays of about 40 bytes per byte of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyscope.llm.common import written
from tallyscope.llm.hashing import Stretches

WINDOW = 7
SMALLEST = 1
LONGEST = 64
_LETTERS = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8
)
#: Range count: one for so many rows, but no more than MOST_RANGES (their heads are broadcast).
RANGE_ROWS = 1024
MOST_RANGES = 10_000


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    if not data:
        return f"{SMALLEST}::"
    stretches = Stretches(data)
    rolled = stretches.windows(WINDOW) >> np.uint64(32)

    def cuts(block: int) -> np.ndarray:
        return np.flatnonzero(rolled % np.uint64(block) == np.uint64(block - 1)) + WINDOW

    block = SMALLEST
    while block * LONGEST < len(data):
        block *= 2
    found = cuts(block)
    while block > SMALLEST and len(found) < LONGEST // 2:
        block //= 2
        found = cuts(block)

    def signature(ends: np.ndarray) -> str:
        ends = ends[: LONGEST - 1]
        if not len(ends) or ends[-1] < len(data):
            ends = np.append(ends, len(data))
        starts = np.concatenate(([0], ends[:-1]))
        return _LETTERS[stretches.of(starts, ends) & np.uint64(63)].tobytes().decode()

    return f"{block}:{signature(found)}:{signature(cuts(2 * block))}"


def likeness(left: str, right: str) -> Column:
    """0 to 1, from two fingerprint columns."""
    a, b = F.split(left, ":"), F.split(right, ":")
    size_a, size_b = a[0].cast("bigint"), b[0].cast("bigint")

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when(F.col(left) == F.col(right), 1.0)
        .when(size_a == size_b, F.greatest(alike(a[1], b[1]), alike(a[2], b[2])))
        .when(size_a == 2 * size_b, alike(a[1], b[2]))
        .when(2 * size_a == size_b, alike(a[2], b[1]))
        .otherwise(0.0)
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t) for t in batch["text"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], marks], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _numbered(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """doc_id, text, range (null for null ids) where a cast to double keeps the order of the ids."""
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    inner = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        inner = ids.select(F.percentile_approx("id", shares, max(10_000, 20 * ranges))).first()[0] or []
    bounds = [float("-inf"), *sorted(set(inner or [0.0])), float("inf")]
    bucket = Bucketizer(splits=bounds, inputCol="__id", outputCol="__range", handleInvalid="keep")
    ranged = bucket.transform(
        docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("__id"))
    )
    return ranged.select("doc_id", "text", F.col("__range").cast("int").alias("range")), len(bounds)


def _looked_up(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """The same for ids of any other type, from a written table of the ids in their own order."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    placed = ids.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id())
    placed = written(placed, "id-ranges")
    return docs.select("doc_id", "text").join(placed, "doc_id", "left"), ranges


def _in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, ahead: each range of ids ends with the head of the next one, ``ahead``.

    The ranges come from the ids alone. Only ids of heads reach the driver, at most MOST_RANGES of them.
    """
    ranges = max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS))
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    ranged, last = (_numbered if numeric else _looked_up)(docs, ranges)
    ranged = ranged.withColumn("range", F.coalesce("range", F.lit(last)))  # nulls after all others
    heads = sorted(ranged.groupBy("range").agg(F.min("doc_id")).collect(), key=lambda head: head[0])
    before = [(head[1], heads[i - 1][0]) for i, head in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    lead = docs.sparkSession.createDataFrame(before, f"head {kind}, earlier int")
    here = F.struct(F.col("range"), F.lit(False).alias("ahead"))
    earlier = F.struct(F.col("earlier").alias("range"), F.lit(True).alias("ahead"))
    places = F.when(F.col("earlier").isNull(), F.array(here)).otherwise(F.array(here, earlier))
    return (
        ranged.join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("head")), "left")
        .select("doc_id", "text", F.explode(places).alias("place"))
        .select("doc_id", "text", "place.range", "place.ahead")
    )


def edited(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the document after it.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint. The edited
    text ends with the first ``n_chars // 4`` code points of the next document instead of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # ids beside nulls stay exact
        held = None
        for batch in batches:
            out = []
            columns = (batch[name].to_pylist() for name in ("doc_id", "text", "range", "ahead"))
            for doc_id, text, place, ahead in zip(*columns, strict=True):
                text = text or ""
                mark = fingerprint(text)
                if held and held[3] == place:
                    own_id, own, own_mark, _ = held
                    tail = len(own) // 4
                    changed = own[: len(own) - tail] + text[:tail]
                    out.append(
                        (
                            own_id,
                            len(own),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            own_mark,
                            fingerprint(changed),
                            mark,
                        )
                    )
                held = None if ahead else (doc_id, text, mark, place)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 4]
            made = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, next_fingerprint string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return (
        _in_ranges(docs)
        .repartition("range")
        .sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        .mapInArrow(run, schema)
    )
