"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by a hash of their id. A document's virtual finish time is the
number of its source's tokens up to and including it, divided by the source's target; the second
copy of a document finishes one whole source later. Over all sources, copies are taken in the order
of finish times until the total budget is used up. As every source reaches its target at time 1,
the sources stay in proportion at every point of the mixed stream.

Running sums are made in two steps, so that no task sees a whole source: the hash order is cut into
ranges of about ``range_rows`` rows, the ranges' totals give their offsets, and rows add up within
their range. The place of the cut is found likewise: totals of narrow slots of finish time, then the
rows of the one slot in which the budget ends.

Defined cases: a null text has size 0; a document of size 0 is never taken; a null source is a
source of its own and comes last; a null id hashes as the empty text; rows that repeat an id are
documents of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.common import WORD, written

RANGE_ROWS = 8192


def _size():
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key (null apart from every text), size, and the shuffle key."""
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("source_key"),
        _size().alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/mix"))).alias(
            "shuffle_key"
        ),
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most: int
) -> DataFrame:
    """One row a source: its size, row count and target in words.

    Sources in code-point order, null last, weigh ``weights`` in turn and split ``share`` times all
    words; a target stops at ``most`` times its source and what is over goes to the others by weight.
    The sources with the smallest size for their weight stop first, so one pass in that order finds
    them. The windows are over sources, not over documents.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    tight_first = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    budget = F.col("total") * F.lit(share)
    return (
        sizes.groupBy("source_key", "source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1),
        )
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("most", F.col("source_size") * most)
        .withColumn(
            "stopped_before",
            F.coalesce(F.sum("most").over(tight_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("weight_left", F.sum("weight").over(tight_first.rowsBetween(0, W.unboundedFollowing)))
        .withColumn(
            "stops",
            (budget - F.col("stopped_before")) * F.col("weight") >= F.col("most") * F.col("weight_left"),
        )
        .withColumn("left", budget - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(everything))
        .withColumn("open", F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0)).over(everything))
        .select(
            "source_key",
            "source_size",
            "source_rows",
            F.when(F.col("stops"), F.col("most").cast("double"))
            .otherwise(F.col("weight") * (F.col("left") / F.nullif("open", F.lit(0))))
            .alias("target"),
        )
    )


def _running(sizes: DataFrame, targets: DataFrame, range_rows: int) -> DataFrame:
    """Adds ``reached``: words of the source up to and with this row, in shuffled order."""
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    ranges = F.ceil(F.col("source_rows") / range_rows)
    ranged = sizes.join(targets, "source_key").withColumn(
        "range", F.shiftright(place * ranges, 32)
    )
    up_to = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("source_key", "range")
        .agg(F.sum("size").alias("range_size"))
        .select(
            "source_key", "range", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before")
        )
    )
    within = (
        W.partitionBy("source_key", "range")
        .orderBy("shuffle_key", "size")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        ranged.join(offsets, ["source_key", "range"])
        .withColumn("reached", F.col("before") + F.sum("size").over(within))
        .drop("range", "before", "source_rows")
    )


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """One row a possible copy of a non-empty document, with its virtual finish time."""
    return (
        rows.where(F.col("size") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn(
            "finish", (F.col("reached") + F.col("copy") * F.col("source_size")) / F.col("target")
        )
    )


def _last_taken(copies: DataFrame, budget: float, slots: int):
    """The finish time and keys of the last copy within the budget, as one small row."""
    order = ["finish", "source_key", "shuffle_key", "size", "copy"]
    slotted = copies.withColumn("slot", F.floor(F.col("finish") * slots))
    totals = slotted.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    running = totals.withColumn(
        "until", F.sum("slot_size").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    )
    over = running.where(F.col("until") > budget).orderBy("slot").first()
    if over is None:
        return copies.select(F.max(F.struct(*order)).alias("last")).first()["last"]
    so_far = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = (
        slotted.where(F.col("slot") == over["slot"])
        .withColumn("until", F.lit(over["until"] - over["slot_size"]) + F.sum("size").over(so_far))
        .where(F.col("until") <= budget)
        .select(F.max(F.struct(*order)).alias("last"))
        .first()["last"]
    )
    if last is not None:
        return last
    return (
        slotted.where(F.col("slot") < over["slot"])
        .select(F.max(F.struct(*order)).alias("last"))
        .first()["last"]
    )


def plan(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies and first finish time.

    ``taken`` is ``copies`` times ``size``. The total taken is at most ``share`` times all words and
    short of it by less than one document.
    """
    sizes = written(sized(docs), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    rows = written(_running(sizes, targets, range_rows), "mix-order")
    totals = targets.agg(F.sum("source_size").alias("words"), F.sum("source_rows").alias("rows")).first()
    words, count = totals["words"] or 0, totals["rows"] or 0
    last = _last_taken(_copies(rows, most), words * share, max(1, count // range_rows))

    def takes(copy: int):
        if last is None:
            return F.lit(0)
        finish = (F.col("reached") + copy * F.col("source_size")) / F.col("target")
        mine = (finish, F.col("source_key"), F.col("shuffle_key"), F.col("size"), F.lit(copy))
        limit = (last["finish"], last["source_key"], last["shuffle_key"], last["size"], last["copy"])
        inside = F.lit(True)
        for column, value in reversed(list(zip(mine, limit, strict=True))):
            inside = (column < F.lit(value)) | ((column == F.lit(value)) & inside)
        return F.when((F.col("size") > 0) & inside, 1).otherwise(0)

    copies = sum((takes(copy) for copy in range(1, most)), takes(0))
    return rows.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "shuffle_key",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).cast("bigint").alias("taken"),
        F.when(F.col("copies") > 0, F.col("reached") / F.col("target")).alias("finish"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mixed stream: the rows of ``docs``, each as often as taken, sorted by finish time.

    A row finds its own place by its id and size; rows that share both are the same length, so that
    any assignment among them keeps the mix. The sort is a range-partitioned one.
    """
    columns = docs.columns
    places = plan(docs, **settings).where(F.col("copies") > 0)
    keys = ["__mix_id", "__mix_size", "__mix_source"]

    def keyed(rows: DataFrame, size, tie) -> DataFrame:
        numbered = W.partitionBy(*keys).orderBy("__mix_tie")
        return rows.withColumns(
            {
                "__mix_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                "__mix_size": size,
                "__mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
                "__mix_tie": tie,
            }
        ).withColumn("__mix_n", F.row_number().over(numbered))

    places = keyed(places, F.col("size"), F.col("finish")).select(
        *keys,
        "__mix_n",
        F.col("finish").alias("__mix_first"),
        F.col("copies").alias("__mix_copies"),
        (F.col("source_size") / F.col("target")).alias("__mix_lap"),
    )
    return (
        keyed(docs, _size(), F.xxhash64("text"))
        .join(places, [*keys, "__mix_n"])
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)))
        .withColumn("__mix_at", F.col("__mix_first") + F.col("__mix_copy") * F.col("__mix_lap"))
        .orderBy("__mix_at", "__mix_source", "__mix_id")
        .select(*columns)
    )
