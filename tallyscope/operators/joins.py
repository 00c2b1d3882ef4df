"""A left join for the one place where the right side may repeat a key without bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may join.
ROWS_PER_SLICE = 1_000_000
#: Keys that are sliced. Any other has at most a 10,000th of all rows, or ROWS_PER_SLICE.
MOST_SLICED = 10_000
_SLICE, _COUNT = "__slice", "__slice_count"


def fan_out_left_join(
    one: DataFrame, many: DataFrame, key: str, spread_by: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``one LEFT JOIN many`` with hot keys of ``many`` spread over as many join keys as their rows need.

    Counts per key (combined before their shuffle) show the keys with more than ``rows_per_slice`` rows;
    the largest MOST_SLICED of them are broadcast with their number of slices, and rows of ``many`` are
    sliced by a hash of ``spread_by``. Every other key stays whole. A row of ``one`` is repeated only for
    slices that have rows, so that every repeated row finds a match and no row is lost or added, also
    where ``spread_by`` repeats or is NULL. A NULL key joins nothing.
    """
    hot = (
        many.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > rows_per_slice)
        .orderBy(F.desc("__rows"), key)
        .limit(MOST_SLICED)
        .select(key, F.ceil(F.col("__rows") / rows_per_slice).alias(_COUNT))
    )
    dealt = F.pmod(F.xxhash64(spread_by), F.col(_COUNT)).cast("int")
    sliced = many.join(F.broadcast(hot), key, "left").withColumn(_SLICE, F.coalesce(dealt, F.lit(0)))
    present = sliced.where(F.col(_COUNT).isNotNull()).groupBy(key).agg(F.collect_set(_SLICE).alias("__slices"))
    repeated = (
        one.join(present, key, "left")
        .withColumn(_SLICE, F.explode(F.coalesce("__slices", F.array(F.lit(0)))))
        .drop("__slices")
    )
    return repeated.join(sliced.drop(_COUNT), [key, _SLICE], "left").drop(_SLICE)
