"""Search through an index of three-letter stretches, instead of reading every account's texts.

The index has a row per stretch and account, with the stretches of all searched fields in lower case;
a field's last two letters begin shorter ones, so that terms of one or two letters are found by their
beginning. Written in the order of stretches, each lies in a few files, and a search reads those alone
(the filter reaches the Parquet scan). A stretch that every account has is split over files by account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.explore import SEARCHED, account_search
from tallyscope.sources.readers import write_between_stages

LETTERS = 3


def search_index(intelligence: DataFrame) -> DataFrame:
    """gram and account_id, each pair once, in ranges of gram."""
    texts = intelligence.select(
        "account_id", F.explode(F.array(*[F.lower(name) for name in SEARCHED])).alias("text")
    ).where(F.length("text") > 0)
    starts = F.sequence(F.lit(1), F.length("text"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(LETTERS))))
    pairs = texts.select(F.explode(grams).alias("gram"), "account_id").distinct()
    return pairs.repartitionByRange("gram", "account_id").sortWithinPartitions("gram", "account_id")


def written_index(intelligence: DataFrame) -> DataFrame:
    """The index as a table in the shared checkpoint folder."""
    return write_between_stages(search_index(intelligence), "search-index")


def candidates(index: DataFrame, term: str) -> DataFrame:
    """account_id of the accounts that have all stretches of the term; the term itself may be missing."""
    wanted = term.strip().lower()
    if len(wanted) < LETTERS:
        return index.where(F.col("gram").startswith(wanted)).select("account_id").distinct()
    grams = {wanted[i : i + LETTERS] for i in range(len(wanted) - LETTERS + 1)}
    return (
        index.where(F.col("gram").isin(*sorted(grams)))
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("met"))
        .where(F.col("met") == len(grams))
        .select("account_id")
    )


def indexed_search(intelligence: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """The rows of ``account_search``: candidates from the index, checked against their own texts."""
    if not term.strip():
        return intelligence
    found = candidates(index, term).withColumnRenamed("account_id", "found_id")
    near = intelligence.join(found, F.col("account_id").eqNullSafe(F.col("found_id")), "left_semi")
    return account_search(near, term)
