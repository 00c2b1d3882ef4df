"""Search through the index against search over all texts."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from checkset import registry
from tallyscope.operators.explore import SEARCHED, account_search
from tallyscope.operators.search_index import indexed_search, search_index, written_index

TERMS = ["Renewal", " renewal ", "e", "en", "zz", "FinTech", "éa", "a.b%_", "xyz'", "", "  ", "Customer#0000", "aaa", "ab ab"]


def texts(spark, rows):
    schema = "account_id string, " + ", ".join(f"{name} string" for name in SEARCHED)
    return spark.createDataFrame([(i, *row, *[None] * (len(SEARCHED) - len(row))) for i, row in rows], schema)


def test_same_rows_as_a_search_over_all_texts(spark):
    frame = texts(
        spark,
        [
            ("1", ["Early renewal", "e"]),
            ("2", ["", None]),
            ("3", ["ren", "ewal"]),  # all stretches but one, over two fields
            ("4", ["renew wal new ene ewa"]),  # all stretches, not the term
            ("5", ["ÉA", "a.b%_", "it's xyz'"]),
            (None, ["RENEWAL"]),
            ("1", ["no match here"]),
            ("6", ["aa", "aaaa", "ab", "ab ab ab"]),
        ],
    )
    index = search_index(frame)
    assert index.count() == index.distinct().count()
    for term in TERMS:
        wanted = sorted(map(str, account_search(frame, term).collect()))
        assert sorted(map(str, indexed_search(frame, index, term).collect())) == wanted, term
    assert indexed_search(frame.limit(0), search_index(frame.limit(0)), "ren").count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_a_search_reads_matching_files_only(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    labels = registry.portfolio(spark, SMALL).labels.select("account_id", *SEARCHED)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # would put so little data in one file
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        index = written_index(labels)
    finally:
        spark.conf.set(coalesce, before)
    files = index.select("gram", F.input_file_name().alias("file")).distinct()
    everything = files.select("file").distinct().count()
    of_one = {r.gram: r["count"] for r in files.groupBy("gram").count().collect()}
    assert everything > 2 and sorted(of_one.values())[len(of_one) // 2] == 1
    found = indexed_search(labels, index, "renewal")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in text
    assert sorted(map(str, found.collect())) == sorted(map(str, account_search(labels, "renewal").collect()))
