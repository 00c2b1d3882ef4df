"""Defined results for nulls, empty and very long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import (
    language,
    mixing,
    neighbours,
    ngrams,
    packing,
    piecewise,
    simhash,
    template,
    toxicity,
    warc,
)
from tallyscope.llm.common import shared_folder
from tallyscope.llm.queries import vocabulary

LONG = "the quick brown fox jumps over the lazy dog and runs " * 8000
ROWS = [
    (1, "The cat sat on the mat and it was happy there", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, LONG, "en", "b"),
    (5, "12345 !!! ???", "de", "b"),
    (6, "Der Hund und die Katze sind nicht im Haus", "de", None),
    (7, "same text twice here", "en", "c"),
    (7, "same text twice here", "en", "c"),
    (None, "a row without an id", "en", "c"),
    (9, "\x00 zero \x1f bytes \U0001f600 and marks", "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that the operators use themselves.
CLASHING = ("size", "target", "copies", "finish", "fingerprint", "root", "range", "score", "kind", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    extra = {name: F.lit("x") for name in CLASHING}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_language(docs, nothing):
    model = language.train(docs.where("doc_id IN (1, 6, 9)"))
    rows = language.identified(docs, model).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert found[2] == found[3] == found[5] == ("und", 0.0)
    assert found[1][0] == found[4][0] == "en" and found[6][0] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identified(nothing, model).count() == 0
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {2, 3, 5}.isdisjoint(r["doc_id"] for r in kept.collect())
    unlearned = language.train(nothing)
    assert {r["lang_pred"] for r in language.identified(docs, unlearned).collect()} == {"und"}
    alone = language.train(docs.where("doc_id = 1"))
    assert {r["lang_pred"] for r in language.identified(docs, alone).collect()} == {"und", "en"}


def test_no_language_is_left_out_silently(docs):
    with pytest.raises(ValueError, match="more than 1 values"):
        language.train(docs, most_languages=1)


def test_warc(spark, docs, nothing):
    same = "<p>" + "x" * 200
    pages = spark.createDataFrame(
        [
            (4, "http://a/4", same),
            (2, "http://a/2\n x", same),
            (2, None, same),
            (None, "http://a/n", same),
            (7, "http://a/7", None),
            (8, "http://a/8", ""),
            (9, "http://a/9", "é" * 50),
            (10, "http://a/10", "é" * 50),
            (11, "http://a/11", "short"),
            (12, "http://a/12", "short"),
            (13, "http://a/13", "\r\n\r\nWARC/1.1 " * 400_000),
        ],
        "page_id bigint, url string, html string",
    ).withColumns({n: F.lit("x") for n in ("digest", "copy", "first", "record_type", "who")})
    folder = f"{shared_folder(spark)}/warc-cases"
    index = warc.write_archives(pages, folder, frame_bytes=300)
    rows = warc.read_records(index).collect()
    assert len(rows) == 11
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows if r["page_id"] in (None, 2, 4))
    assert kinds == [(0, "revisit", 2), (2, "response", None), (2, "revisit", 2), (4, "revisit", 2)]
    by_id = {r["page_id"]: r for r in rows}
    assert (by_id[10]["record_type"], by_id[10]["refers_to"], by_id[10]["payload_bytes"]) == ("revisit", 9, 100)
    assert {by_id[i]["record_type"] for i in (7, 8, 9, 11, 12, 13)} == {"response"}
    assert by_id[7]["payload_bytes"] == 0 and by_id[13]["payload"].startswith(b"\r\n\r\nWARC")
    some = warc.read_records(index.where("page_id = 11")).collect()
    assert [r["payload"] for r in some] == [b"short"]
    assert warc.read_records(warc.write_archives(pages.limit(0), folder)).count() == 0


def test_ngrams(docs, nothing):
    model = ngrams.train(docs.where("doc_id <> 6"))
    rows = ngrams.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r["score"] <= 0 and r["base_score"] <= 0 for r in rows)
    found = {r["doc_id"]: r for r in rows}
    assert found[2]["n_tokens"] == found[3]["n_tokens"] == found[2]["n_known"] == 1
    assert found[4]["n_tokens"] == 8000 * 11 + 1
    assert ngrams.scored(nothing, model).count() == 0
    empty = ngrams.scored(docs, ngrams.train(nothing)).collect()
    assert {(r["score"], r["base_score"], r["n_known"]) for r in empty} == {(0.0, 0.0, 0)}


def test_mixing(docs, nothing):
    rows = mixing.plan(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan(nothing).count() == mixing.mixed(nothing).count() == 0
    assert mixing.plan(docs.where("doc_id IN (2, 3)")).select("taken").distinct().collect()[0][0] == 0


def test_packing(docs, nothing):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, path, with_ids=True).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == {r["doc_tokens"] for r in rows if r["doc_id"] == 4}.pop()
    assert len([r for r in rows if r["doc_id"] == 7 and r["start"] == 0]) == 2
    assert packing.pack(nothing, path).count() == 0


def test_piecewise(docs, nothing):
    rows = piecewise.edited(docs).withColumn("near", piecewise.likeness("fingerprint", "edited_fingerprint")).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["near"] <= 1 for r in rows)
    marks = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert marks[2] == marks[3] == piecewise.fingerprint(None)
    assert piecewise.edited(nothing).count() == 0
    alone = piecewise.edited(docs.where("doc_id = 1")).collect()
    assert alone[0]["next_fingerprint"] == alone[0]["fingerprint"]


def test_neighbours(spark):
    rows = [
        (20, [1.0, 0.0, 0.0]),
        (1, [2.0, 0.0, 0.0]),
        (2, [2.0, 0.0, 0.0]),
        (3, None),
        (4, [0.0, 0.0, 0.0]),
        (5, [1.0, None, 0.0]),
        (6, [float("nan"), 0.0, 1.0]),
        (7, [float("inf"), 0.0, 1.0]),
        (8, [1.0]),
        (None, [1.0, 1.0, 1.0]),
        (20, [1.0, 0.0, 0.0]),
        (40, [0.0, -1.0, 0.5]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns(
        {n: F.lit(0) for n in ("query_id", "rank", "score", "block", "slice")}
    )
    asking = F.col("vec_id") % 20 == 0
    found = neighbours.nearest(frame, asking, k=20).collect()
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 20)
    assert mine == [(1, 1, 2.0), (2, 2, 2.0), (3, 40, 0.0)]
    assert sorted(r["rank"] for r in found if r["query_id"] == 40) == [1, 2, 3, 4]
    assert neighbours.nearest(frame.limit(0), asking).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 20"), asking).count() == 0


def test_neighbours_of_each_length(spark):
    """Vectors meet those of their own length; none drops out, an id with two lengths is one query."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3 + i % 3)]) for i in range(1, 91)] + [(20, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=5).collect()
    for i, asked in rows[:-1]:
        others = [(-sum(a * b for a, b in zip(asked, x)), n) for n, x in rows if n != i and len(x) == len(asked)]
        mine = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == i)
        wanted = [n for _, n in sorted(others)[:5]] if i % 20 == 0 else []
        assert [n for _, n in mine] == wanted and [n for n, _ in mine] == list(range(1, len(wanted) + 1))


def test_template(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "http://h/1", ""), (3, "no url", "<article>a &amp; b<br>c</article>"), (4, "http://h/2", "plain < text"), (4, "http://h/2", "plain < text"), (None, "http://h/3", "<p>x" * 50_000)],
        "page_id bigint, url string, html string",
    ).withColumns({n: F.lit("x") for n in ("host", "slots", "links", "path", "text")})
    rows = template.extracted(pages).collect()
    assert len(rows) == 6
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[1] == texts[2] == "" and texts[3] == "a & b c"
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert template.extracted(pages.limit(0)).count() == 0


def test_toxicity(spark, docs, nothing):
    good = [(i, f"a calm text number {i} about gardens and rain", "en", "a") for i in range(100, 160)]
    bad = [(i, f"you idiot number {i} with gardens", "en", "a") for i in range(200, 230)]
    train = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame(
        [(i, 1) for i in range(200, 225)] + [(i, 0) for i in range(100, 130)] + [(None, 1), (100, None), (999, 1)],
        "doc_id bigint, toxic int",
    )
    model = toxicity.train(train, labels, prior=0.3)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 5)}) == 1
    own = {r["doc_id"]: r["score"] for r in toxicity.scored(train, model).collect()}
    assert min(own[i] for i in range(200, 230)) > 0.5 > max(own[i] for i in range(100, 160))
    kept = toxicity.accepted(train, model)
    assert kept.columns == train.columns and kept.count() == 60
    assert toxicity.scored(nothing, model).count() == 0
    none = toxicity.train(train, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


@pytest.mark.parametrize(("toxic", "slurs", "unlabelled"), [(1200, 120, 8000), (60, 10, 800)])
def test_toxicity_of_rare_words(spark, toxic, slurs, unlabelled):
    """Toxic words in a few texts each, of 12,000 texts; a held-out toxic text carries one of them."""
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad_words = ["zz" + "".join(draw.choices(letters, k=6)) for _ in range(slurs)]
    plain = ["".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(3000)]
    ranks = [1 / (i + 3) for i in range(len(plain))]

    def texts(first, n, *more):
        words = draw.choices(plain, ranks, k=40 * n)
        return [(first + i, " ".join([*words[40 * i : 40 * i + 40], *(m[i % len(m)] for m in more)])) for i in range(n)]

    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame(texts(0, toxic, bad_words) + texts(toxic, 12_000 - toxic), schema)
    labels = spark.createDataFrame([(i, 1) for i in range(toxic)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, prior=toxic / 12_000, unlabelled=unlabelled)
    held = spark.createDataFrame(texts(20_000, 600, bad_words) + texts(30_000, 1000), schema)
    found = [r["doc_id"] for r in toxicity.scored(held, model).collect() if r["score"] >= toxicity.THRESHOLD]
    assert sum(i < 30_000 for i in found) >= 0.9 * 600
    assert sum(i >= 30_000 for i in found) <= 0.02 * 1000


def test_toxicity_where_most_texts_are_toxic(spark):
    draw = random.Random(6)
    plain = ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    rows = [(i, " ".join([*draw.choices(plain, k=30), *(["zzawful"] if i % 5 else [])])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(2000)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if r["score"] >= toxicity.THRESHOLD}
    assert len(found) >= 0.95 * 1600 and all(i % 5 for i in found)
    with pytest.raises(ValueError, match="prior"):
        toxicity.train(docs, labels, prior=0.0)


def test_simhash(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows}
    assert found[2]["fingerprint"] == found[3]["fingerprint"] == 0
    assert found[2]["component_id"] == found[3]["component_id"] == 2
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 9]
    assert simhash.near_duplicates(nothing).count() == simhash.one_of_each(nothing).count() == 0
