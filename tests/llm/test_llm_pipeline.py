"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from test_llm_exact import SMALL, WORD, brute_fingerprint, needs_tables

import corpus_pipeline
from tallyscope.llm import language, mixing, toxicity
from tallyscope.llm.common import read, remainder, written

pytestmark = needs_tables
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = [
    (-1, "1234 5678 !!", "en", "src1", 12),
    (-2, None, "en", None, 0),
    (-3, "", None, "src1", 0),
    (-4, "the of and to in that is was for it with as on be at by this", "en", None, 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    own = read(spark, SMALL, "documents")
    return own.unionByName(spark.createDataFrame(EXTRA, own.schema))


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_are_those_asked_for():
    assert list(STAGES) == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"


def test_language_keeps_every_text_with_letters(spark, docs):
    kept = STAGES["language"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    lost = {r["doc_id"] for r in rows(docs)} - {r["doc_id"] for r in rows(kept)}
    assert {-1, -2, -3} <= lost and len(lost) <= 5 and -4 not in lost


FIVE = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from they which",
    "de": "der die und das nicht ist ein ich mit sich auf des dem eine auch wird sind noch nach durch werden",
    "nl": "het een van en dat niet zijn op te met voor er maar om hem dan zou wat mijn deze haar naar ook",
    "sv": "och att det som en inte jag har till med var sig han om men hade på för är ett vid från skulle",
    "da": "og jeg af ikke til han hun der den efter blev meget noget hvad hvor kunne sagde selv mig os ud",
}


def test_language_keeps_a_family_of_five(spark):
    """The score of a clear text does not depend on how many languages its family has."""
    draw = random.Random(3)
    texts = [
        (i, " ".join(draw.choices(words.split(), k=60)), lang)
        for i, (lang, words) in enumerate(pair for pair in FIVE.items() for _ in range(60))
    ]
    # a second family, so that the family has a probability under 1
    texts += [(1000 + i, " ".join(draw.choices("le les des une est pour que dans qui sur pas avec".split(), k=60)), "fr") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    kept = STAGES["language"](spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect())
    model = language.train(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identified(docs, model).collect()}
    assert found == {i: lang for i, _, lang in texts}


def test_toxicity_drops_what_scores_high(spark, docs):
    model = toxicity.train(docs.where(remainder("doc_id", 5) != 0), read(spark, SMALL, "labels"))
    high = {r["doc_id"] for r in rows(toxicity.scored(docs, model)) if r["score"] >= 0.5}
    kept = STAGES["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == sorted(
        r["doc_id"] for r in rows(docs) if r["doc_id"] not in high
    )


def test_one_document_of_each_group_stays(spark, docs):
    twice = docs.union(docs.where("doc_id IN (3, 4)"))
    kept = rows(STAGES["near_duplicates"](spark, twice, SMALL))
    marks = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows(docs)}
    groups: list[set] = []
    for doc_id, mark in marks.items():
        near = [g for g in groups if any((marks[o] ^ mark).bit_count() <= 3 for o in g)]
        groups = [g for g in groups if g not in near] + [set().union({doc_id}, *near)]
    assert sorted(r["doc_id"] for r in kept) == sorted(min(g) for g in groups)
    texts = {r["doc_id"]: r for r in rows(docs)}
    assert all(r == texts[r["doc_id"]] for r in kept)


def test_mixing_takes_what_the_plan_says(spark, docs):
    plan = {r["doc_id"]: r for r in rows(mixing.plan(docs))}
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows(docs):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    budget, weights = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:  # the excess goes to the others by weight until none is above twice its size
        left = budget - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        total = sum(weights[s] for s in open_)
        targets = {s: 2 * sizes[s] if s in capped else left * weights[s] / total for s in names}
        above = {s for s in open_ if targets[s] > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    out = rows(STAGES["mixing"](spark, docs, SMALL))
    copies = Counter(r["doc_id"] for r in out)
    for r in rows(docs):
        p = plan[r["doc_id"]]
        assert p["target"] == pytest.approx(targets[r["source"]]) and p["source_size"] == sizes[r["source"]]
        assert copies[r["doc_id"]] == p["copies"] <= 2
        taken[r["source"]] += p["taken"]
    longest = max(p["size"] for p in plan.values())
    assert all(abs(taken[s] - targets[s]) <= longest for s in names)


def test_run_is_the_stages_in_turn(spark):
    docs = read(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
    copies = Counter(r["doc_id"] for r in rows(docs))
    result = rows(corpus_pipeline.run(spark, SMALL))
    firsts = Counter(r["doc_id"] for r in result if r["start"] == 0)
    assert firsts == copies
    lengths = defaultdict(int)
    for r in result:
        lengths[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in result}
    assert all(lengths[i] == n * tokens[i] for i, n in copies.items())
