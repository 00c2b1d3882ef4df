"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model over the words of a text: each different word of letters, and the
first four, five and six letters of longer words, hashed. It learns from confirmed toxic texts
(label 1) and from unlabelled texts, never from label 0, with the non-negative risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

where the bracket is the part of the unlabelled risk that non-toxic texts cause; where a step takes
it below zero, it is pushed back up. The class prior is a parameter, by default the share of label 1
among the labelled training rows (a number only).

Both samples are bounded (``positives``, ``unlabelled``; parameters); the rarer toxicity is, the more
unlabelled texts are drawn, so that EXPECTED_TOXIC of them are toxic. Spark counts in how many of the
sampled texts each feature occurs. A feature is kept by evidence, however rare: it is in LEAST_TEXTS
toxic texts, and the hypothesis that it is not over-represented among them (see ``evident``) is
rejected with at most FALSE_KEPT of the kept ones expected to be there by chance. The model is fitted
in numpy at the driver on the sample's rows over them. Every text is then scored whole.

Defined cases: a null or empty text has no features and gets the score of the bias; without a toxic
training text every score is 0; rows that repeat are scored alike; labels that are null, or whose
document is missing, are left out; several labels of one document count as toxic if any is 1. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import written
from tallyscope.llm.hashing import Stretches
from tallyscope.llm.letters import Letters, chunks, smallest_by_hash

BITS = 22
PREFIXES = (4, 5, 6)
POSITIVES, UNLABELLED = 4000, 8000
#: So many of the unlabelled texts are toxic, by the prior, if there are enough texts.
EXPECTED_TOXIC = 400
#: A smaller prior draws no more unlabelled texts than this one, so that the sample stays bounded.
LEAST_PRIOR = 0.001
#: A feature is tested that is in so many toxic texts; of those kept, this share may be there by chance.
LEAST_TEXTS, FALSE_KEPT = 5, 0.05
#: Pull of each weight towards zero, as a part of what one toxic text weighs.
PULL = 0.5
THRESHOLD = 0.5


def features(letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and prefix, repeats included."""
    starts, ends, texts = letters.words()
    stretches = Stretches(letters.points)
    shift = np.uint64(64 - BITS)
    owners, found = [texts], [stretches.of(starts, ends) >> shift]
    for size in PREFIXES:
        longer = ends - starts > size
        first = starts[longer]
        owners.append(texts[longer])
        found.append((stretches.of(first, first + size) * np.uint64(2 * size + 1)) >> shift)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def _different(owners: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owners.astype(np.int64) << BITS | found)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weights of the kept features, in the order of the features, and the bias."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place among the kept features), each pair once."""
        owners, found = features(Letters(texts))
        here = _member(self.kept)[found]
        owners, found = _different(owners[here], found[here])
        return owners, np.searchsorted(self.kept, found)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        owners, places = self.rows(texts)
        sums = np.bincount(owners, self.weights[places], len(texts)) + self.bias
        return 1 / (1 + np.exp(-sums))


_members: dict[bytes, np.ndarray] = {}


def _member(kept: np.ndarray) -> np.ndarray:
    """A table over all features that tells the kept ones; one for each worker and model."""
    key = kept.tobytes()
    if key not in _members:
        _members.clear()
        table = np.zeros(1 << BITS, bool)
        table[kept] = True
        _members[key] = table
    return _members[key]


def evident(toxic: np.ndarray, others: np.ndarray, p: int, u: int, prior: float) -> np.ndarray:
    """Which features are over-represented in ``p`` toxic texts against ``u`` unlabelled ones.

    A feature of toxic texts only is 1 / prior times as frequent in them. Tested is that the ratio is
    no more than the fourth root of that, by the signed root of the likelihood ratio (its limit is the
    lower confidence limit of the ratio, good for small and zero counts); Benjamini and Hochberg's
    rule bounds the expected share of chance finds over all tests.
    """
    odds = prior**-0.25 * p / u
    null = odds / (1 + odds)
    n = np.maximum(toxic + others, 1)
    ratio = toxic * np.log(np.maximum(toxic, 1) / (n * null))
    ratio = ratio + others * np.log(np.maximum(others, 1) / (n * (1 - null)))
    root = np.where(toxic > n * null, np.sqrt(2 * np.maximum(ratio, 0)), 0.0)
    chance = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in root])
    ordered = np.sort(chance)
    below = np.flatnonzero(ordered <= FALSE_KEPT * np.arange(1, len(ordered) + 1) / max(len(ordered), 1))
    return chance <= (ordered[below[-1]] if len(below) else -1.0)


def fit(
    owners: np.ndarray,
    places: np.ndarray,
    positive: np.ndarray,
    size: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    pull: float = PULL,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over sparse rows (Adam steps)."""
    share = np.where(positive, 1.0 / max(positive.sum(), 1), 1.0 / max((~positive).sum(), 1))
    penalty = pull * prior / max(positive.sum(), 1)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = np.bincount(owners, w[places], len(positive)) + w[-1]
        up = 1 / (1 + np.exp(-g))  # slope of loss(-g)
        down = up - 1  # slope of loss(g)
        # the risk of non-toxic texts, from unlabelled ones without the share of toxic ones
        loss = np.logaddexp(0, g)
        clean = share[~positive] @ loss[~positive] - prior * (share[positive] @ loss[positive])
        slope_clean = share * up * np.where(positive, -prior, 1.0)
        slope = share * prior * np.where(positive, down, 0.0) + slope_clean if clean >= 0 else -slope_clean
        gradient = np.append(np.bincount(places, slope[owners], size), slope.sum())
        gradient[:-1] += penalty * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model:
    """Learns from the texts of ``docs`` and from those labels whose doc_id is among them."""
    ids = docs.select("doc_id")
    marked = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(ids, "doc_id", "left_semi")
    )
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1)).alias("ones")).first()
    nothing = Model(np.empty(0, np.int64), np.empty(0), 0.0)
    if not totals["ones"]:
        return nothing
    if prior is None:  # just under 1 where all labels are 1
        prior = totals["ones"] / max(totals["n"], totals["ones"] + 1)
    if not 0 < prior < 1:
        raise ValueError("the class prior lies between 0 and 1")

    texts = docs.select("doc_id", "text")
    # the sample is drawn from ids, at most ``positives`` of them, so that texts need no shuffle
    drawn = (
        marked.where("toxic = 1")
        .select("doc_id")
        .orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id")
        .limit(positives)
    )
    confirmed = texts.join(F.broadcast(drawn), "doc_id", "left_semi").withColumn("kind", F.lit(1))
    place = F.xxhash64(F.lit("unlabelled"), F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))
    share = max(unlabelled, math.ceil(EXPECTED_TOXIC / max(prior, LEAST_PRIOR))) / max(texts.count(), 1)
    some = texts.where(F.shiftrightunsigned(place, 11) / float(1 << 53) < share).withColumn("kind", F.lit(0))
    sample = written(
        smallest_by_hash(confirmed, "kind", positives).union(some), "toxicity-sample"
    ).select("kind", "text").dropDuplicates()  # copies would make their words look toxic

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            owners, found = _different(*features(Letters(part["text"].tolist())))
            toxic = part["kind"].to_numpy()[owners] == 1
            for kind in (True, False):
                names, counts = np.unique(found[toxic == kind], return_counts=True)
                yield pd.DataFrame(
                    {"feature": names, "toxic": counts * kind, "others": counts * (not kind)}
                )

    sizes = dict(sample.groupBy("kind").count().collect())
    p, u = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not u:
        return nothing
    counts = (
        sample.mapInPandas(occurrences, "feature bigint, toxic bigint, others bigint")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
        .where(F.col("toxic") >= LEAST_TEXTS)
        .toPandas()  # so many features at most as the toxic sample has, divided by LEAST_TEXTS
    )
    found = evident(counts["toxic"].to_numpy(), counts["others"].to_numpy(), p, u, prior)
    kept = np.sort(counts["feature"].to_numpy()[found].astype(np.int64))
    model = Model(kept, np.empty(0), 0.0)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            owners, places = model.rows(part["text"].tolist())
            stops = np.searchsorted(owners, np.arange(1, len(part)))
            yield pd.DataFrame({"kind": part["kind"].to_numpy(), "places": np.split(places, stops)})

    rows = sample.mapInPandas(reduced, "kind int, places array<bigint>").toPandas()
    places = np.concatenate([*rows["places"], np.empty(0, np.int64)]).astype(np.int64)
    owners = np.repeat(np.arange(len(rows)), [len(x) for x in rows["places"]])
    weights, bias = fit(owners, places, rows["kind"].to_numpy() == 1, len(kept), prior)
    return Model(kept, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": model.score(part["text"].tolist())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [
                model.score(part["text"].tolist()) < threshold
                for part in chunks([pd.DataFrame({"text": batch})])
            ]
            yield pd.Series(np.concatenate([*out, np.empty(0, bool)]))

    return docs.where(clean("text"))
