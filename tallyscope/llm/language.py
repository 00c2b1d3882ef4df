"""Language identification in two levels: the language family first, then the language within it.

Features are the shares of letter n-grams (one to three code points, hashed) of the whole text. One
linear support vector machine a family against the rest picks the family; within it one machine for
each pair of languages votes. Machines minimise squared hinge loss in numpy, on a sample of at most
``per_language`` texts of each language (a parameter), fitted at the driver from features that Spark
makes. Margins become probabilities by a logistic curve fitted on the same sample; the score is that
of the family times the least of the language's own pair probabilities, which does not shrink with the
number of languages in the family.

Families are given (``FAMILIES``); a language that is not in the table is a family of its own.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
there is nothing to learn from; with one language learned, every text with a letter is that language
with score 1. Equal votes go to the language first in code-point order. Repeated rows are classified
alike; an empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.letters import Letters, chunks, smallest_by_hash

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 13
PER_LANGUAGE = 300
MOST_LANGUAGES = 200
#: A document whose language is less likely than this is rejected.
LEAST = 0.5
#: Families of language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn ur pa mr gu ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "tai": "th lo",
    "austroasiatic": "vi km",
    "bantu": "sw zu xh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], language)


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram that starts at each code point."""
    padded = np.concatenate((points, np.zeros(order, np.uint32)))
    value = np.full(len(points), order, np.uint32)
    for i in range(order):
        value = (value ^ padded[i : i + len(points)]) * np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(13)
    return (value * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _shares(text: str) -> np.ndarray:
    """Each n-gram's share of its order in one text."""
    letters = Letters([text])
    points = letters.points
    inside = ~letters.zero
    out = np.zeros(1 << BITS, np.float64)
    for order in ORDERS:
        out += np.bincount(_buckets(points, order)[inside], minlength=1 << BITS)
    return out / max(1, np.count_nonzero(inside))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 60):
    """Weights and bias of a linear support vector machine, by accelerated gradient steps.

    ``y`` is 1 or -1, ``weight`` sums to 1. The step is the inverse of a bound on the curvature.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)
    v = np.random.default_rng(1).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = np.linalg.norm(v)
        v /= size
    step = 1.0 / (2.2 * size + penalty)
    w = z = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        gradient = penalty * z - 2 * (x.T @ (weight * y * slack))
        w, last = z - step * gradient, w
        z = w + k / (k + 3) * (w - last)
    return w[:-1], w[-1]


def _slope(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logistic slope that fits the margins, between 1 and 8."""
    slopes = np.linspace(1, 8, 29)
    losses = [weight @ np.logaddexp(0, -s * y * margins) for s in slopes]
    return float(slopes[int(np.argmin(losses))])


@dataclass
class Languages:
    """Learned weights: a column for each family, then one for each pair within a family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    slopes: np.ndarray

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = Letters(texts)
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        probability = self._probabilities(letters)
        chosen = self._family(probability)
        found = np.empty(len(texts), object)
        score = np.zeros(len(texts))
        for place, langs in enumerate(self.families.values()):
            own = np.flatnonzero(chosen == place)
            votes = np.zeros((len(own), len(langs)))
            least = np.ones((len(own), len(langs)))
            for column, (a, b) in enumerate(self.pairs, len(self.families)):
                if a in langs:
                    first = probability[own, column]
                    for lang, p in ((a, first), (b, 1 - first)):
                        i = langs.index(lang)
                        votes[:, i] += p
                        least[:, i] = np.minimum(least[:, i], p)
            best = votes.argmax(axis=1)
            found[own] = np.array(langs, object)[best]
            score[own] = probability[own, place] * least[np.arange(len(own)), best]
        found[~letters.has_letter] = UNKNOWN
        score[~letters.has_letter] = 0
        return found.tolist(), np.clip(score, 0, 1)

    def _family(self, probability: np.ndarray) -> np.ndarray:
        return probability[:, : len(self.families)].argmax(axis=1)

    def _probabilities(self, letters: Letters) -> np.ndarray:
        margins = np.zeros((len(letters.firsts), self.weights.shape[1]))
        if len(letters.firsts):
            for order in ORDERS:
                found = self.weights[_buckets(letters.points, order)]
                found[letters.zero] = 0
                margins += np.add.reduceat(found, letters.firsts, axis=0, dtype=np.float64)
            margins /= (letters.stops - letters.firsts)[:, None]
        out = 1 / (1 + np.exp(-np.clip((margins + self.bias) * self.slopes, -500, 500)))
        families = len(self.families)
        sums = out[:, :families].sum(axis=1, keepdims=True)
        out[:, :families] = np.where(sums > 0, out[:, :families] / np.where(sums > 0, sums, 1), 1 / families)
        return out


def fit(languages: list[str], shares: np.ndarray) -> Languages:
    """Trains on rows of n-gram shares."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(languages)):
        families.setdefault(family_of(lang), []).append(lang)
    pairs = [pair for langs in families.values() for pair in combinations(langs, 2)]
    scale = 1 / np.sqrt(shares.mean(axis=0) + 1e-5) if len(shares) else np.ones(1 << BITS)
    x = (shares * scale).astype(np.float32)
    own = np.array(languages)
    weights, bias, slopes = [], [], []

    def add(rows: np.ndarray, positive: np.ndarray) -> None:
        if positive.all():
            weights.append(np.zeros(x.shape[1]))
            bias.append(1.0)
            slopes.append(1.0)
            return
        y = np.where(positive, 1.0, -1.0)
        weight = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
        w, b = _machine(x[rows], y, weight)
        weights.append(w * scale)
        bias.append(b)
        slopes.append(_slope(x[rows] @ w + b, y, weight))

    everything = np.arange(len(own))
    for langs in families.values():
        add(everything, np.isin(own, langs))
    for a, b in pairs:
        rows = np.flatnonzero((own == a) | (own == b))
        add(rows, own[rows] == a)
    columns = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((1 << BITS, 0), np.float32)
    return Languages(families, pairs, columns, np.array(bias), np.array(slopes))


def train(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES
) -> Languages:
    """Learns from text and lang of ``labelled`` (doc_id only picks the sample).

    More than ``most_languages`` languages are an error: none is left out silently. The sample of all
    languages comes to the driver, ``per_language`` texts each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_shares(text) for text in batch["text"]]
            places = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pd.DataFrame(
                {
                    "lang": batch["lang"],
                    "places": places,
                    "shares": [r[p].astype(np.float32) for r, p in zip(rows, places, strict=True)],
                }
            )

    sample = smallest_by_hash(
        labelled.select("doc_id", "text", "lang").where("text RLIKE '\\\\p{L}'"), "lang", per_language, most_languages
    )
    rows = sample.select("lang", "text").mapInPandas(
        run, "lang string, places array<int>, shares array<float>"
    ).toPandas()
    rows = rows.sort_values("lang", kind="stable")
    shares = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (places, values) in enumerate(zip(rows["places"], rows["shares"], strict=True)):
        shares[i, places] = values
    return fit(rows["lang"].tolist(), shares)


def identified(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            languages, score = model.classify(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": languages, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def accepted(docs: DataFrame, model: Languages, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of ``least`` or more."""

    @F.pandas_udf("boolean")
    def speaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for part in chunks([pd.DataFrame({"text": batch})]):
                languages, score = model.classify(part["text"].tolist())
                out.append((np.array(languages) != UNKNOWN) & (score >= least))
            yield pd.Series(np.concatenate([*out, np.empty(0, bool)]))

    return docs.where(speaks("text"))
