"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. A
document of n terms has the normaliser ``m = 100 - 50 + (50 * n * N) div L`` (N documents with terms, L
terms in all); its score for an item is the sum over the item's different terms of
``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``.

Index: one pass over the documents counts their terms and keeps, of the terms that the items ask for, the
occurrences in each document. Documents are then laid out by m (a stratum is the documents of one m; a
large one goes on over several files) in a written table, in which no document is left out.

Search: a task reads its strata in turn, at most BUFFER_POSTINGS occurrences at a time, and holds each
stratum's postings by term and tf, so that an impact is computed once for each tf. The largest tf of each
term bounds an item's score in a stratum. Strata are visited in the order of their bounds, and no longer
once a bound is under the item's 50th score so far. A first share of the documents is searched in full;
its 50th scores are where the search of the others starts, so a task returns few rows beyond the result.

Items come in blocks of about BLOCK_CHARS characters; only the terms and items of one block are sent to
the tasks. All scores are 64-bit integers.

Defined cases: a null or empty text (of a document or item) has no terms; repeated documents are ranked
each, documents without an id after those with one of the same score; repeated items are ranked each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.batches import parts
from tallyscope.llm.common import written

BEST = 50
BLOCK_CHARS = 1 << 23
BUFFER_POSTINGS, BUFFER_CELLS = 1 << 22, 1 << 23
#: One of FIRST_SHARE documents is searched first.
FIRST_SHARE = 16


def _characters() -> bytes:
    """By byte: ASCII letters in lower case, digits, bytes of longer characters; all others a space."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


_KEPT = _characters()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


@dataclass
class Query:
    """The items of a block: their ids, and each one's terms as numbers."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]

    @classmethod
    def of(cls, items: list[tuple]) -> Query:
        numbers: dict[bytes, int] = {}
        terms = [
            np.array(sorted({numbers.setdefault(term, len(numbers)) for term in terms_of(text)}), np.int64)
            for _, text in items
        ]
        return cls([item_id for item_id, _ in items], terms, numbers)


def occurrences(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, and the numbered terms of each document (terms, ascending) with their counts (tfs)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = [terms_of(text) for text in part.column("text").to_pylist()]
            sizes = np.array([len(own) for own in texts], np.int64)
            of = np.repeat(np.arange(len(texts)), sizes)
            number = np.fromiter(
                (numbers.get(term, -1) for own in texts for term in own), np.int64, int(sizes.sum())
            )
            known = number >= 0
            key, counts = np.unique(of[known] << 32 | number[known], return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(texts) + 1) << 32).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                for flat in (key & 0xFFFFFFFF, counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), *lists], ["doc_id", "n", "terms", "tfs"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>"
    )


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 20 * m)


class Best:
    """The best documents of each item met so far, and the score from which another one counts."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.held: dict[int, list[tuple]] = defaultdict(list)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        """Documents of ``docs`` (places in ``ids``) above the floor; ties go to the smaller id, nulls last."""
        if len(scores) > self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            scores, docs = scores[good], docs[good]
        held = self.held[item]
        for score, doc in zip(scores.tolist(), docs.tolist(), strict=True):
            held.append((-score, ids[doc] is None, ids[doc]))
        held.sort()
        del held[self.k :]
        if len(held) == self.k:
            self.floors[item] = max(self.floors[item], -held[-1][0])


class Strata:
    """Documents with their postings by (stratum, term, tf)."""

    def __init__(self, m: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray, vocabulary: int):
        self.m, stratum = np.unique(m, return_inverse=True)
        self.vocabulary = vocabulary
        of = np.repeat(np.arange(len(m)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        where = stratum[of] * vocabulary + term
        order = np.lexsort((tf, where))
        self.docs, where, tf = of[order], where[order], tf[order]
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | (tf[1:] != tf[:-1])
        first = np.flatnonzero(new)
        # an impact for each tf of a term in a stratum
        impact = impacts(tf[first], self.m[where[first] // vocabulary])
        self.impact = np.repeat(impact, np.diff(np.append(first, len(where))))
        self.places = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else first
        self.keys = where[self.places]
        self.ends = np.append(self.places[1:], len(where))

    def search(self, query: Query, weights: np.ndarray, ids: list, best: Best) -> None:
        """Visits the strata of each item, those with the highest bounds first."""
        step = max(1, BUFFER_CELLS // max(self.vocabulary, 1))
        for low in range(0, len(self.m), step):
            here = slice(*np.searchsorted(self.keys, [low * self.vocabulary, (low + step) * self.vocabulary]))
            cells = np.zeros((min(step, len(self.m) - low), self.vocabulary), np.int64)
            last = self.ends[here] - 1
            cells.ravel()[self.keys[here] - low * self.vocabulary] = self.impact[last]
            for item, terms in enumerate(query.terms):
                bounds = cells[:, terms] @ weights[terms]
                for stratum in np.argsort(-bounds).tolist():
                    if bounds[stratum] <= 0 or bounds[stratum] < best.floors[item]:
                        break
                    self._visit(item, low + stratum, terms, weights, ids, best)

    def _visit(self, item: int, stratum: int, terms: np.ndarray, weights: np.ndarray, ids: list, best: Best) -> None:
        keys = stratum * self.vocabulary + terms
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        met = self.keys[at] == keys
        at, weight = at[met], weights[terms[met]]
        lengths = self.ends[at] - self.places[at]
        posting = np.arange(lengths.sum()) + np.repeat(self.places[at] - np.cumsum(lengths) + lengths, lengths)
        docs, own = np.unique(self.docs[posting], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, own, np.repeat(weight, lengths) * self.impact[posting])
        good = scores >= max(1, best.floors[item])
        if good.any():
            best.add(item, scores[good], docs[good], ids)


def searched(index: DataFrame, query: Query, weights: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """item (its number), doc_id and score: the best of each task, none under the item's floor."""
    kind = index.schema["doc_id"].dataType.simpleString()
    asked, vocabulary = Query([], query.terms, {}), max(1, len(query.numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size, id_type = Best(floors, k), [], 0, None

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = (table.column(name).combine_chunks() for name in ("terms", "tfs"))
            strata = Strata(table.column("m").to_numpy(), terms, tfs, vocabulary)
            strata.search(asked, weights, table.column("doc_id").to_pylist(), best)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                size += len(held[-1].column("terms").flatten())
                if size >= BUFFER_POSTINGS:
                    search()
                    held, size = [], 0
        if held:
            search()
        for item, rows in best.held.items():
            columns = [
                pa.array([item] * len(rows), pa.int64()),
                pa.array([row[2] for row in rows], id_type),
                pa.array([-row[0] for row in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return index.select("doc_id", "m", "terms", "tfs").mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple], item_type: str, k: int) -> DataFrame:
    """item_id, rank, doc_id and score for the items of one block."""
    spark = docs.sparkSession
    query = Query.of(items)
    counted = written(occurrences(docs, query.numbers), "lexical-occurrences")
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"] or 1
    weights = np.full(len(query.numbers), math.floor(1000 * math.log(2 * documents + 2)), np.int64)
    for number, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[number] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    m = F.expr(f"50L + ((50L * n * {documents}L) DIV {terms}L)").alias("m")
    place = F.xxhash64(F.lit("lexical"), "doc_id", "n")
    index = written(
        counted.where(F.size("terms") > 0)
        .select("doc_id", m, "terms", "tfs", (F.pmod(place, F.lit(FIRST_SHARE)) == 0).alias("first"))
        .repartitionByRange("m", place)
        .sortWithinPartitions("m"),
        "lexical-index",
    )
    none = np.zeros(len(items), np.int64)
    first = written(_top(searched(index.where("first"), query, weights, none, k), k), "lexical-first")
    floors = none.copy()
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
        floors[item] = score
    rest = searched(index.where("NOT first"), query, weights, floors, k)
    names = spark.createDataFrame(list(enumerate(query.ids)), f"item bigint, item_id {item_type}")
    return (
        _top(first.drop("rank").unionByName(rest), k)
        .join(F.broadcast(names), "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k best documents of each item of ``items``."""
    item_type = items.schema["item_id"].dataType.simpleString()
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for block in range(blocks):
        own = [tuple(row) for row in items.where(place == block).select("item_id", "text").collect()]
        if own:
            found.append(_block(docs, own, item_type, k))
    if not found:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score bigint")
    return reduce(DataFrame.unionByName, found)
