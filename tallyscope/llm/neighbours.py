"""Nearest vectors by largest inner product: multi-index hashing over learned binary codes.

Codes: vectors get one more component that makes their lengths equal (zero for queries), so that the
largest inner product is the smallest angle; principal components of a bounded sample are rotated by
iterative quantization, and the signs are the bits. Where a vector has fewer components than the code
has bits, several rotations learned from different starts follow one another.

Index: rows are dealt into blocks by a hash of their id. A block cuts its codes into substrings of 16
bits and indexes each substring by value. By the pigeonhole principle a code within the radius of a
query is within a substring's share of the radius in some substring; those values are probed (by
listing the values near the query's, or where that is longer, by testing the values that occur), so
every code of the block within the radius is found. A query whose values hold few rows has these rows
as lists, and costs no more than they are; one whose values hold a good part of the block has a table
of its rows. Both give the same rows. Found rows are ranked by inner products of the
original vectors in double precision, and a block returns its best few for each query.

The radius is fitted: for a sample of ``calibration`` queries the true neighbours among all rows are
found exactly, and the radius takes in the share ``recall`` of them. A query that finds too few rows
within the radius is searched again over all codes. Values that many rows share need no cap, as
blocks are dealt by id: a block has ``rows / blocks`` rows whatever they hold, queries come in slices,
and a task sees one block and one slice.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id; a query meets vectors of its own length only, each length has an index of its own
(more than MOST_LENGTHS lengths are an error); a query's own id is no candidate; rows that repeat an id
are one query, of their smallest length, and several candidates; ties go to the smaller id; without candidates
there is no row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyscope.llm.common import written

BITS = 128
SUB = 16
SAMPLE = 4096
CALIBRATION = 128
RECALL = 0.98
#: Blocks of the index: BLOCKS, and more where a block would pass BLOCK_ROWS. Queries of a slice.
BLOCKS, BLOCK_ROWS, SLICE_QUERIES = 32, 1 << 18, 1 << 14
#: Lengths of vectors in one table.
MOST_LENGTHS = 100
_AT_ONCE = 1 << 21  # cells of a table of queries by rows, or probed values
#: A query that meets fewer than one in LISTED of a block's rows, with repeats, has them as lists.
LISTED = 16
_FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vector: str = "embedding") -> Column:
    """Finite in all components, and not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double"))
    )
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & usable()
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, width))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


@dataclass
class Codes:
    """The learned projection: bits are the signs of the lengthened vectors times ``rotation``."""

    rotation: np.ndarray
    longest: float

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        if query:
            rest = np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        signs = np.column_stack([x, rest]) @ self.rotation > 0
        return np.packbits(signs, axis=1).view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, longest: float, bits: int = BITS, rounds: int = 30) -> Codes:
    """Iterative quantization of the sample's principal components."""
    rest = np.sqrt(np.maximum(longest**2 - (sample * sample).sum(axis=1), 0))
    x = np.column_stack([sample, rest])
    values, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
    axes = axes[:, np.argsort(-values)][:, :64]
    projected = x @ axes
    rng = np.random.default_rng(11)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds if len(x) > axes.shape[1] else 0):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return Codes(np.column_stack(parts)[:, :bits], longest)


def shares(radius: int, parts: int) -> list[int]:
    """Each substring's radius: any code within ``radius`` is within its share in some substring."""
    base, extra = divmod(radius + 1, parts)
    return [base - 1 + (i < extra) for i in range(parts)]


_NEAR: dict[int, np.ndarray] = {}


def near_values(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits set."""
    if radius not in _NEAR:
        values = np.arange(1 << SUB, dtype=np.uint16)
        _NEAR[radius] = values[np.bitwise_count(values) <= radius]
    return _NEAR[radius]


@dataclass
class Part:
    """The index of one substring: the values that occur, and the rows that hold each."""

    values: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    rows: np.ndarray  # by value
    back: np.ndarray  # each row's value, by its place in ``values``
    place: np.ndarray  # each of the 65,536 values' place in ``values``, or -1

    @staticmethod
    def of(codes: np.ndarray) -> Part:
        values, back, sizes = np.unique(codes, return_inverse=True, return_counts=True)
        place = np.full(1 << SUB, -1, np.int32)
        place[values] = np.arange(len(values))
        rows = np.argsort(back, kind="stable").astype(np.int32)
        return Part(values, sizes, np.cumsum(sizes) - sizes, rows, back, place)

    def listed(self, query: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's place and the place of a value that differs from its own by one of ``near``."""
        found = self.place[query[:, None] ^ near]
        q, at = np.nonzero(found >= 0)
        return q, found[q, at]

    def tested(self, query: np.ndarray, share: int) -> np.ndarray:
        """A table of queries by values: the value is within ``share`` bits of the query's own."""
        return np.bitwise_count(query[:, None] ^ self.values) <= share

    def held(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the values at these places, one after the other, and how many each has."""
        size = self.sizes[value]
        before = np.cumsum(size) - size
        return self.rows[np.repeat(self.starts[value] - before, size) + np.arange(size.sum())], size


class Block:
    """The multi-index over one block of rows."""

    def __init__(self, codes: np.ndarray):
        self.words = _words(codes)
        self.parts = [Part.of(column) for column in codes.T]

    def candidates(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row that share a probed value, in order, each once.

        A query that meets few rows has them as lists; one that meets a good part of the block has a
        table of its rows, as lists would hold most rows several times.
        """
        rows, count = len(self.words), len(queries)
        pairs, tables, met = [], [], np.zeros(count)
        for part, query, share in zip(self.parts, queries.T, shares(radius, len(self.parts)), strict=True):
            if share < 0:
                continue
            near = near_values(share)
            if len(near) < len(part.values):
                q, v = part.listed(query, near)
                pairs.append((part, q, v))
                met += np.bincount(q, part.sizes[v], count)
            else:
                hit = part.tested(query, share)
                tables.append((part, hit))
                met += hit.astype(np.float32) @ part.sizes.astype(np.float32)
        many = met > rows / LISTED
        wide, few = np.flatnonzero(many), np.flatnonzero(~many)
        keys = [np.empty(0, np.int64)]
        if len(few):
            lists = [(part, q[~many[q]], v[~many[q]]) for part, q, v in pairs]
            for part, hit in tables:
                q, v = np.nonzero(hit[few])
                lists.append((part, few[q], v))
            for part, q, v in lists:
                found, size = part.held(v)
                keys.append(np.repeat(q, size) * rows + found)
            keys = [np.unique(np.concatenate(keys))]
        if len(wide):
            table = np.zeros((len(wide), rows), bool)
            number = np.cumsum(many) - 1
            for part, q, v in pairs:
                hit = np.zeros((len(wide), len(part.values)), bool)
                hit[number[q[many[q]]], v[many[q]]] = True
                table |= hit[:, part.back]
            for part, hit in tables:
                table |= (hit if not len(few) else hit[wide])[:, part.back]
            q, r = np.nonzero(table)
            keys.append(wide[q] * rows + r)
        both = np.concatenate(keys)
        return np.divmod(np.sort(both) if len(few) and len(wide) else both, rows)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row whose code is within the radius, in order."""
        q, r = self.candidates(queries, radius)
        asked = _words(queries)
        distance = np.zeros(len(q), np.int32)
        for word in range(asked.shape[1]):
            distance += np.bitwise_count(asked[q, word] ^ self.words[r, word])
        near = distance <= radius
        return q[near], r[near]


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    missing = -codes.shape[1] % 4
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, missing)))).view(np.uint64)


def _searched(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, codes: Codes, radius: int, k: int
) -> pd.DataFrame:
    query_codes = codes.of(q, True)
    out_q, out_v, out_s = [], [], []
    block = Block(codes.of(x, False))
    step = max(1, _AT_ONCE // max(len(x), 1))
    for at in range(0, len(q) if len(x) else 0, step):
        group = query_codes[at : at + step]
        asked, rows = block.within(group, radius)
        stops = np.searchsorted(asked, np.arange(len(group)), "right")
        for i, (first, stop) in enumerate(zip([0, *stops[:-1]], stops, strict=True), at):
            found = rows[first:stop]
            found = found[ids[found] != query_ids[i]]
            if len(found) > k:
                rough = x[found] @ q[i]
                limit = np.partition(rough, -k)[-k]
                found = found[rough >= limit - 1e-9 * (1 + abs(limit))]
            scores = (x[found] * q[i]).sum(axis=1)
            best = _best(scores, ids[found], k)
            out_q.append(np.full(len(best), query_ids[i]))
            out_v.append(ids[found][best])
            out_s.append(scores[best])
    names = [c.split()[0] for c in _FOUND.split(", ")]
    columns = [np.concatenate([*part, np.empty(0, kind)]) for part, kind in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64))]
    return pd.DataFrame(dict(zip(names, columns, strict=True)))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, count: int, asked: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best rows within the radius of each query."""
    blocks = max(BLOCKS, -(-count // BLOCK_ROWS))
    slices = max(1, -(-asked // SLICE_QUERIES))
    width = codes.rotation.shape[0] - 1

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = rows.select(
        "vec_id",
        "embedding",
        dealt("vec_id", blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
    )
    right = queries.select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        dealt("vec_id", slices).alias("slice"),
    )

    def run(index: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        return _searched(
            index["vec_id"].to_numpy(np.int64),
            _matrix(index["embedding"], width),
            asking["query_id"].to_numpy(np.int64),
            _matrix(asking["query"], width),
            codes,
            radius,
            k,
        )

    found = (
        left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(run, _FOUND)
    )
    return _top(found, k)


def fitted_radius(rows: DataFrame, queries: DataFrame, codes: Codes, k: int, recall: float = RECALL) -> int:
    """The radius that takes in the share ``recall`` of a sample of queries' true k neighbours."""
    sample = _sampled(queries, CALIBRATION)
    query_ids = sample["vec_id"].to_numpy(np.int64)
    q = _matrix(sample["embedding"], codes.rotation.shape[0] - 1)
    query_codes = codes.of(q, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))] * len(q)
        for batch in batches:
            ids = batch["vec_id"].to_numpy(np.int64)
            x = _matrix(batch["embedding"], q.shape[1])
            own = codes.of(x, False)
            for i, (scores, names, distances) in enumerate(held):
                others = np.flatnonzero(ids != query_ids[i])
                s = np.concatenate([scores, x[others] @ q[i]])
                n = np.concatenate([names, ids[others]])
                d = np.concatenate(
                    [distances, np.bitwise_count(own[others] ^ query_codes[i]).sum(axis=1, dtype=np.int32)]
                )
                best = _best(s, n, k)
                held[i] = s[best], n[best], d[best]
        for i, (s, n, d) in enumerate(held):
            yield pd.DataFrame({"query_id": query_ids[i], "vec_id": n, "score": s, "distance": d})

    near = _top(rows.mapInPandas(run, f"{_FOUND}, distance int"), k)
    at = near.agg(F.percentile("distance", recall)).first()[0]
    return codes.bits if at is None else int(np.ceil(at))


def _sampled(rows: DataFrame, most: int) -> pd.DataFrame:
    """The rows with the smallest hashes of their ids, at most ``most``."""
    order = F.xxhash64(F.lit("sample"), F.col("vec_id"))
    return rows.select("vec_id", "embedding").orderBy(order, "vec_id").limit(most).toPandas()


def nearest(rows: DataFrame, asking: Column, k: int = 20, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row where ``asking`` holds."""
    known = written(vectors(rows), "vectors")
    size = F.size("embedding")
    sizes = [n for (n,) in known.select(size.alias("n")).distinct().orderBy("n").take(MOST_LENGTHS + 1)]
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of vectors")
    if len(sizes) < 2:
        return _of_one_length(known, known.where(asking), k, bits)
    parts = []
    for n in sizes:
        earlier = known.where(asking & (size < n)).select("vec_id")
        queries = known.where(asking & (size == n)).join(earlier, "vec_id", "left_anti")
        parts.append(_of_one_length(known.where(size == n), queries, k, bits))
    return reduce(DataFrame.unionByName, parts)


def _of_one_length(known: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    queries = queries.dropDuplicates(["vec_id"])
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    totals = known.agg(F.count(F.lit(1)).alias("rows"), F.max(length).alias("longest")).first()
    asked = queries.count()
    if not asked:
        return known.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0D AS score").limit(0)
    sample = _sampled(known, SAMPLE)
    codes = learn(_matrix(sample["embedding"], 0), totals["longest"], bits)
    radius = fitted_radius(known, queries, codes, k)
    count = totals["rows"]
    found = written(search(known, queries, codes, radius, k, count, asked), "neighbours")
    # rows that repeat a query's id are no candidates of it
    same = known.join(queries.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").count()
    enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    short = (
        queries.join(enough, "vec_id", "left")
        .join(same, "vec_id")
        .where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(count) - F.col("count")))
        .select("vec_id", "embedding")
    )
    short = written(short, "short-queries")
    missing = short.count()
    if missing:
        again = search(known, short, codes, codes.bits, k, count, missing)
        found = found.join(short, found["query_id"] == short["vec_id"], "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
