"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Words are hashed to 64 bits. The vocabulary is a sorted hash array with a count for each word; a
word's place in it is its number. Bigrams are counted as pairs of numbers and stored as a sorted
array of a reversible hash of the pair, with counts. A third set of arrays, by word number, holds
what Kneser-Ney needs of each word: how many different words it follows, and how many different words
follow it once, twice, or more often.

Counting: a task sorts and sums the keys it has read and deals them out by bucket (leading bits of
the hash) as compressed runs; one task then merges a bucket into its file. Buckets are of equal
size whatever words are frequent, and their number grows with the corpus, so that a bucket stays at
about ``BUCKET_TOKENS`` tokens. All counts cover all training texts; nothing is pruned.

Scoring: workers map the files from the shared folder and look up a batch's different keys in
sorted order. If the shared folder is no file system of the workers (``file:`` or a mount), they
read the arrays into memory instead.

    p(w | u) = (c(u w) - D(c)) / c(u) + g(u) p(w),    p(w) = (n(w) - D(n)) / n + g / (V + 1)

n(w) is the number of different words before w, n their sum, D the three discounts of each order from
its counts of counts, g what the discounts free. Words not seen in training share one more place of
the vocabulary; after a word not seen, p(w) alone holds.

Order 2 is what the disk budget of the check allows (a third order would take the counts and files
three to four times that). Defined cases: a null or empty text is the end token alone; rows that
repeat count each time; with no training text every token has probability 1; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import shared_folder, uri_of, written
from tallyscope.llm.hashing import Stretches, mixed

#: The end token's hash (words hash elsewhere), and the white space between words.
END = np.uint64(0x0E0D0F0D0E0D0F0D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

CHUNK_BYTES = 1 << 20
RUN_TOKENS = 3 << 20
BUCKET_TOKENS = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 16
RUNS = "bucket int, keys binary, counts binary"
FILES = "bucket int, rows bigint, total bigint, ones bigint, twos bigint, threes bigint, fours bigint, uri string"


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of all texts, and each text's first place among them."""
    encoded = [(text or "").encode().lower() for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    stops = np.cumsum([len(e) + 1 for e in encoded])
    words = np.searchsorted(starts, stops)
    hashes = np.insert(Stretches(data).of(starts, ends), words, END)
    firsts = np.concatenate(([0], words[:-1])) + np.arange(len(texts))
    return hashes, firsts


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in runs of about CHUNK_BYTES of text."""
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).cumsum().to_numpy() // CHUNK_BYTES
        for _, part in batch.groupby(sizes):
            yield part


def _packed(values: np.ndarray) -> bytes:
    """Byte planes of unsigned values, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _runs(keys: np.ndarray, buckets: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
    """One row a bucket for sorted keys and the columns of numbers beside them."""
    order = np.argsort(buckets, kind="stable")
    keys, buckets = keys[order], buckets[order]
    columns = [c[order] for c in columns]
    firsts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    rows = []
    for a, b in zip(firsts, [*firsts[1:], len(keys)], strict=True):
        steps = np.diff(keys[a:b], prepend=np.uint64(0))
        rows.append((int(buckets[a]), _packed(steps), _packed(np.concatenate([c[a:b] for c in columns]))))
    return pd.DataFrame(rows, columns=["bucket", "keys", "counts"])


def _unrun(row, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.cumsum(_unpacked(row.keys)), np.split(_unpacked(row.counts), columns)


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """The runs of each bucket, from rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.bucket != bucket and held:
                yield bucket, held
                held = []
            bucket = row.bucket
            held.append(row)
    if held:
        yield bucket, held


def _leading(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _least_type(values: np.ndarray) -> str:
    return "<u4" if not len(values) or int(values.max()) < 1 << 32 else "<u8"


def _write(folder: str, arrays: list[np.ndarray]) -> str:
    """Arrays one after the other under a fresh name; the name tells the counts' width."""
    width = arrays[-1].dtype.itemsize
    uri = f"{folder}/{uuid.uuid4().hex}-{width}.bin"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return uri


def _bytes_of(uri: str) -> np.ndarray:
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """D(0) to D(3), the last for 3 and more; kept within what they are taken from."""
    if not ones or not twos:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = ones / (ones + 2 * twos)
    d = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 1.5]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))])


@dataclass
class Sorted:
    """A sorted hash array over bucket files, each mapped when first used."""

    bits: int
    files: list[tuple[int, int, str]]  # bucket, rows, uri; by bucket
    mapped: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def __post_init__(self):
        self.place = {bucket: i for i, (bucket, _, _) in enumerate(self.files)}
        self.bases = np.concatenate(([0], np.cumsum([rows for _, rows, _ in self.files]))).astype(np.int64)

    def arrays(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.mapped:
            _, rows, uri = self.files[i]
            data = _bytes_of(uri)
            kind = f"<u{uri.rsplit('-', 1)[1][0]}"
            self.mapped[i] = data[: 8 * rows].view("<u8"), data[8 * rows :].view(kind)
        return self.mapped[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted different keys: the place of each in the whole array (or -1) and its count."""
        places, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        buckets = _leading(keys, self.bits)
        firsts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(keys) else []
        for a, b in zip(firsts, [*firsts[1:], len(keys)], strict=True) if len(keys) else []:
            i = self.place.get(int(buckets[a]))
            if i is None:
                continue
            own, values = self.arrays(i)
            at = np.searchsorted(own, keys[a:b])
            hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == keys[a:b])
            places[a + hit] = self.bases[i] + at[hit]
            counts[a + hit] = values[at[hit]]
        return places, counts


def range_of(numbers: np.ndarray, ranges: int, size: int) -> np.ndarray:
    return numbers.astype(np.int64) * ranges // size


def range_bounds(r: int, ranges: int, size: int) -> tuple[int, int]:
    return -(-r * size // ranges), -(-(r + 1) * size // ranges)


#: What the statistics hold of each word number, one array each.
FOLLOWS, TOTAL, ONES, TWOS, MORE = range(5)


@dataclass
class Model:
    """What workers need to score: two sorted hash arrays and the files of word statistics.

    The number ``words`` stands for the beginning of a text, a context only.
    """

    tokens: int
    words: int
    vocabulary: Sorted
    bigrams: Sorted
    ranges: int
    statistics: dict[int, str]  # range of word numbers -> uri
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    follows: int
    free: float
    mapped: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def of_words(self, numbers: np.ndarray) -> np.ndarray:
        """The statistics (columns) of word numbers; zeros for -1."""
        out = np.zeros((5, len(numbers)), np.int64)
        places = np.where(numbers < 0, -1, range_of(numbers, self.ranges, self.words + 1))
        for r in map(int, np.unique(places[places >= 0])):
            if r not in self.mapped:
                low, high = range_bounds(r, self.ranges, self.words + 1)
                if uri := self.statistics.get(r):
                    kind = f"<u{uri.rsplit('-', 1)[1][0]}"
                    self.mapped[r] = low, _bytes_of(uri).view(kind).reshape(5, high - low)
                else:
                    self.mapped[r] = low, np.zeros((5, high - low), np.uint32)
            low, table = self.mapped[r]
            mine = np.flatnonzero(places == r)
            out[:, mine] = table[:, numbers[mine] - low]
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's word number (-1: not in training) and its count."""
        different, back = np.unique(hashes, return_inverse=True)
        places, counts = self.vocabulary.find(different)
        return places[back], counts[back]

    def probabilities(self, numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
        different, back = np.unique(np.concatenate((numbers, before)), return_inverse=True)
        now, then = back[: len(numbers)], back[len(numbers) :]
        table = self.of_words(different)
        follows, total = table[FOLLOWS], table[TOTAL]
        own = np.maximum(follows - self.word_discounts[np.minimum(follows, 3)], 0)
        alone = own / max(self.follows, 1) + self.free / (self.words + 1)
        freed = self.pair_discounts[1:] @ table[ONES:] / np.maximum(total, 1)
        inside = total[then] > 0
        p = alone[now] * np.where(inside, freed[then], 1.0)
        pairs = np.flatnonzero(inside & (numbers >= 0))
        key, place = np.unique(mixed(pair_keys(before[pairs], numbers[pairs])), return_inverse=True)
        count = self.bigrams.find(key)[1][place]
        high = np.maximum(count - self.pair_discounts[np.minimum(count, 3)], 0)
        p[pairs] += high / total[then[pairs]]
        return p

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        hashes, firsts = token_hashes(texts)
        numbers, counts = self.numbers(hashes)
        base = np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        own = np.log10(self.probabilities(numbers, befores(numbers, firsts, self.words)))
        return {
            "n_tokens": np.diff(np.append(firsts, len(hashes))),
            "n_known": np.add.reduceat((counts > 0).astype(np.int64), firsts),
            "base_score": np.add.reduceat(base, firsts),
            "score": np.add.reduceat(own, firsts),
        }


def befores(numbers: np.ndarray, firsts: np.ndarray, beginning: int) -> np.ndarray:
    before = np.concatenate(([beginning], numbers[:-1]))
    before[firsts] = beginning
    return before


def pair_keys(before: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)


def _collected(rows: DataFrame) -> list:
    """The small rows that describe files, at most MOST_BUCKETS of them."""
    names = [c.split()[0] for c in FILES.split(", ")]
    return sorted(rows.select(*names).collect())


def train(docs: DataFrame) -> Model:
    """Counts all texts of ``docs`` and writes the model's files into the shared folder."""
    folder = f"{uri_of(shared_folder(docs.sparkSession))}/ngrams-{uuid.uuid4().hex}"
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = min(max(size // (6 * BUCKET_TOKENS), LEAST_BUCKETS), MOST_BUCKETS)
    bits = int(wanted - 1).bit_length()
    file_names = [c.split()[0] for c in FILES.split(", ")]

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            keys, counts = _summed(np.concatenate(held), None)
            return _runs(keys, _leading(keys, bits), [counts])

        for part in chunks(batches):
            held.append(token_hashes(part["text"].tolist())[0])
            n += len(held[-1])
            if n >= RUN_TOKENS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def merge_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, rows in _by_bucket(batches):
            runs = [_unrun(row, 1) for row in rows]
            keys, counts = _summed(np.concatenate([r[0] for r in runs]), np.concatenate([r[1][0] for r in runs]))
            uri = _write(f"{folder}/words", [keys, counts.astype(_least_type(counts))])
            row = (bucket, len(keys), int(counts.sum()), 0, 0, 0, 0, uri)
            yield pd.DataFrame([row], columns=file_names)

    def merged(runs: DataFrame, merge, schema: str, name: str) -> DataFrame:
        dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
        return written(dealt.mapInPandas(merge, schema), name)

    words = _collected(merged(texts.mapInPandas(count_words, RUNS), merge_words, FILES, "lm-words"))
    vocabulary = Sorted(bits, [(r.bucket, r.rows, r.uri) for r in words])
    tokens, count = sum(r.total for r in words), sum(r.rows for r in words)
    if count >= (1 << 32) - 1:
        raise ValueError("word numbers have 32 bits")
    beginning, known = count, count + 1

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            keys, counts = _summed(np.concatenate(held), None)
            return _runs(keys, _leading(mixed(keys), bits), [counts])

        for part in chunks(batches):
            hashes, firsts = token_hashes(part["text"].tolist())
            different, back = np.unique(hashes, return_inverse=True)
            numbers = vocabulary.find(different)[0][back]
            held.append(pair_keys(befores(numbers, firsts, beginning), numbers))
            n += len(hashes)
            if n >= RUN_TOKENS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def merge_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", *file_names, "keys", "counts"]
        for bucket, rows in _by_bucket(batches):
            runs = [_unrun(row, 1) for row in rows]
            keys, counts = _summed(np.concatenate([r[0] for r in runs]), np.concatenate([r[1][0] for r in runs]))
            spread = mixed(keys)
            order = np.argsort(spread)
            uri = _write(f"{folder}/pairs", [spread[order], counts[order].astype(_least_type(counts))])
            row = ("file", bucket, len(keys), int(counts.sum()), *_counts_of_counts(counts), uri, b"", b"")
            yield pd.DataFrame([row], columns=names)
            sides = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            numbers, place = np.unique(np.concatenate(sides), return_inverse=True)
            first, last = place[: len(keys)], place[len(keys) :]
            table = [
                np.bincount(last, minlength=len(numbers)),
                np.bincount(first, counts, len(numbers)),
                *(np.bincount(first[counts == k], minlength=len(numbers)) for k in (1, 2)),
                np.bincount(first[counts > 2], minlength=len(numbers)),
            ]
            parts = _runs(numbers.astype(np.uint64), range_of(numbers, ranges, known), [c.astype(np.int64) for c in table])
            parts = parts.assign(kind="words", **{n: 0 for n in file_names[1:-1]}, uri="")
            yield parts[names]

    ranges = max(LEAST_BUCKETS, known // BUCKET_TOKENS)
    pairs = merged(
        texts.mapInPandas(count_pairs, RUNS),
        merge_pairs,
        f"kind string, {FILES}, keys binary, counts binary",
        "lm-pairs",
    )
    files = _collected(pairs.where("kind = 'file'"))

    def merge_statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for place, rows in _by_bucket(batches):
            low, high = range_bounds(place, ranges, known)
            table = np.zeros((5, high - low), np.uint64)
            for row in rows:
                numbers, columns = _unrun(row, 5)
                table[:, numbers.astype(np.int64) - low] += np.stack(columns)
            follows = table[FOLLOWS]
            uri = _write(f"{folder}/statistics", [table.astype(_least_type(table.ravel()))])
            row = (place, int(np.count_nonzero(follows)), int(follows.sum()), *_counts_of_counts(follows), uri)
            yield pd.DataFrame([row], columns=file_names)

    statistics = _collected(
        merged(pairs.where("kind = 'words'").select("bucket", "keys", "counts"), merge_statistics, FILES, "lm-statistics")
    )

    def ones_to_fours(rows: list) -> list[int]:
        return [sum(getattr(r, n) for r in rows) for n in ("ones", "twos", "threes", "fours")]

    n = ones_to_fours(statistics)
    seen, follows = sum(r.rows for r in statistics), sum(r.total for r in statistics)
    word_discounts = discounts(*n)
    freed = word_discounts[1:] @ np.array([n[0], n[1], seen - n[0] - n[1]])
    return Model(
        tokens,
        count,
        vocabulary,
        Sorted(bits, [(r.bucket, r.rows, r.uri) for r in files]),
        ranges,
        {r.bucket: r.uri for r in statistics},
        discounts(*ones_to_fours(files)),
        word_discounts,
        follows,
        float(freed / follows) if follows else 1.0,
    )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            columns = model.score(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **columns})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
