"""Runs of repeating words, by recursive frequency splitting and a lag scan of what survives it.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least ``max(LEAST_LENGTH, 2 * q)`` that no neighbouring word extends with the same period.

Splitting: a run holds each of its words at least twice, so a word that occurs once within a segment is
in no run of it and splits it. The parts are counted anew, until no segment has such a word; segments
shorter than LEAST_LENGTH go. All segments of a part of the batch are counted together by sorting;
what has not settled after SORTED_ROUNDS is split further one segment at a time, counting only the
smaller side of each split.

Lag scan: a run with period q has at least ``t = max(LEAST_LENGTH - q, q)`` matching words in a row at
lag q. Stretches of g words are compared by their hashes at every ``t - g + 1``-th place, so a lag
costs a share 1/q of the segments' words and all lags together about ``2 * n * log(n)`` comparisons.
Where they agree, the words themselves tell how far the match reaches. Places inside a known run whose
period divides the lag are skipped: two runs with periods p and q that share p + q words are one.

A task holds one part of a batch (about 2 MB of text, or one longer text) with some 60 bytes a word.

Defined cases: a null or empty text has no runs and collapses to the empty text; repeated rows give
repeated results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.batches import parts
from tallyscope.llm.hashing import mixed

LEAST_LENGTH = 12
SORTED_ROUNDS = 32
#: Longest stretch that is hashed.
WIDEST = 64

Run = tuple[int, int, int]


def _halved(words: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    """Segments of ``words[first:last]`` without words that occur once in them."""
    settled, open_ = [], [(first, last, Counter(words[first:last].tolist()))]
    while open_:
        lo, hi, counts = open_.pop()
        if hi - lo < LEAST_LENGTH:
            continue
        left, right = lo, hi - 1
        while left <= right and counts[words[left]] > 1 and counts[words[right]] > 1:
            left, right = left + 1, right - 1
        if left > right:
            settled.append((lo, hi))
            continue
        at = left if counts[words[left]] < 2 else right
        sides = sorted([(lo, at), (at + 1, hi)], key=lambda side: side[1] - side[0])
        small = Counter(words[slice(*sides[0])].tolist())
        counts.subtract(small)
        open_ += [(*sides[0], small), (*sides[1], counts)]
    return settled


def split(words: np.ndarray, ends: np.ndarray, rounds: int = SORTED_ROUNDS) -> list[tuple[int, int]]:
    """Places (start, end) of the segments that may hold runs; ``ends`` are the ends of the texts."""
    settled: list[tuple[int, int]] = []
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    bounds = np.column_stack([starts, ends])
    for _ in range(rounds):
        bounds = bounds[bounds[:, 1] - bounds[:, 0] >= LEAST_LENGTH]
        if not len(bounds):
            return settled
        lengths = bounds[:, 1] - bounds[:, 0]
        segment = np.repeat(np.arange(len(bounds)), lengths)
        place = np.arange(lengths.sum()) + np.repeat(bounds[:, 0] - np.cumsum(lengths) + lengths, lengths)
        key = segment << 32 | words[place]
        order = np.argsort(key)
        new = np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))
        once = np.sort(order[new[:-1] & new[1:]])
        losing = np.zeros(len(bounds), bool)
        losing[segment[once]] = True
        settled += map(tuple, bounds[~losing].tolist())
        cuts, of = place[once], segment[once]
        first = np.concatenate(([True], of[1:] != of[:-1])) if len(of) else np.empty(0, bool)
        last = np.concatenate((of[1:] != of[:-1], [True])) if len(of) else np.empty(0, bool)
        before = np.column_stack([np.where(first, bounds[of, 0], np.roll(cuts, 1) + 1), cuts])
        after = np.column_stack([cuts[last] + 1, bounds[of[last], 1]])
        bounds = np.concatenate([before, after])
    for lo, hi in bounds.tolist():
        settled += _halved(words, lo, hi)
    return settled


def _agreeing(words: np.ndarray, left: int, lag: int, step: int) -> int:
    """How many words from ``left`` on (``step`` 1), or before it (-1), equal those ``lag`` later."""
    reach, size = 0, 64
    limit = len(words) - lag - left if step > 0 else left
    while reach < limit:
        size = min(size * 2, limit - reach)
        a = left + reach if step > 0 else left - reach - size
        same = words[a : a + size] == words[a + lag : a + lag + size]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return reach + int(np.argmin(same))
        reach += size
    return limit


def lag_scan(words: np.ndarray, segments: list[tuple[int, int]]) -> list[Run]:
    """Runs (start, length, period) within the segments, as places in ``words``."""
    if not segments:
        return []
    segments = sorted(segments, key=lambda s: s[0] - s[1])
    sizes = np.array([hi - lo for lo, hi in segments])
    # one array of all segments, longest first, with a mark that no word equals after each
    marks = -1 - np.arange(len(segments))
    line = np.concatenate([np.append(words[lo:hi], mark) for (lo, hi), mark in zip(segments, marks, strict=True)])
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
    found: dict[tuple[int, int], int] = {}
    known: dict[int, tuple[list[int], list[int]]] = {}
    periods = np.empty(0, np.int64)
    hashes, width = mixed(line.astype(np.int64).view(np.uint64)), 1
    active = len(segments)
    for lag in range(1, int(sizes[0]) // 2 + 1):
        while sizes[active - 1] < 2 * lag:
            active -= 1
        wide = 4 if lag < 16 else min(WIDEST, 1 << (lag.bit_length() - 2))
        while width < wide:
            hashes = mixed(hashes[:-width] * np.uint64(3) + hashes[width:])
            width *= 2
        stride = max(LEAST_LENGTH - lag, lag) - wide + 1
        stop = int(firsts[active]) - lag - wide
        if stop <= 0:
            continue
        hits = np.flatnonzero(hashes[:stop:stride] == hashes[lag : stop + lag : stride]) * stride
        if not len(hits):
            continue
        for period in periods[lag % periods == 0].tolist():
            starts, ends = known[period]
            at = np.searchsorted(starts, hits, "right") - 1
            inside = (at >= 0) & (np.asarray(ends)[at] >= hits + lag + wide)
            hits = hits[~inside]
        reached = -1
        own: tuple[list[int], list[int]] = ([], [])
        for hit in hits.tolist():
            if hit < reached:
                continue
            right = _agreeing(line, hit, lag, 1)
            left = _agreeing(line, hit, lag, -1)
            start, reached = hit - left, hit + right
            length = right + left + lag
            if length >= max(LEAST_LENGTH, 2 * lag) and (start, length) not in found:
                found[start, length] = lag
                own[0].append(start)
                own[1].append(start + length)
        if own[0]:
            known[lag] = own
            periods = np.append(periods, lag)
    runs = []
    for (start, length), period in found.items():
        segment = int(np.searchsorted(firsts, start, "right")) - 1
        runs.append((segments[segment][0] + start - int(firsts[segment]), length, period))
    return runs


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start and then period."""
    names = {word: i for i, word in enumerate(set(chain.from_iterable(texts)))}
    ends = np.cumsum([len(words) for words in texts], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    words = np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), np.int64, total)
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in lag_scan(words, split(words, ends)):
        text = int(np.searchsorted(ends, start, "right"))
        out[text].append((start - int(ends[text]) + len(texts[text]), length, period))
    for runs in out:
        runs.sort(key=lambda run: (run[0], run[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period of each), and the text collapsed to first periods."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = [(text or "").encode().split() for text in part.column("text").to_pylist()]
            runs = runs_of(texts)
            short = [collapsed(words, own).decode() for words, own in zip(texts, runs, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, _RUNS), pa.array(short, pa.string())],
                ["doc_id", "runs", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
