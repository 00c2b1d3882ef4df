"""Periodic runs, lexical search and SentencePiece ids against brute force and the library itself."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import lexical, periodic, pieces, queries
from tallyscope.llm.batches import Recent
from tallyscope.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
CLASHING = ("n", "m", "terms", "tfs", "item", "score", "runs", "ids", "words", "h", "first")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """Every lag, every place."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, len(words) // 2 + 1):
        at = 0
        while at + lag < len(words):
            start = at
            while at + lag < len(words) and words[at] == words[at + lag]:
                at += 1
            if at - start + lag >= max(12, 2 * lag):
                found.setdefault((start, at - start + lag), lag)
            at += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words: list, runs: list) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_with_runs(draw: random.Random) -> list[list[bytes]]:
    texts = []
    for _ in range(draw.randint(1, 5)):
        different, n = draw.choice([1, 2, 3, 5, 30, 200]), draw.choice([0, 1, 11, 12, 13, 40, 100, 300])
        words = [b"%d" % draw.randrange(different) for _ in range(n)]
        for _ in range(draw.randint(0, 4) if n > 12 else 0):
            start, period = draw.randrange(n), draw.randint(1, 40)
            for i in range(start + period, min(n, start + period * draw.randint(1, 6) + draw.randrange(period))):
                words[i] = words[i - period]
        texts.append(words)
    return texts


def test_runs_are_those_of_every_lag():
    draw = random.Random(1)
    for _ in range(400):
        texts = texts_with_runs(draw)
        assert periodic.runs_of(texts) == [brute_runs(words) for words in texts]


def test_splitting_settles_alike_in_both_forms():
    draw = random.Random(2)
    for _ in range(200):
        texts = texts_with_runs(draw)
        words = np.array([int(w) for own in texts for w in own], np.int64)
        ends = np.cumsum([len(own) for own in texts])
        assert sorted(periodic.split(words, ends)) == sorted(periodic.split(words, ends, rounds=0))
        for lo, hi in periodic.split(words, ends):
            assert min(Counter(words[lo:hi].tolist()).values()) > 1


def test_long_texts_take_no_square_of_their_length():
    peeled = [b"%d" % (i // 2 + i % 2) for i in range(200_000)]
    assert periodic.runs_of([peeled]) == [[]]
    same = [b"a"] * 100_000
    assert periodic.runs_of([same]) == [[(0, 100_000, 1)]]
    assert periodic.collapsed(same, periodic.runs_of([same])[0]) == b"a"


def planted(doc_id: int | None, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_periodic_query_against_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, " ".join(w.decode() for w in texts_with_runs(draw)[0])) for i in range(300)]
    rows += [(None, "a b " * 20), (400, None), (401, ""), (402, " \n "), (403, "é ñ\n" * 30), (7, rows[7][1])]
    rows += [(404, "a\x0bb\x0cc d " * 9), (405, "\x1cx\x85y " * 20)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in CLASHING})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(tuple(r) for r in queries.op11_periodic(spark, str(tmp_path)).collect())
    wanted = Counter()
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, brute_collapsed(words, runs))]
        exponent = 1000 * best[1] // best[2] if runs else None
        wanted[(doc_id, len(runs), *best, exponent, *digests)] += 1
    assert found == wanted
    assert sum(r[1] for r in wanted) > 100
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranked(docs: list, items: list, k: int = 50) -> Counter:
    terms = [(doc_id, Counter(TERM.findall((text or "").translate(LOWER)))) for doc_id, text in docs]
    terms = [(doc_id, own) for doc_id, own in terms if own]
    count, total = len(terms), sum(sum(own.values()) for _, own in terms)
    df = Counter(term for _, own in terms for term in own)
    out = Counter()
    for item_id, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, own in terms:
            m = 100 - 50 + 50 * sum(own.values()) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 20 * m))
                for t in asked & own.keys()
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort()
        out.update((item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1))
    return out


def ranked(docs, items, **more) -> Counter:
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.ranked(docs, items, **more).collect())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    vocabulary_ = [f"w{i}" for i in range(400)] + ["Été", "été", "x-y", "A.B", "7"]
    weights = [1 / (i + 2) for i in range(len(vocabulary_))]

    def text(low, high):
        return " ".join(draw.choices(vocabulary_, weights, k=draw.randint(low, high)))

    docs = [(i, text(1, 5) if i % 3 else text(20, 400)) for i in range(1500)]
    same = text(10, 10)
    docs += [(5000 - i, same) for i in range(500)]  # a third of the rows are copies of one text
    docs += [(None, same), (2000, None), (2001, ""), (2002, "-.,"), (3, docs[3][1]), (2003, "W1 w1\x00w1\x7fw2")]
    items = [(i, text(3, 12)) for i in range(30)]
    items += [(100, same), (101, None), (102, "unseen"), (103, " ,"), (100, same), (None, "w1 w2"), (104, text(900, 900))]
    return docs, items


def test_search_against_brute_force(spark, corpus):
    docs, items = corpus
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({n: F.lit("x") for n in CLASHING})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("x"))
    wanted = brute_ranked(docs, items)
    assert ranked(frame, asked) == wanted
    assert ranked(frame, asked, block_chars=900) == wanted  # several blocks of items
    assert ranked(frame, asked, k=3) == brute_ranked(docs, items, 3)


def test_search_in_small_buffers(corpus, monkeypatch, spark):
    docs, items = corpus
    query = lexical.Query.of(items)
    counts = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    import pyarrow as pa

    rows = [sorted((query.numbers[w.encode()], n) for w, n in own.items() if w.encode() in query.numbers) for own in counts]
    terms, tfs = (pa.array([[x[i] for x in row] for row in rows], pa.list_(pa.int32())) for i in (0, 1))
    m = np.array([50 + sum(own.values()) % 40 for own in counts])
    weights = np.arange(1, len(query.numbers) + 1)
    results = []
    for cells in (1, 1 << 23):
        monkeypatch.setattr(lexical, "BUFFER_CELLS", cells)
        best = lexical.Best(np.zeros(len(items), np.int64), 50)
        lexical.Strata(m, terms, tfs, len(query.numbers)).search(query, weights, [d for d, _ in docs], best)
        results.append(dict(best.held))
    assert results[0] == results[1] and results[0]


def test_search_of_empty_tables_and_other_ids(spark, corpus):
    docs, items = corpus
    frame = spark.createDataFrame(docs[:200], SCHEMA)
    asked = spark.createDataFrame(items[:5], "item_id bigint, text string")
    assert lexical.ranked(frame.limit(0), asked).count() == 0
    assert lexical.ranked(frame, asked.limit(0)).count() == 0
    named = frame.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    wanted = brute_ranked([(f"d{i}", text) for i, text in docs[:200]], items[:5])
    assert ranked(named, asked) == wanted


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(vocabulary("piece_bpe_32k.model"))


def strange_texts(draw: random.Random, model: pieces.Pieces, count: int) -> list[str]:
    marks = "▁| |\n|  |\t|\0|a|the|...|é|ｗ|ﬁ|😀|👨‍👩‍👧|漢|한|﻿|0|23|<s>|<0x41>|<unk>|⁇|\r\n|==|ing|://|ا|नमस्ते|\x85|\xa0|→".split("|")
    known = list(model.numbers)

    def one() -> str:
        kind = draw.random()
        if kind < 0.5:
            return draw.choice(marks)
        if kind < 0.9:
            return draw.choice(known)
        return chr(draw.choice([draw.randrange(0x20, 0xD800), draw.randrange(0xE000, 0x110000)]))

    return ["".join(one() for _ in range(draw.randrange(12))) for _ in range(count)]


def test_ids_are_those_of_the_library(model):
    texts = strange_texts(random.Random(5), model, 5000)
    texts += ["x" * 3000, "ab" * 3000, "▁" * 500, " " * 77, "é" * 100 + "the" * 100]
    mine = model.encode(texts, Recent(500))
    theirs = model.library.encode(texts)
    assert [own.tolist() for own in mine] == theirs
    assert [model.decode(own) for own in mine] == model.library.decode(theirs)


def test_text_of_any_ids_is_that_of_the_library(model):
    draw = random.Random(6)
    kinds = [lambda: draw.randrange(3), lambda: draw.randrange(3, 259), lambda: draw.randrange(259, 32000), lambda: 28705]
    for _ in range(3000):
        ids = [draw.choice(kinds)() for _ in range(draw.randrange(9))]
        assert model.decode(np.array(ids, np.int32)) == model.library.decode(ids), ids


def test_agenda_and_rows_of_one_length_agree(model):
    parts = {p for t in strange_texts(random.Random(7), model, 2000) for p in model.parts.findall(t)}
    assert model.new_ids(parts) == {part: model.part_ids(part) for part in parts}


def test_pieces_query(spark, tmp_path, model):
    texts = strange_texts(random.Random(8), model, 200)
    texts += [t.as_py() for t in pq.read_table(f"{SMALL}/documents.parquet")["text"]]
    rows = [*enumerate(texts), (None, "a b"), (900_001, None), (900_002, ""), (900_003, "word " * 40_000), (3, texts[3])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in (*CLASHING, "decoded", "agrees")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = Counter()
    for doc_id, text in rows:
        ids = model.library.encode(text or "")
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), model.library.decode(ids))]
        wanted[(doc_id, len(ids), *digests, True)] += 1
    assert Counter(tuple(r) for r in queries.op13_pieces(spark, str(tmp_path)).collect()) == wanted
    assert pieces.encoded(docs.limit(0), vocabulary("piece_bpe_32k.model"), check=False).count() == 0
