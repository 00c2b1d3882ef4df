"""The corpus operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tallyscope.llm import hashing, markup, mixing, neighbours, oracle, packing, piecewise, queries, simhash, template, tokens, warc
from tallyscope.llm.common import shared_folder

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name: str) -> list[dict]:
    import pyarrow.parquet as pq

    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def run(spark, name: str) -> list:
    return queries.QUERIES[name](spark, SMALL).collect()


def held_out(doc_id: int, modulus: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for view in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SMALL}/{view}.parquet'")
    cursor = connection.execute(oracle.STATEMENTS[name])
    names = [c[0] for c in cursor.description]
    theirs = Counter(cursor.fetchall())
    result = queries.QUERIES[name](spark, SMALL)
    assert sorted(result.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in result.collect()) == theirs


@needs_tables
def test_language_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in table("documents")}
    rows = run(spark, "op1_language")
    assert len(rows) == len(langs)
    assert all(r["held_out"] == held_out(r["doc_id"], 5) for r in rows)
    asked = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in asked) >= 0.95 * len(asked)


def test_seekable_bundles(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://h/{i}", f"<p>page {i} " + "word " * (i % 50)) for i in range(400)],
        "page_id bigint, url string, html string",
    ).coalesce(1)
    folder = f"{shared_folder(spark)}/warc-seekable"
    index = warc.write_archives(pages, folder, frame_bytes=4000, bundle_bytes=20_000).collect()
    bundles = {r["bundle"] for r in index}
    assert len(bundles) > 1 and len({(r["bundle"], r["frame"]) for r in index}) > 20
    for uri in bundles:
        path = uri.removeprefix("file://")
        with open(path, "rb") as file:
            whole = file.read()
        plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
        file, frames = warc._opened(uri)
        starts = np.concatenate(([0], np.cumsum([f[2] for f in frames])))
        assert len(plain) == starts[-1]
        for r in (r for r in index if r["bundle"] == uri):
            at = starts[r["frame"]] + r["offset"]
            head, _, payload = warc.parse(plain[at : at + r["length"]])
            assert head["WARC-Record-ID"] == r["record_id"]
            assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


class Kneser:
    """The model of the docstring with dictionaries."""

    def __init__(self, texts: list[list[str]]):
        self.words, self.pairs = Counter(), Counter()
        for words in texts:
            for before, word in zip([None, *words], words, strict=False):
                self.words[word] += 1
                self.pairs[before, word] += 1
        self.follows = Counter(word for _, word in self.pairs)
        self.total, self.kinds = Counter(), defaultdict(Counter)
        for (before, _), count in self.pairs.items():
            self.total[before] += count
            self.kinds[before][min(count, 3)] += 1
        self.d1, self.d2 = self.discounts(self.follows), self.discounts(self.pairs)
        self.n = sum(self.follows.values())
        self.free = sum(self.d1[min(c, 3)] for c in self.follows.values()) / self.n

    @staticmethod
    def discounts(counts: Counter) -> list[float]:
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        return [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]

    def word(self, word: str) -> float:
        c = self.follows[word]
        return max(c - self.d1[min(c, 3)], 0) / self.n + self.free / (len(self.words) + 1)

    def pair(self, before: str | None, word: str) -> float:
        if not self.total[before]:
            return self.word(word)
        c, t = self.pairs[before, word], self.total[before]
        freed = sum(self.d2[k] * n for k, n in self.kinds[before].items()) / t
        return max(c - self.d2[min(c, 3)], 0) / t + freed * self.word(word)


@needs_tables
def test_ngrams_against_dictionaries(spark):
    texts = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(LOWER)), "\n"] for r in table("documents")}
    model = Kneser([words for i, words in texts.items() if not held_out(i, 10)])
    n, v = sum(model.words.values()), len(model.words)
    rows = run(spark, "op3_ngrams")
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(model.words[w] > 0 for w in words)
        base = sum(math.log10((model.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        score = sum(math.log10(model.pair(a, b)) for a, b in zip([None, *words], words, strict=False))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


@needs_tables
def test_mix_order(spark):
    """At any point of the mixed stream the sources stay near their targets' proportion."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = mixing.plan(docs, range_rows=16).collect()
    target = {r["source"]: r["target"] for r in plan}
    largest = max(r["size"] for r in plan)
    taken = Counter()
    stream = mixing.mixed(docs, range_rows=16).collect()
    assert len(stream) == sum(r["copies"] for r in plan)
    for row in stream[: len(stream) // 2]:
        taken[row["source"]] += len(WORD.findall(row["text"]))
    half = sum(taken.values()) / sum(target.values())
    assert all(abs(taken[s] - half * target[s]) <= 2 * largest + 0.1 * target[s] for s in target)


def test_word_tokenizer():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [
        "Don't stop, they're 'quoted'. e.g. x,y;z a--b ''. 3,000.50 é, É!? naïve... É́a",
        "<|endoftext|> <|startoftext|>text …! “word.” don’t ×2 ÷, 中文。 tab\tx\x0by\x1cz w v",
        "ΟΔΟΣ ΟΔΟΣ, İstanbul ǅ ﬁne Å Å \U0001f600\U0001f600 á, \x00 \x85",
        "",
        None,
    ]
    words = tokens.WordTokenizer(path, recent=20)
    for _ in range(2):
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


@needs_tables
def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    rows = run(spark, "op5_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = np.array([*plain.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths.append(at)
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths)


def test_balanced_costs():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0, room=512, buffered=64)
    pieces = [p for n in rng.integers(1, 300, 400) for p in packer.add(("d",), int(n))]
    full = [s for s, n in Counter({s: sum(p[2] for p in pieces if p[3] == s) for s in {p[3] for p in pieces}}).items() if n == 512]
    cost = [sum(p[2] + p[2] ** 2 / 1024 for p in pieces if p[3] == s) for s in full]
    assert len(full) > 50 and max(cost) < 1.35 * min(cost)


def brute_pieces(text: str) -> str:
    """The fingerprint, byte by byte."""
    data = text.encode()
    weights = [int(w) for w in hashing._BYTE_VALUES]

    def of(part: bytes, more: int) -> int:
        power, value = 1, more
        for byte in part:
            value = (value + weights[byte] * power) % 2**64
            power = power * hashing._MULTIPLIER % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            value = (value ^ (value >> shift)) * factor % 2**64
        return value ^ (value >> 31)

    rolled = {end: of(data[end - 7 : end], 0) >> 32 for end in range(7, len(data) + 1)}

    def signature(block: int) -> str:
        out, start = "", 0
        for end in [e for e, h in rolled.items() if h % block == block - 1][:63] + [len(data)]:
            if start < end:
                out += LETTERS[of(data[start:end], end - start) % 64]
                start = end
        return out

    block = 1
    while block * 64 < len(data):
        block *= 2
    while block > 1 and sum(h % block == block - 1 for h in rolled.values()) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def brute_likeness(left: str, right: str) -> float:
    def distance(x: str, y: str) -> int:
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, above = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        return row[-1]

    marks = [m.split(":") for m in (left, right)]
    sizes = [{int(b): one, 2 * int(b): two} for b, one, two in marks]
    both = [(sizes[0][s], sizes[1][s]) for s in sizes[0].keys() & sizes[1].keys()]
    return max((1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in both), default=0.0)


@needs_tables
def test_piecewise_against_brute_force(spark):
    texts = [r["text"] for r in table("documents") if len(r["text"]) < 4000][:40] + ["", "a", "short one", "é" * 300]
    for text in texts[:-4] + ["a", "short one", "é" * 300]:
        assert piecewise.fingerprint(text) == brute_pieces(text)
    marks = [piecewise.fingerprint(t) for t in texts]
    pairs = [(a, b) for a in marks[-12:] for b in marks]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", piecewise.likeness("a", "b").alias("is"))
    for r in found.collect():
        assert r["is"] == pytest.approx(brute_likeness(r["a"], r["b"]))


@needs_tables
def test_piecewise(spark):
    docs = sorted(table("documents"), key=lambda r: r["doc_id"])
    rows = {r["doc_id"]: r for r in run(spark, "op6_piecewise")}
    assert len(rows) == len(docs)
    for own, after in zip(docs, [*docs[1:], docs[0]], strict=True):
        text, tail = own["text"], len(own["text"]) // 4
        changed = text[: len(text) - tail] + after["text"][:tail]
        r = rows[own["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == piecewise.fingerprint(text)
        assert r["edited_fingerprint"] == piecewise.fingerprint(changed)
    near = [r["near_edited"] > r["near_next"] for r in rows.values()]
    assert sum(near) > 0.95 * len(near)


def test_ranges_of_documents(spark, monkeypatch):
    monkeypatch.setattr(piecewise, "RANGE_ROWS", 7)
    rows = [(i * 3, f"text {i} " * 9) for i in range(100)]
    found = piecewise.edited(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    marks = {i: piecewise.fingerprint(t) for i, t in rows}
    got = {r["doc_id"]: r["next_fingerprint"] for r in found.collect()}
    assert got == {i * 3: marks[(i + 1) % 100 * 3] for i in range(100)}


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_piecewise_follows_the_ids_own_order(spark, monkeypatch, kind):
    """Text ids go by text, integers beyond 2^53 by their last digit, nulls last."""
    monkeypatch.setattr(piecewise, "RANGE_ROWS", 7)
    ids = [str(i) if kind == "string" else (1 << 60) + i for i in range(100)]
    rows = [(i, f"text of {i} and {hash(str(i)) % 97} more words") for i in ids] + [(None, "without an id")]
    found = piecewise.edited(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)).collect()
    assert len(found) == len(rows)
    marks = {i: piecewise.fingerprint(t) for i, t in rows}
    order = [*sorted(ids), None]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    assert {r["doc_id"]: r["next_fingerprint"] for r in found} == {i: marks[after[i]] for i in order}


@needs_tables
def test_neighbours_recall(spark):
    rows = table("embeddings")
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    found = defaultdict(list)
    for r in sorted(run(spark, "op7_neighbours"), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    place = {i: n for n, i in enumerate(ids)}
    hits = 0
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(asked)
    for i in asked:
        scores = (x * x[place[i]]).sum(axis=1)
        scores[place[i]] = -np.inf
        true = ids[np.lexsort((ids, -scores))[:20]]
        hits += len(set(true) & {v for v, _ in found[i]})
        assert [s for _, s in found[i]] == sorted((scores[place[v]] for v, _ in found[i]), reverse=True)
    assert hits >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("radius", [0, 3, 9, 20, 40, 64])
def test_pigeonhole_finds_every_code(radius):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 16, (600, 4), dtype=np.uint16)
    asked = np.concatenate([codes[:20] ^ np.uint16(5), rng.integers(0, 1 << 16, (20, 4), dtype=np.uint16)])
    distance = np.bitwise_count(asked[:, None] ^ codes).sum(axis=2)
    found = np.zeros_like(distance, bool)
    found[neighbours.Block(codes).within(asked, radius)] = True
    assert (found == (distance <= radius)).all()


def test_neighbours_index_looks_at_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 64))
    x = centres[rng.integers(0, len(centres), 12_000)] + 0.15 * rng.normal(size=(12_000, 64))
    codes = neighbours.learn(x[:4096], np.sqrt((x * x).sum(axis=1)).max())
    block, asked = neighbours.Block(codes.of(x, False)), codes.of(x[:300], True)
    q, r = block.candidates(asked, 20)
    assert len(q) < 0.2 * len(asked) * len(x)
    assert len(set(zip(q.tolist(), r.tolist(), strict=True))) == len(q)
    # the same pairs whether queries have lists, tables, or some of each
    for radius in (20, 34):
        sole = [block.within(asked[i : i + 1], radius)[1].tolist() for i in range(len(asked))]
        q, r = block.within(asked, radius)
        assert [r[q == i].tolist() for i in range(len(asked))] == sole


def test_template_without_marks(spark):
    """A host whose article has no telling name: the template's slots show it."""
    pages = [
        (
            i,
            f"http://h/{i}",
            f"<html><body><div class=x1><a href=1>Home</a> <a href=2>All about us</a></div><div class=y><h2>Title {i}</h2>"
            f"<p>First of page {i} with &eacute;.<p>Second <b>part</b> {i * i} follows here at length.</div>"
            f"<div class='comment-list'><p>Reader {i} says something long about it all.</div>"
            "<div class=z>Made with care by us</div></body></html>",
        )
        for i in range(12)
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for r in template.extracted(frame).collect():
        i = r["page_id"]
        assert r["text"] == f"Title {i}\n\nFirst of page {i} with é.\n\nSecond part {i * i} follows here at length."


def texts_of(spark, bodies: list[str]) -> list[str]:
    pages = [(i, f"http://h/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]
    rows = template.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["page_id"])]


@pytest.mark.parametrize(
    "page",
    [
        "<article><h2 id=how-to-share-files>A {0}</h2><section id=discussion><p>B {0}</section>"
        "<section id=related-work><p>C {0}</section></article>",
        "<div class='content has-sidebar'><h2>A {0}</h2><p>B {0}<p>C {0}</div><div class=sidebar><p>x {0}</div>",
        "<div id=content-sidebar-wrap><article><p>A {0}<p>B {0}<p>C {0}</article></div>",
        "<article class='post comments-open'><p>A {0}<p>B {0}<p>C {0}<div class=comments><p>x {0}</div></article>",
        "<div class=has-sidebar><p>A {0} and more<p>B {0}<p>C {0}</div><div class=sidebar><p>x {0}</div>",
    ],
)
def test_names_hide_no_article(spark, page):
    found = texts_of(spark, [page.format(i) for i in range(6)])
    assert found == [f"A {i}{' and more' * ('more' in page)}\n\nB {i}\n\nC {i}" for i in range(6)]


def test_template_inside_marked_articles(spark):
    """What every page repeats in its article, and its slot of links, are not the article's text."""
    page = (
        "<article><h1><a href=/{0}>T {0}</a></h1><div class=q><a href=1>One</a> <a href=2>Two {0}</a></div>"
        "<p>B {0}<div class=r>Write to us for more of this</div><p>C {0}</article>"
    )
    assert texts_of(spark, [page.format(i) for i in range(6)]) == [f"T {i}\n\nB {i}\n\nC {i}" for i in range(6)]
    copies = ["<article><p>The same</article>"] * 5
    assert texts_of(spark, copies) == ["The same"] * 5


def test_template_keeps_headings_and_references(spark):
    """Headings and lists of links that an article's pages share in form stay; a notice that repeats goes."""
    page = (
        "<article><h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>flour {0}<li>Salt</ul><h2>Method</h2><p>Stir {0} times.</p>"
        "<p>Serve warm.</p><h2>Papers</h2><ul class=refs><li><a href=/{0}>Paper {0}</a><li><a href=/x{0}>Study {0}</a></ul>"
        "<div class=k><h3>Our letter</h3><p>Write to us for more of this</div></article>"
    )
    wanted = [
        [f"Dish {i}", "Ingredients", f"flour {i}", "Salt", "Method", f"Stir {i} times.", "Serve warm.", "Papers", f"Paper {i}", f"Study {i}"]
        for i in range(6)
    ]
    assert texts_of(spark, [page.format(i) for i in range(6)]) == ["\n\n".join(w) for w in wanted]


def test_template_with_broken_pages(spark):
    """Null, empty and error pages do not turn the removal of wording off."""
    page = "<div class=x><p>T {0} is long enough</p><p>B {0}</div><div class=f>Made with care by all of us</div>"
    found = texts_of(spark, [page.format(i) for i in range(12)] + ["<p>404"])
    assert found == [f"T {i} is long enough\n\nB {i}" for i in range(12)] + ["404"]
    pages = [(i, f"http://h/{i}", page.format(i)) for i in range(6)] + [(9, "http://h/9", None), (8, "http://h/8", "")] * 4
    rows = template.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {
        **{i: f"T {i} is long enough\n\nB {i}" for i in range(6)}, 8: "", 9: ""
    }


def test_template_of_each_layout(spark):
    """Three layouts of a third each have a template each."""
    pages = [
        f"<div class={k}menu><a href=1>Home of all</a></div><div class={k}><p>T {i} is long enough<p>B {i}</div>"
        f"<div class={k}f>Made with care by {k}</div>"
        for i in range(6)
        for k in ("one", "two", "three")
    ]
    assert texts_of(spark, pages) == [f"T {i} is long enough\n\nB {i}" for i in range(6) for _ in range(3)]


def test_damaged_markup():
    page = markup.parse("<ul><li>a<li>b</ul><p>c<p>d<script>x</p></script><!-- e --><td>f &#233; &bogus; &amp")
    assert [b.text for b in page.blocks] == ["a", "b", "c", "d", "f é &bogus; &"]


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<a href=/don't>link</a> Text one.</p><p>It's two.", ["link Text one.", "It's two."]),
        ('<p>a</p><p class="a>bad quote</p>', ["a"]),
        ('<p data-role="notice" data-id=ad>kept', ["kept"]),
        ("<article><section class=discussion><p>kept</section></article>", ["kept"]),
        ("a < b<!---><br/>c<!-- --!>d<script x='</script>'>e</script >f", ["a < b cdf"]),
        ("<p a=>t<p =x>u", ["t", "u"]),
    ],
)
def test_attributes(source, texts):
    page = markup.parse(source)
    assert [b.text for b in page.blocks] == texts and not any(b.around for b in page.blocks)


@pytest.mark.parametrize(
    "piece", ['<a x ', '<a x="', "<a '", "<a x= ", "<!--", "<script>", "<", "</", "<div>", "<div class=q>x", "x</div>"]
)
def test_broken_markup_takes_one_pass(piece):
    started = time.process_time()
    markup.parse('<p x="' + piece * (1_000_000 // len(piece)))
    markup.parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - started < 10


@needs_tables
def test_toxicity_separates(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table("labels")}
    rows = run(spark, "op9_toxicity")
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    clean = [r for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def brute_fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@needs_tables
def test_near_duplicates_against_all_pairs(spark):
    marks = {r["doc_id"]: brute_fingerprint(r["text"]) for r in table("documents")}
    parent = {i: i for i in marks}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    rows = run(spark, "op10_simhash")
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: root(i) for i in ids}


def test_anchors_meet_every_close_pair(spark):
    rng = np.random.default_rng(9)
    low = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    pairs = set()
    for value in low.tolist():
        for bits in range(4):
            change = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
            other = value ^ (change - (1 << 64) if change >> 63 else change)
            if other != value:
                pairs.add((min(value, other), max(value, other)))
    frame = spark.createDataFrame([(v,) for v in {v for p in pairs for v in p}], "fingerprint bigint")
    assert pairs <= {tuple(r) for r in simhash.links(frame).collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 300), (250, 300)]
    roots = simhash.components(spark.createDataFrame(chain, "low bigint, high bigint"))
    found = {r["node"]: r["root"] for r in roots.collect()}
    assert {found[i] for i in range(2, 61)} == {1}
    assert {found[i] for i in range(101, 160)} == {100}
    assert found[300] == found[250] == 200
