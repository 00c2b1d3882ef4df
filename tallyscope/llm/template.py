"""Main text of pages by deducing their hosts' templates from equivalence classes of tokens.

Tokens are the starts and ends of block elements, named by their path, and whole text blocks at
their path. A token's occurrence vector says how often it occurs in each page of its host. Tokens of
a layout with equal vectors form an equivalence class; Spark adds the vectors up as two sums of counts
times a hash of the page, so equal sums mean equal vectors and no vector is ever gathered. A class is
valid if it is large (two tokens or more, as the start and end of one element) and frequent (in half
of the layout's pages). A layout is the pages of a host with the same containers in the body and one
level below; those of less than an eighth of the host's pages (of pages with tokens: null, empty
pages do not count) share the template that all pages of the host give. Valid classes nest as their paths do, which gives the template:

* a class of element tokens opens a slot for what lies directly under its path;
* a text block in WORDING of the pages that have its slot is the template's own wording, if the slot
  is frequent and all that stands at its path repeats; a heading only if the whole container around it,
  with more than headings in it, repeats;
* a slot of mostly linked text is the template's if half of its link texts or more repeat in so many pages;
* what remains in the slots is the page's data.

The article is the slot, with everything nested in it, that an ``article`` or ``main`` element or a
class or id of that meaning marks; without a mark, the slot reached from the top by going down while
one nested slot holds most of the unlinked text. Left out of it, marked or not, are the template's own
wording and slots of links, and by their elements' names menus,
headers, footers, sidebars, notices, adverts, forms and comments. A page without its host's article
slot is read by its own marks; a marked article of nothing but the template's wording keeps its text.

Only per-host sums of tokens in an eighth of the host's pages or more come together, so their number
is bounded by the size of a page; a host may hold any number of pages.

Defined cases: null or empty html gives an empty text; so does a page without an article; pages
without a host in the url share the host ``''``; repeated rows each give a row; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import written
from tallyscope.llm.markup import SINGLE, UNNAMED, Block, Page, parse
from tallyscope.llm.markup import under as _under

FREQUENT = 0.5
KEPT = 0.125
#: A text is the template's wording from this share on of the pages that have its slot.
WORDING = 0.8
#: Fewer pages show no template; a layout of fewer is read by its host's.
LEAST_PAGES = 3
MOST_TEXT = 0.7
LINKED = 0.5
#: A name does not make an element part of the surroundings that holds so much of the host's unlinked text.
HOLDS = 0.5
#: Headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that tell nothing about a page's layout.
NOT_IN_BODY = frozenset("html head title noscript template hr".split())
TOKENS = (
    "host string, layout string, kind string, path string, text string, pages bigint, total bigint, "
    "vector_a bigint, vector_b bigint, chars bigint, linked bigint, article boolean, named boolean, never boolean"
)


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _page_hashes(page_id: object, html: str | None) -> tuple[int, int]:
    whole = xxhash.xxh64_intdigest(f"{page_id}/{html}", 7)
    return whole & 0x3FFFFFFF, whole >> 34


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=12).hexdigest()


def tokens(page: Page) -> dict[tuple[str, str, str], list]:
    """(kind, path, text) -> [count, chars, linked chars, article, named, never]."""
    out: dict[tuple[str, str, str], list] = {}
    for kind, counts in (("open", page.opened), ("close", page.closed)):
        for path, count in counts.items():
            out[kind, path, ""] = [count, 0, 0, path in page.articles, path in page.named, False]
    for block in page.blocks:
        own = out.get(("open", block.path, ""))
        if own is None:
            own = out.setdefault(("open", block.path, ""), [0, 0, 0, False, False, False])
        own[1] += len(block.text)
        own[2] += block.linked
        own[5] = own[5] or block.never
        said = out.setdefault(("text", block.path, _digest(block.text)), [0, 0, 0, False, False, False])
        said[0] += 1
    for kind, said_at in (("block", ((b.path, None) for b in page.blocks)), ("link", page.links)):
        for path, said in said_at:  # how many there are, and how often each link text
            for text in ("",) if said is None else ("", _digest(said)):
                out.setdefault((kind, path, text), [0, 0, 0, False, False, False])[0] += 1
    return out


def layout_of(page: Page) -> str:
    """What tells a page's layout: the containers directly in the body and one level below; '' without any."""
    found = set()
    for path in page.opened:
        steps = path.split(">")[1:]
        steps = steps[1 + next((i for i, s in enumerate(steps) if s.split(".", 1)[0] == "body"), -1) :]
        if 0 < len(steps) <= 2 and not {_tag(s) for s in steps} & (SINGLE | NOT_IN_BODY):
            found.add(path)
    return _digest("\n".join(sorted(found))) if found else ""


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums: dict[tuple, list] = {}
        for page_id, host, html in zip(batch["page_id"], batch["host"], batch["html"], strict=True):
            a, b = _page_hashes(page_id, html)
            page = parse(html)
            found = tokens(page)
            if found:  # pages with tokens are counted, under a kind of their own
                found["page", "", ""] = [1, 0, 0, False, False, False]
            for layout in {"", layout_of(page)}:
                for key, (count, chars, linked, article, named, never) in found.items():
                    row = sums.setdefault((host, layout, *key), [0, 0, 0, 0, 0, 0, False, False, False])
                    row[0] += 1
                    row[1] += count
                    row[2] += count * a
                    row[3] += count * b
                    row[4] += chars
                    row[5] += linked
                    row[6] = row[6] or article
                    row[7] = row[7] or named
                    row[8] = row[8] or never
        names = [c.split()[0] for c in TOKENS.split(", ")]
        yield pd.DataFrame([(*key, *row) for key, row in sums.items()], columns=names)


def _tag(path: str) -> str:
    return path.rsplit(">", 1)[-1].split(".", 1)[0]


def _wording(texts: pd.DataFrame, blocks: pd.DataFrame, slots_of: dict[str, int], pages: int) -> pd.DataFrame:
    """Texts that repeat with all that stands at their path; headings only with the container around them."""
    slot = texts["path"].map(slots_of)
    often = texts[(slot >= max(LEAST_PAGES, FREQUENT * pages)) & (texts["pages"] >= WORDING * slot)]
    held = dict(zip(blocks["path"], blocks["total"], strict=True))
    said = often.groupby("path")["total"].sum()
    whole = {p for p, n in said.items() if n >= WORDING * held[p]}
    headings = {p for p in whole if _tag(p) in HEADINGS}
    parents = {p: p.rsplit(">", 1)[0] for p in headings}
    repeat = {
        parent
        for parent in set(parents.values())
        if all(p in whole for p in held if _under(p, parent))
        and any(p in whole and p not in headings for p in held if _under(p, parent))
    }
    return often[often["path"].isin(whole - {p for p in headings if parents[p] not in repeat})]


def _repeated_links(links: pd.DataFrame, slots_of: dict[str, int]) -> set[str]:
    """Paths where half of the links or more have a text that the slot's pages repeat."""
    held = dict(zip(links.loc[links["text"] == "", "path"], links.loc[links["text"] == "", "total"], strict=True))
    often = links[(links["text"] != "") & (links["pages"] >= WORDING * links["path"].map(slots_of))]
    return {p for p, n in often.groupby("path")["total"].sum().items() if n >= LINKED * held[p]}


def deduce(rows: pd.DataFrame, pages: int) -> tuple[list[str], ...]:
    """From the tokens of a layout of a host: article slots, slots of links, the template's own wording, and freed names."""
    rows = rows.sort_values(["path", "kind", "text"], kind="stable")
    counts = rows[rows["kind"].isin(["block", "link"])]
    rows = rows.drop(counts.index)
    classes = rows.groupby(["vector_a", "vector_b", "total", "pages"])["path"].transform("size")
    valid = (classes >= 2) & (rows["pages"] >= FREQUENT * pages)
    elements = rows[rows["kind"] == "open"]
    template = set(rows.loc[valid & (rows["kind"] != "text"), "path"])
    slots_of = dict(zip(elements["path"], elements["pages"], strict=True))
    wording = _wording(rows[rows["kind"] == "text"], counts[counts["kind"] == "block"], slots_of, pages)
    marked = sorted(elements.loc[elements["article"] & elements["path"].isin(template), "path"], key=len)
    slots = [p for p in marked if p.rsplit(">", 1)[-1].startswith("article")]
    slots = slots or [p for p in marked if not any(q != p and _under(p, q) for q in marked)]
    read = elements[~elements["never"]]
    unlinked = dict(zip(read["path"], read["chars"] - read["linked"], strict=True))
    named = set(elements.loc[elements["named"], "path"])
    freed = {n for n in named if sum(c for p, c in unlinked.items() if _under(p, n)) > HOLDS * sum(unlinked.values())}
    around = [p for p in read["path"] if any(_under(p, n) for n in named - freed)]
    plain = read[~read["path"].isin(around)]
    text = dict(zip(plain["path"], plain["chars"] - plain["linked"], strict=True))
    if not slots and text:
        here = ""
        while True:
            inside = sum(n for p, n in text.items() if _under(p, here) or not here)
            sums = {
                slot: sum(n for p, n in text.items() if _under(p, slot))
                for slot in template
                if slot.startswith(here + ">")
                and ">" not in slot[len(here) + 1 :]
                and re.split(r"[>.]", slot[len(here) + 1 :])[0] not in SINGLE
            }
            best = max(sorted(sums), key=sums.__getitem__, default=None)
            if best is None or sums[best] < MOST_TEXT * inside or not sums[best]:
                break
            here = best
        slots = [here]
    links = elements[(elements["chars"] > 0) & (elements["linked"] > LINKED * elements["chars"])]
    links = links[~links["path"].map(_tag).isin(UNNAMED)]
    links = links[links["path"].isin(_repeated_links(counts[counts["kind"] == "link"], slots_of))]
    if marked:  # inside a mark only the template decides, and two pages show none
        links = links[links["path"].isin(template)] if pages >= LEAST_PAGES else links[:0]
    return (
        slots,
        sorted(links["path"]),
        sorted(p + "\t" + t for p, t in zip(wording["path"], wording["text"], strict=True)),
        sorted(freed),
    )


def templates(pages: DataFrame) -> DataFrame:
    """host and ``known``: layout, slots, links, wording and freed of each template of the host.

    A layout with an eighth of the host's pages has a template of its own; '' is that of all its pages.
    """
    counted = written(
        pages.select("page_id", "host", "html")
        .mapInPandas(_count, TOKENS)
        .groupBy("host", "layout", "kind", "path", "text")
        .agg(
            *(F.sum(c).alias(c) for c in ("pages", "total", "vector_a", "vector_b", "chars", "linked")),
            F.max("article").alias("article"),
            F.max("named").alias("named"),
            F.max("never").alias("never"),
        ),
        "page-tokens",
    )
    sizes = counted.where("kind = 'page'").select("host", "layout", F.col("pages").alias("layout_pages"))
    whole = sizes.where("layout = ''").select("host", F.col("layout_pages").alias("host_pages"))
    sizes = sizes.join(whole, "host").where(
        (F.col("layout") == "") | (F.col("layout_pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("host_pages") * KEPT))
    )
    rows = (
        counted.where("kind <> 'page'")
        .join(sizes.drop("host_pages"), ["host", "layout"])
        .where(F.col("pages") >= F.col("layout_pages") * KEPT)
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = deduce(group, int(group["layout_pages"].iloc[0]))
        return pd.DataFrame([(*key, *found)], columns=["host", "layout", "slots", "links", "wording", "freed"])

    known = rows.groupBy("host", "layout").applyInPandas(
        run,
        "host string, layout string, slots array<string>, links array<string>, wording array<string>, freed array<string>",
    )
    return known.groupBy("host").agg(
        F.collect_list(F.struct("layout", "slots", "links", "wording", "freed")).alias("known")
    )


def main_blocks(page: Page, slots: list[str], links: set[str], wording: set[str], freed: set[str]) -> list[Block]:
    """The blocks of the page's article, in page order."""
    named = page.named - freed

    def kept(candidates: list[Block], deduced: bool = True) -> list[Block]:
        return [
            b
            for b in candidates
            if not b.never
            and not (b.around and any(_under(b.path, n) for n in named))
            and not (deduced and (b.path in links or f"{b.path}\t{_digest(b.text)}" in wording))
        ]

    inside = [b for b in page.blocks if any(_under(b.path, s) for s in slots)]
    own = [b for b in page.blocks if any(_under(b.path, a) for a in page.articles)]
    # a marked article that the template would leave without any text is a copy, and keeps it
    return kept(inside) or kept(own) or (kept(own, False) if own else kept(page.blocks))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of())
    known = written(templates(pages), "page-templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, dict[str, tuple]] = {}
        for batch in batches:
            texts = []
            for host, html, known in zip(batch["host"], batch["html"], batch["known"], strict=True):
                if host not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[host] = {
                        t["layout"]: (list(t["slots"]), *(set(t[c]) for c in ("links", "wording", "freed")))
                        for t in ([] if known is None else known)
                    }
                page = parse(html)
                found = cache[host].get(layout_of(page)) or cache[host].get("", ([], set(), set(), set()))
                texts.append("\n\n".join(b.text for b in main_blocks(page, *found)))
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(known, "host", "left").mapInPandas(
        run, f"page_id {kind}, url string, text string, n_chars bigint"
    )
