"""Reading of HTML text, however damaged, as text blocks under paths of block elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Attributes: quotes count only after "=", and one left open runs to the end of the input. All repeats
# are possessive and every branch goes on from where it stops, so reading takes one pass.
_VALUE = r"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>]*+))"
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_GAP = r"[ \t\n\f\r]*+"
_ATTRIBUTES = rf"(?:[ \t\n\f\r/]*+{_NAME}(?:{_GAP}={_GAP}{_VALUE.replace('([', '(?:[')})?+)*+[ \t\n\f\r/]*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(script|style)(?=[ \t\n\f\r/>]|\Z){_ATTRIBUTES}(?:>.*?(?:</\1(?=[ \t\n\f\r/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)({_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_GAP}={_GAP}{_VALUE})?+")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements nested deeper than this follow one another, as browsers have it.
DEEPEST = 512
#: Element names.
BLOCKS = frozenset(
    "html head body title header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address form fieldset details "
    "summary hr dialog menu noscript template svg iframe button select textarea object search hgroup".split()
)
VOID = frozenset("br hr img input meta link wbr source track area base col embed".split())
#: Elements that are never the article's text.
NEVER = frozenset(
    "head title nav footer aside form noscript template svg iframe button select textarea object dialog menu search".split()
)
#: Words in class, id or role that mark what is around an article; inside one, as whole
#: values of class, id or role only.
AROUND = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets ad ads adv advert "
    "adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing footer masthead copyright comment comments reply replies disqus respond discussion "
    "related recommended recommendations pagination pager toolbar search contentinfo complementary".split()
)
#: Elements whose names say nothing: the page's own and headings; inside an article also
#: those that hold single texts.
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6 hgroup".split())
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption address summary".split())
#: Names inside an article that are as often those of its own parts.
SLUGS = frozenset("discussion".split())
#: The same for the head of a page, outside an article only.
HEAD = frozenset("header topbar".split())
#: Whole class, id or role values that mark an article.
ARTICLE = frozenset("article main content post entry story articlebody postbody maincontent".split())
#: An element closes these open ones when it starts.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "body": ("head", "title"),
}


@dataclass
class Block:
    path: str
    text: str
    linked: int  # characters inside links
    around: bool  # in an element of ``named`` of its page
    never: bool  # inside an element that is never the article


@dataclass
class _Open:
    tag: str
    path: str
    article: bool
    names: tuple[str, ...]  # it and those around it whose names say that they are not the article
    never: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)  # path and text of each link
    opened: dict[str, int] = field(default_factory=dict)
    closed: dict[str, int] = field(default_factory=dict)
    articles: set[str] = field(default_factory=set)  # paths that are marked as an article
    named: set[str] = field(default_factory=set)  # paths whose class, id or role says they are not the article


def under(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + ">")


def _wholes(values: list[str]) -> set[str]:
    return {re.sub(r"[^a-z]", "", w.lower()) for v in values for w in v.split()}


def _named(attributes: str) -> list[tuple[str, str]]:
    """class, id and role with their values."""
    found = ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))
    return [(name, value) for name, value in found if name in ("class", "id", "role")]


def _spoken(named: list[tuple[str, str]], tag: str) -> set[str]:
    """Whole values that tell what an element inside an article is; ids of sections are its headings'."""
    told = [value for name, value in named if not (name == "id" and tag == "section")]
    return _wholes(told) - SLUGS


def parse(text: str | None) -> Page:
    """Blocks in page order: white space in a block is one blank, references are decoded."""
    page = Page()
    stack = [_Open("", "", False, (), False)]
    marks: list[tuple[str, tuple[str, ...]]] = []  # marked paths, with the names around them
    parts: list[str] = []
    linked: list[str] = []
    link: list[str] = []
    in_link = False

    def end_link() -> None:
        nonlocal link
        if link:
            said = " ".join(html.unescape("".join(link)).split())
            if said:
                page.links.append((stack[-1].path, said))
            link = []

    def flush() -> None:
        nonlocal parts, linked
        end_link()
        if parts:
            content = " ".join(html.unescape("".join(parts)).split())
            if content:
                top = stack[-1]
                inside = len(" ".join(html.unescape("".join(linked)).split()))
                page.blocks.append(Block(top.path, content, inside, bool(top.names), top.never))
            parts, linked = [], []

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            path = stack.pop().path
            page.closed[path] = page.closed.get(path, 0) + 1

    source, at = text or "", 0
    for match in _TOKEN.finditer(source):
        if match.start() > at:
            piece = source[at : match.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
                link.append(piece)
        at = match.end()
        tag = (match[3] or "").lower()
        if not tag:
            continue
        ends = bool(match[2])
        if tag not in BLOCKS:
            if tag == "a":
                end_link()
                in_link = not ends
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if ends:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        while stack[-1].tag in CLOSES.get(tag, ()):
            close(len(stack) - 1)
        if len(stack) > DEEPEST:
            close(DEEPEST)
        top = stack[-1]
        attributes = _named(match[4] or "")
        values = [value for _, value in attributes]
        words = {w.lower() for v in values for w in _WORDS.findall(v)}
        label = tag + "".join("." + re.sub(r"\d+", "", v) for v in values)
        whole = _wholes(values)
        article = top.article or tag in ("article", "main") or bool(whole & ARTICLE)
        path = f"{top.path}>{label}"
        never = top.never or tag in NEVER or tag == "header" and not top.article
        if top.article:
            named = tag not in SINGLE and bool(_spoken(attributes, tag) & AROUND)
        else:
            word = words & AROUND or words & HEAD and "site" in words
            named = tag not in UNNAMED and bool(whole & (AROUND | HEAD) or word and not article)
        names = top.names
        if named:
            names = (*names, path)
            page.named.add(path)
        if not never and (tag == "article" or article and not top.article):
            marks.append((path, names))
        page.opened[path] = page.opened.get(path, 0) + 1
        stack.append(_Open(tag, path, article, names, never))
    if at < len(source):
        parts.append(source[at:])
    flush()
    if marks and all(names for _, names in marks):  # no name hides the article
        _, around = max(marks, key=lambda m: sum(len(b.text) - b.linked for b in page.blocks if under(b.path, m[0]) and not b.never))
        page.named.difference_update(around)
    page.articles = {path for path, names in marks if page.named.isdisjoint(names)}
    for block in page.blocks:
        block.around = block.around and any(under(block.path, n) for n in page.named)
    return page
