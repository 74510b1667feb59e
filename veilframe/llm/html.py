"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text in page order, each with its path of tags from the root. Parts
that are not text of an article by their element or role are left aside, and those that are none by a
word of their class or id, and forms, unless they hold the page's article or most of its text. Over the other
blocks, the length of text outside links and the number of punctuation marks are added up per
path and divided by the blocks of the path; both ratios are smoothed along the page, fused, and
paths whose mean stays under a share of the page's level are dropped. The element that holds
nearly all the text of the chosen paths is the article: its other blocks that are not lists of
links belong to it, such as headings. A projection of rows: no shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from veilframe.llm.common import map_texts

#: A path is content from this share of the page's level on.
SHARE = 0.2
#: The article is the innermost element with this share of the chosen text.
COVER = 0.85
#: An element is left aside for a word in its class or id, or as a form, only below this share of the page's text outside links.
LARGE = 0.5
#: An article or main with this share of it is the page's; then only what holds it, or most text inside it, is not left aside.
OWN = 0.2
#: More text than this in links makes a block a list of links.
LINKS = 0.6

# Elements by their part in a page.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|video|audio|canvas|select|title|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav footer aside form button dialog menu head fieldset datalist".split())
WHOLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "alert alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "footer footers masthead comment comments commentlist disqus discussion reply replies respond share sharing social related recommended recommendations "
    "widget widgets pagination pager toolbar skip search"
).split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？।¿¡«»]")

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|[^>]*+>)|<[!?][^>]*+>|</[^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """Text between two block boundaries; `path` is the number of its path of tags."""

    path: int
    within: tuple[int, ...]
    text: str
    plain: int
    aside: bool
    doubtful: tuple[int, ...] = ()
    wholes: tuple[int, ...] = ()
    chosen: bool = False


def _set_aside(tag: str, rest: str, inside_article: bool) -> bool | None:
    """Whether an element is not part of an article, by its name and attributes; None if only a word says so or it is a form."""
    if tag in ASIDE and tag != "form" or tag == "header" and not inside_article:
        return True
    doubtful = tag == "form"
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("html", "body", *WHOLE) and not WORDS.isdisjoint(SPLIT.split(value)):
            doubtful = True
    return None if doubtful else False


def blocks_of(page: str) -> Iterator[Block]:
    # tag, number, set aside, path, inside an article, may have to be set aside
    stack: list[tuple[str, int, bool, int, bool, bool]] = []
    parts: list[str] = []
    plain: list[str] = []
    paths: dict[tuple[int, str], int] = {}
    number, links = 0, 0

    def ended() -> Iterator[Block]:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks = [s for s in stack if s[0] not in INLINE]
                yield Block(blocks[-1][3] if blocks else 0, tuple(s[1] for s in blocks), text, len(" ".join(unescape("".join(plain)).split())), bool(stack) and stack[-1][2], tuple(s[1] for s in stack if s[5]), tuple(s[1] for s in stack if s[0] in WHOLE))
            parts.clear()
            plain.clear()

    def said(text: str) -> None:
        if text:
            parts.append(text)
            plain.append(" " if links else text)

    def pop_to(depth: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[depth:])
        del stack[depth:]

    at, end = 0, page.rfind(">") + 1
    for m in MARKUP.finditer(page, 0, end):
        said(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group().startswith("<![CDATA["):
                said(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            elif m.group("raw"):
                yield from () if stack and stack[-1][0] in INLINE else ended()
            continue
        tag = tag.lower()
        if m.group("close"):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if tag not in INLINE:
                    yield from ended()
                elif any(s[0] not in INLINE for s in stack[depth:]):
                    continue  # an inline end tag does not close blocks
                pop_to(depth)
            continue
        if tag in VOID:
            if tag == "hr":
                yield from ended()
            elif tag == "br":
                said("\n")
            continue
        if tag not in INLINE:
            yield from ended()
            if stack:
                open_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
                if open_p >= 0 and stack[open_p][0] == "p":
                    pop_to(open_p)  # a block ends a paragraph
                if tag in CLOSES:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in CLOSES[tag]:
                            pop_to(i)
                            if tag != "tr":
                                break
                        elif stack[i][0] in STOPS.get(tag, ()):
                            break
        number += 1
        rest = m.group("rest")
        _, _, above_aside, above, inside, _ = stack[-1] if stack else ("", 0, False, 0, False, False)
        own = _set_aside(tag, rest, inside)
        aside = above_aside or bool(own)
        if not rest.endswith("/>") or tag in INLINE and tag != "a":
            path = above if tag in INLINE else paths.setdefault((above, tag), len(paths) + 1)
            stack.append((tag, number, aside, path, inside or tag in WHOLE, own is None))
            links += tag == "a"
    said(page[at:end])
    said(re.split(r"<(?=[a-zA-Z/!?])", page[max(at, end):], maxsplit=1)[0])  # without a tag that never ends
    yield from ended()


def _smoothed(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * values[i] + values[min(n - 1, i + 1)]) / 4 for i in range(n)]


def _decide(blocks: list[Block]) -> None:
    """Leave aside what stands in a doubtful element, unless this holds the page's article or most of its text."""
    rest = [b for b in blocks if not b.aside]
    if not any(b.doubtful for b in rest):
        return
    total, of_doubtful, of_whole, around = 0, defaultdict(int), defaultdict(int), {}
    for b in rest:
        total += b.plain
        for e in b.doubtful:
            of_doubtful[e] += b.plain
        for e in b.wholes:
            of_whole[e] += b.plain
            around[e] = frozenset(d for d in b.doubtful if d < e)  # numbers grow inwards
    own = max(of_whole, key=of_whole.__getitem__, default=None)
    if own is not None and of_whole[own] >= OWN * total:
        kept = {*around[own], *(e for b in rest if own in b.wholes for e in b.doubtful if of_doubtful[e] >= LARGE * total)}
    else:
        kept = {e for e, n in of_doubtful.items() if n >= LARGE * total}
    for b in rest:
        b.aside = not kept.issuperset(b.doubtful)


def choose(blocks: list[Block]) -> None:
    """Mark the blocks of the article."""
    _decide(blocks)
    rest = [b for b in blocks if not b.aside]
    if not rest:
        return
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in rest:
        length[b.path] += b.plain
        marks[b.path] += len(PUNCTUATION.findall(b.text)) if b.plain else 0
        count[b.path] += 1
    by_length = _smoothed([length[b.path] / count[b.path] for b in rest])
    by_marks = _smoothed([marks[b.path] / count[b.path] for b in rest])
    fused = [(x * (1 + y)) ** 0.5 for x, y in zip(by_length, by_marks)]
    of_path: dict[int, list[float]] = defaultdict(list)
    for b, f in zip(rest, fused):
        of_path[b.path].append(f)
    total = sum(b.plain for b in rest)
    level = sum(f * b.plain for b, f in zip(rest, fused)) / total if total else 0.0
    good = {p for p, fs in of_path.items() if length[p] and sum(fs) / len(fs) >= SHARE * level}
    held: dict[int, int] = defaultdict(int)
    for b in rest:
        b.chosen = b.path in good and b.plain >= (1 - LINKS) * len(b.text)
        if b.chosen:
            for e in b.within:
                held[e] += len(b.text)
    whole = sum(len(b.text) for b in rest if b.chosen)
    article = max((e for e, n in held.items() if n >= COVER * whole), default=None)  # numbers grow inwards
    for b in rest:
        if article in b.within and b.plain >= (1 - LINKS) * len(b.text):
            b.chosen = True


def main_text(page: str | None) -> str:
    """The blocks of the article in page order, two line ends between them; empty if there are none."""
    blocks = list(blocks_of(page or ""))
    choose(blocks)
    return "\n\n".join(b.text for b in blocks if b.chosen)


def extract(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html", out: str = "main_text") -> DataFrame:
    """The keys and the main text of each page.

    Character references are decoded and white space in a block is one blank. Null and empty pages
    and pages without text give an empty text; broken markup is read as far as it goes; repeated
    rows are read alike; other columns are ignored.
    """

    def make():
        return lambda pages: [pa.array([main_text(p) for p in pages], pa.string())]

    return map_texts(df, keys, html, [T.StructField(out, T.StringType())], make)
