"""Main text of web pages by two passes of block rules.

Stop-word density, length and link density classify each block by itself; short
and ambiguous ones then take the label of their nearest decided neighbours.  Both
passes run on every page.  What a page says about itself is one more feature: a
menu, footer, form or advert is bad, and an article element moves the thresholds
of the blocks in it and around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

# Fixed values of the rules: lengths in characters, densities as shares.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.18
LINK_LOW, LINK_HIGH, LINK_ALL = 0.10, 0.33, 0.90

#: Frequent function words.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he are this or his from at which but have an had they you were their one all we can her has there been if more when will would who so no
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder
    de la le et les des en un du une que est pour qui dans par plus au sur pas ne se ce il sont avec son cette ses mais comme ou on aux été leur nous vous elle être
    que el los del se las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde""".split()
)
#: Elements whose content is never text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head template svg canvas object select datalist button audio video math map".split())
#: Elements that hold no part of an article.
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LEAF = frozenset("p li dt dd".split()) | HEADING
#: Words of a class, id or role that mark what isn't article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification alert warning popup modal overlay
    newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion feedback widget toolbar pagination pager copyright legal disclaimer skip hidden contentinfo complementary dialog form teaser outbrain taboola tags""".split()
)
HEADER_MARKS = frozenset("header head".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_UNFINISHED = re.compile(r"</?[a-zA-Z][^>]*\Z")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/]|$)""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    marked: bool
    article: bool
    heading: bool
    marks: tuple[int, ...] = ()  # what marks it: 0 what holds whatever the page, else a container's number
    label: str = ""


def _marks(attributes: str) -> tuple[bool, bool, bool, bool]:
    """(isn't article, is a header, is the article's body, isn't shown)."""
    bad = header = body = unseen = False
    for name, *values in _ATTR.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            unseen = True
        elif name == "style":
            unseen |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "itemprop":
            body |= value.lower() == "articlebody"
        else:
            parts = {p.lower() for p in _PART.findall(value)}
            bad |= bool(parts & MARKS)
            header |= bool(parts & HEADER_MARKS)
            body |= name == "role" and "main" in parts
    return bad or unseen, header, body, unseen


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in page order, with what surrounds each."""
    out: list[Block] = []
    text: list[str] = []
    linked = in_link = 0
    leaf_marked = heading = False
    # open containers: (element, marks, in an article, hidden)
    stack: list[tuple[str, tuple[int, ...], bool, bool]] = [("", (), False, False)]
    containers = 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", unescape("".join(text))).strip()
            if whole and not stack[-1][3]:
                marks = stack[-1][1] + (0,) * leaf_marked
                out.append(Block(whole, linked, bool(marks), stack[-1][2], heading, marks))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(_SPACE.sub(" ", unescape(piece)).strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(_UNFINISHED.sub("", html[at:]))
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not ends and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            if name not in ("noscript",):
                text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if ends else 1
            continue
        if name in ("br", "wbr", "img", "input"):
            if name != "wbr":
                text.append(" ")
            continue
        close()
        if name in VOID:
            continue
        if name in LEAF:
            # a paragraph, item or heading: its marks hold until the next block begins
            leaf_marked = bool(not ends and attributes and _marks(attributes)[0])
            heading = not ends and name in HEADING
            in_link = 0
            continue
        leaf_marked = heading = False
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = 0
            continue
        _, marks, article, hidden = stack[-1]
        bad, header, body, unseen = _marks(attributes) if attributes else (False, False, False, False)
        article = article or name in ARTICLE or body
        if unseen or name in BOILERPLATE and name != "form" or name == "header" and not article:
            marks += (0,)
        elif bad or name == "form" or header and not article:
            containers += 1
            marks += (containers,)
        stack.append((name, marks, article, hidden or name in HIDDEN))
    close()
    return out


def _reads_well(b: Block) -> bool:
    return len(b.text) >= LONG and b.linked <= LINK_HIGH * len(b.text) and _density(b.text) >= STOP_HIGH


def unwrap(found: list[Block]) -> None:
    """Take back the marks of containers around a page's only text.

    While no article, or else no long block of prose, is free of marks, the
    class, id or form that holds the most of such text marks nothing more.
    Outside articles it must hold half of the page's text, as a wrapper does.
    """
    articles = [b for b in found if b.article and 0 not in b.marks]
    prose = [b for b in found if 0 not in b.marks and _reads_well(b)]
    whole = sum(len(b.text) for b in found)
    while articles or prose:
        if any(not b.marked for b in articles + prose):
            return
        size: dict[int, int] = {}
        for b in articles or prose:
            for k in b.marks:
                size[k] = size.get(k, 0) + len(b.text)
        around = max(size, key=lambda k: (size[k], -k))
        if not articles and 2 * sum(len(b.text) for b in found if around in b.marks) < whole:
            return
        for b in found:
            b.marks = tuple(k for k in b.marks if k != around)
            b.marked = bool(b.marks)


def _density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def context_free(b: Block, inside: bool) -> str:
    """First pass, a block by itself: good, bad, near (good) or short.

    inside: it lies in the page's article element, where only short blocks that
    are nearly all links are bad.
    """
    size = len(b.text)
    links = b.linked / size
    if inside and links > LINK_ALL and not b.heading and size < LONG:
        return "bad"
    if not inside and (links > LINK_HIGH or size < LONG and "\xa9" in b.text):
        return "bad"
    if size < SHORT or b.heading:
        return "short"
    density = _density(b.text)
    if density >= STOP_HIGH and size >= LONG:
        return "good"
    return "near" if density >= STOP_LOW or links <= LINK_LOW or inside else "bad"


def _inherited(b: Block, sides: list[tuple[int, str]], inside: bool, outside: bool) -> str:
    """Second pass, an undecided block: sides are the distances and labels of its nearest decided neighbours, left first."""
    labels = {label for _, label in sides}
    if outside:  # the article element lies elsewhere: only what good blocks enclose belongs to it
        return "good" if b.label == "near" and len(sides) == 2 and labels == {"good"} else "bad"
    if inside:
        return "bad" if labels == {"bad"} and b.linked else "good"
    if len(labels) < 2:  # nothing on the page decides: what isn't marked is its text
        return labels.pop() if labels else "good"
    if b.label == "near":
        return "good"
    if b.heading:  # a heading goes with what follows
        return sides[1][1]
    return min(sides, key=lambda s: (s[0], s[1] != "good"))[1]


def classify(found: list[Block]) -> None:
    """Give every block its label, good or bad, in two passes.

    Marked blocks are bad and say nothing about their neighbours: an advert in
    an article leaves the paragraphs beside it alone.
    """
    unwrap(found)
    region = any(b.article and not b.marked for b in found)
    free = []
    for b in found:
        b.label = "bad" if b.marked else context_free(b, region and b.article)
        if not b.marked:
            free.append(b)
        if b.label == "good" and region and not b.article:
            b.label = "near"
    decided = [i for i, b in enumerate(free) if b.label in ("good", "bad")]
    labels = {i: free[i].label for i in decided}
    k = 0
    for i, b in enumerate(free):
        if i in labels:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        sides = [(abs(i - j), labels[j]) for j in decided[max(0, k - 1) : k + 1] if k or j > i]
        b.label = _inherited(b, sides, region and b.article, region and not b.article)


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of each page: the id columns, text, n_chars (code points).

    Blocks are runs of text between block-level tags, white space in them is one
    space, and they are joined by one newline.  A null or empty page, or one
    without an article, gives the empty text.  Null ids and repeated rows are
    kept as they are; an empty table gives an empty one; other columns are
    ignored.  Whole pages are read whatever their length; no shuffle.
    """
    ship(pages.sparkSession)
    names = [*id_cols, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    src = pages.select(*id_cols, F.col(html_col).cast("string").alias("html"))
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in id_cols)
    return src.mapInArrow(run, f"{kinds}, text string, n_chars long")
