"""The main text of web pages from flat text blocks.

A page is cut into blocks at the elements that start a new line. Every block has its number
of words and share of linked words, those of the block before and after, and marks of the
elements around it. A decision tree, grown from a small table of labelled blocks, says
which blocks belong to the article; their texts are joined in the order of the page.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.arrow import map_rows

# Elements of HTML by what they do to the text.
LINES = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("audio button canvas datalist map math meter noscript object progress select svg template video".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BREAKS = frozenset("br hr wbr img input".split())
FURNITURE = frozenset("aside dialog footer menu nav search".split())
#: What an element ends when it begins: the tags it closes, and those the search does not leave.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
#: Names of classes, ids and roles that stand for something beside the article, or for it.
BESIDE = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo "
    "cookie cookies discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination "
    "popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar widget".split()
)
ARTICLE = frozenset("article articlebody content entry main post story".split())
#: With one of these, a name like "content-sidebar-wrap" tells how a page is laid out, not what it holds.
LAYOUT = frozenset("container has layout no page row with wrap wrapper".split())

_TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)?)*+)>?|[!?/][^>]*+>?)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"']++)))?")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    furniture: int  # 1 inside a form, 2 inside another element beside the article
    beside: int
    article: int
    heading: int


class _Inside(NamedTuple):
    """What is known inside an element."""

    tag: str
    unseen: bool = False
    furniture: int = 0
    beside: int = 0
    article: int = 0


def _enter(outer: _Inside, tag: str, attributes: dict[str, str]) -> _Inside:
    """What is known inside an element with these attributes."""
    names = {n.lower() for key in ("class", "id", "role", "itemprop") if key in attributes for n in _NAME.findall(attributes[key])}
    _, unseen, furniture, beside, article = outer
    if tag == "main" or tag == "article" and furniture == 1:
        furniture = 0
    if tag in FURNITURE or tag == "header" and not article:
        furniture = 2
    elif tag == "form":
        furniture = max(furniture, 1)
    if tag == "main":
        beside = 0
    elif tag not in ("html", "body") and names & BESIDE and not names & LAYOUT:
        beside = 1
    if tag in ("article", "main") or names & ARTICLE and tag not in ("html", "body") and not names & BESIDE:
        article = 1
    unseen = unseen or tag in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
    return _Inside(tag, unseen, furniture, beside, article)


def blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order, in one pass over the whole text.

    Character references are decoded, white space becomes one space; comments, scripts,
    styles, controls, and elements that are not shown give no text. Elements that are left
    open end where their parent ends.
    """
    stack, open_tags = [_Inside("")], Counter()
    parts: list[str] = []
    linked: list[str] = []
    link = 0  # depth of the stack inside which a link is open
    at = 0

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    def flush(heading: bool) -> Iterator[Block]:
        text = " ".join("".join(parts).split())
        if text:
            inside = stack[-1]
            yield Block(text, text.count(" ") + 1, len("".join(linked).split()), inside.furniture, inside.beside, inside.article, int(heading))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        if text and not stack[-1].unseen:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked.append(text)

    while (found := _TOKEN.search(page, at)) is not None:
        say(page[at : found.start()])
        at = found.end()
        closing, tag, rest = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
        elif tag == "a":
            link = 0 if closing else len(stack)
            if linked:
                linked.append(" ")
        elif tag in BREAKS:
            if tag == "hr":
                yield from flush(any(open_tags[h] for h in HEADINGS))
            elif tag == "br":
                say(" ")
        elif tag in LINES or tag in UNSEEN:
            if tag in LINES:
                yield from flush(any(open_tags[h] for h in HEADINGS))
            if closing:
                if open_tags[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            else:
                if tag in LINES and open_tags["p"] and stack[-1].tag == "p":
                    pop()
                if tag in ENDS:
                    ended, bounds = ENDS[tag]
                    if any(open_tags[t] for t in ended):
                        for depth in range(len(stack) - 1, 0, -1):
                            if stack[depth].tag in bounds:
                                break
                            if stack[depth].tag in ended:
                                while len(stack) > depth:
                                    pop()
                                break
                if not (tag in UNSEEN and rest.endswith("/")):
                    attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
                    stack.append(_enter(stack[-1], tag, attributes))
                    open_tags[tag] += 1
            if link > len(stack):
                link = 0
    say(page[at:])
    yield from flush(any(open_tags[h] for h in HEADINGS))


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "beside", "article", "heading")


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """``FEATURES`` of every block of a page; beyond its ends there are empty blocks."""
    shallow = [(0, 0.0), *((b.words, b.linked / b.words) for b in page), (0, 0.0)]
    return [(*shallow[i + 1], *shallow[i], *shallow[i + 2], b.furniture, b.beside, b.article, b.heading) for i, b in enumerate(page)]


# Labelled blocks of made-up pages, one page a paragraph. A line is the label (1: article), the
# elements around the block with their class names, its words and its linked words.
LABELLED = """
0 header/div.logo 2 2
0 nav/ul/li 1 1
0 nav/ul/li 2 2
0 nav/ul/li 1 1
0 div.ad 9 0
1 article/h1 8 0
1 article/p 64 0
1 article/p 3 0
1 article/p 118 4
0 footer 14 1

0 nav/ul/li 1 1
0 nav/ul/li 1 1
0 div.ad 31 0
1 article/h1 61 0
1 article/p 1 0
1 article/p 1 0
0 footer 22 0

0 nav/li 1 1
0 div.ad 4 0
1 article/h1 1 0
1 article/p 1 0
0 footer 5 0

0 div.navbar/a 1 1
0 div.cookie-notice/p 34 1
0 header/h1 3 3
1 main/h1 11 0
1 main/p 45 0
1 main/h2 2 0
1 main/ul/li 6 0
1 main/ul/li 4 0
1 main/p 88 9
1 main/table/td 1 0
1 main/table/td 2 0
0 aside/h3 2 0
0 aside/p 42 3
0 footer/p 18 4

0 div.menu/li 2 2
0 div.menu/li 1 1
1 div.post/h2 7 7
1 div.post/p 52 2
1 div.post/blockquote 30 0
1 div.post/p 21 0
0 div.post/div.share 4 4
0 div.comments/h3 2 0
0 div.comments/p 37 0
0 div.comments/p 9 0
0 div.comments/form/label 3 0

0 td 1 1
0 td 2 2
0 td 2 2
0 td 5 0
1 h1 6 0
1 p 71 1
1 p 9 0
1 p 95 0
1 h2 3 0
1 p 40 2
0 td 3 3
0 td 12 5
0 td 6 0

0 div 2 2
0 div 3 3
0 div 1 1
1 div 26 0
1 div 58 3
1 div 7 0
1 div 33 0
0 div 8 8
0 div 9 9
0 div 7 7
0 div 4 0

0 p 3 3
0 p 7 0
0 p 2 2
0 p 5 0
0 h3 2 0
0 p 6 6
0 p 11 11
0 h3 3 0
0 p 9 8
0 p 4 0

0 header/nav/li 1 1
0 form/label 2 0
0 form/p 25 0
0 form/div 6 0
1 article/header/h1 9 0
0 article/div.byline 5 1
1 article/section/p 77 0
1 article/section/h3 4 0
1 article/section/pre 24 0
1 article/figure/figcaption 12 0
0 article/aside/p 28 1
1 article/p 33 33
1 article/ol/li 15 2
0 article/nav/li 4 4
0 article/nav/li 5 5
0 article/footer/p 7 3
0 section.related/h2 2 0
0 section.related/article/h3 8 8
0 section.related/article/p 24 0

0 div.alert/p 19 0
0 div.breadcrumb/li 1 1
1 div.content/h1 4 0
1 div.content/div 83 6
1 div.content/div 14 0
0 div.sidebar/p 51 0
0 div.sidebar/ul/li 6 6
0 div.newsletter/p 16 0
0 section.comments/article/p 66 0
0 section.comments/article/p 5 0
0 div.footer/p 30 8

0 dialog/p 40 2
0 menu/li 2 2
1 main/p 17 0
1 main/p 2 0
0 main/ul/li 3 3
0 main/ul/li 5 5
0 main/ul/li 4 4
1 main/p 49 0
0 div.widget/p 22 0
0 footer/div 55 10

0 div.ad 160 0
0 div.sponsor 75 0
1 h1 5 0
1 p 62 0
1 p 180 12
0 div.ad 61 0
1 p 59 0
0 div.comments/p 210 0
0 div.comments/p 64 0
0 aside/p 140 0
0 form/p 90 0
0 footer/p 240 0
0 footer/p 70 2

0 header/p 66 0
0 nav/p 80 3
1 article/h1 12 0
1 article/p 260 0
0 article/div.ad 58 0
1 article/p 19 4
1 article/p 12 3
1 article/p 30 11
0 article/ul/li 6 6
0 article/ul/li 9 9
0 article/ul/li 13 13
0 article/section.comments/p 130 0
0 article/section.comments/p 22 0
0 footer/p 110 0

0 div 1 1
0 div 2 0
1 div 74 0
1 div 130 30
1 div 60 2
0 div 64 60
0 div 70 70
0 div 90 81
0 div.notice 120 0
0 div.modal 85 0
0 form/div 70 0
0 form/div 66 5
0 footer/div 300 0

0 header/div.logo 1 1
0 div.banner 72 0
1 article/p 68 0
1 article/p 1 0
1 article/p 2 0
0 article/p 2 2
0 article/p 3 3
0 article/aside 77 0
1 article/p 90 0
0 section.related/p 63 10
0 footer 61 0

1 article/p 58 0
0 form/div 3 0
0 form/p 80 0
0 form/div 2 0
0 form/p 45 0
0 form/p 4 0
0 div.comments/p 55 0
0 div.comments/p 3 0
0 footer/p 60 0
0 footer/p 2 0
"""


def labelled_blocks() -> list[tuple[tuple[float, ...], int]]:
    """Features and labels of ``LABELLED``."""
    out = []
    for page in LABELLED.strip().split("\n\n"):
        listed, labels = [], []
        for line in page.split("\n"):
            label, path, words, linked = line.split()
            inside = _Inside("")
            for element in path.split("/"):
                tag, _, names = element.partition(".")
                inside = _enter(inside, tag, {"class": names})
            listed.append(Block("", int(words), int(linked), inside.furniture, inside.beside, inside.article, int(path.rsplit("/")[-1] in HEADINGS)))
            labels.append(int(label))
        out.extend(zip(features(listed), labels))
    return out


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 8) -> tuple | int:
    """A decision tree by the Gini index: (feature, limit, tree at or below it, tree above it), or a label.

    Ties go to the feature and limit that come first, so the same rows give the same tree.
    """
    ones = sum(y for _, y in rows)
    best, cut = ones * (len(rows) - ones) / max(len(rows), 1), None
    for f in range(len(rows[0][0]) if rows and depth else 0):
        ordered = sorted((x[f], y) for x, y in rows)
        left_ones = 0
        for n, ((a, y), (b, _)) in enumerate(zip(ordered, ordered[1:]), 1):
            left_ones += y
            if a < b:
                right, right_ones = len(rows) - n, ones - left_ones
                impurity = left_ones * (n - left_ones) / n + right_ones * (right - right_ones) / right
                if impurity < best - 1e-9:
                    best, cut = impurity, (f, (a + b) / 2)
    if cut is None:
        return int(2 * ones > len(rows))
    f, limit = cut
    return f, limit, grow([r for r in rows if r[0][f] <= limit], depth - 1), grow([r for r in rows if r[0][f] > limit], depth - 1)


@functools.cache
def default_tree() -> tuple | int:
    return grow(labelled_blocks())


def _label(tree: tuple | int, values: tuple[float, ...]) -> int:
    while isinstance(tree, tuple):
        feature, limit, below, above = tree
        tree = below if values[feature] <= limit else above
    return tree


def article(page: str | None, tree: tuple | int) -> str:
    """The blocks of a page that the tree takes for the article, one a line."""
    listed = list(blocks(page)) if page else []
    return "\n".join(b.text for b, values in zip(listed, features(listed)) if _label(tree, values))


def extract(pages: DataFrame, tree: tuple | int | None = None, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys …, text, n_chars): the main text of every page and its length in code points.

    A page that is null, empty or without an article has an empty text. Every row is
    answered for itself: keys may be null or repeated, further columns are not looked at.
    """
    known = default_tree() if tree is None else tree
    names = [f"k{i}" for i in range(len(keys))]

    def run(columns):
        for row in zip(*(columns[n] for n in names), columns["page"]):
            text = article(row[-1], known)
            yield *row[:-1], text, len(text)

    listed = pages.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(html).alias("page"))
    kinds = ", ".join(f"{n} {pages.schema[k].dataType.simpleString()}" for k, n in zip(keys, names))
    return map_rows(listed, run, f"{kinds}, text string, n_chars long", 256, slice_rows=256).toDF(*keys, "text", "n_chars")
