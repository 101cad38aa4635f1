"""Main text of web pages by scores passed up the tree of elements.

A page becomes a tree (end tags that authors leave out are implied). Every paragraph passes points, one and one for each
comma and for each 100 characters up to three, to the containers above it: all to the first, half to the second, a third of
that and less to the next ones. A container's score is its points times one less its link density. The best container
is kept, with the siblings whose score is near it, sentences beside it and, if it lies within an `article` or `main`
element, all of that. If there are such elements with text, only they and what they hold are containers.

Before that, what is no article goes: elements by name (`nav`, `aside`, `footer`, scripts, styles, forms' fields), by
role, by the words of their class and id (menus, notices, adverts, comments), and hidden ones. An element that goes by its words
stays if it holds the `main` or an `article` element, a form if it holds most of the page's text, a header if it is the article's own with
its heading. Lists in which nearly all text is of links are menus.

A block is the text between two starts or ends of block elements. Character references are decoded; white space (as Unicode has
it, so no-break spaces too) inside a block becomes one space; a `br` is white space. Blocks are joined in page order by one line end. Pages are
independent rows, each parsed in time linear in its length, so there is no shuffle.

Defined cases: a null or empty page, or one without text, has the empty text; text without any element is one block;
open comments, tags and scripts reach to the end of the page; very long or deep pages are parsed without recursion; repeated rows give a row
each; nothing is cut; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256  # pages parsed before their texts are handed on
LEVELS = 5  # ancestors that get points of a paragraph
NEAR = 0.2  # share of the best score from which a sibling is kept
MENU_LINKS, MENU_DENSITY, MENU_LENGTH = 3, 0.8, 40  # a list with more short links than text

# Names and words of HTML pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript noembed noframes xmp".split())
GONE = set("head nav aside footer button select datalist dialog menu template object canvas audio video svg math map".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
INNER = set("li dt dd td th caption ul ol dl table tbody thead tfoot tr legend summary".split())
LISTS = set("ul ol dl table div section p".split())
WALLS = set("td th table caption button object template".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = set("ad ads banner banners breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus dropdown footer gdpr header masthead menu menus modal nav navbar navigation notice notices notification notifications overlay pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
STARTS = ("advert", "cookie", "newsletter", "sidebar", "sponsor", "subscri", "breadcrumb", "comment", "promot", "navig")
CLOSES = {  # start tag: the open elements that it ends, and those that it does not reach through
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<(?=[a-zA-Z]).*", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMED = re.compile(r"(?:class|id|role|hidden|style)\b", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


def unwanted(attributes: str) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether its role or the words of its class and id are none of an article's."""
    hidden = named = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            named |= value.strip().lower() in ROLES
        elif name in ("class", "id"):
            named |= any(w in WORDS or w.startswith(STARTS) for w in (x.lower() for x in CAMEL.split(value)))
    return hidden, named


class Page:
    """The tree of a page: for each element its name and parent, in page order, and the pieces of text with their element."""

    def __init__(self, html: str):
        self.names, self.parents, self.gone, self.named = ["html"], [0], [False], [False]
        self.pieces: list[tuple[int, str, bool] | None] = []  # element, text, in a link; None between blocks
        self._stack, self._open, self._link = [0], defaultdict(list), -1
        self._open["html"].append(0)
        self._parse(html)

    def _last(self, names) -> int:
        return max((self._open[n][-1] for n in names if self._open[n]), default=-1)

    def _cut(self, at: int) -> None:
        """End the open elements from a place of the stack on."""
        while len(self._stack) > max(at, 1):
            node = self._stack.pop()
            self._open[self.names[node]].pop()
            if node == self._link:
                self._link = -1

    def _start(self, name: str, attributes: str) -> None:
        if name == "html" or name == "body" and self._open["body"]:
            return
        if name in BLOCKS:
            self.pieces.append(None)
            if (at := self._last(("p",))) > self._last(WALLS):
                self._cut(at)
        if name in CLOSES:
            ends, walls = CLOSES[name]
            if (at := self._last(ends)) > self._last(walls):
                self._cut(at)
        hidden, named = unwanted(attributes) if NAMED.search(attributes) else (False, False)
        node = len(self.names)
        self.names.append(name)
        self.parents.append(self._stack[-1])
        self.gone.append(hidden and name != "body" or name in GONE)
        self.named.append(named and name != "body")
        if name in VOID or name in RAW:
            if name == "br":
                self.pieces.append((self._stack[-1], " ", False))
            return
        self._open[name].append(len(self._stack))
        self._stack.append(node)
        if name == "a":
            self._link = node

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self.pieces.append(None)
        if name in ("html", "body"):  # what follows still belongs to the body
            return
        if name == "a":
            self._link = -1
        at = self._last((name,))
        if at > 0 and at > self._last(WALLS - {name} if name in BLOCKS else BLOCKS):
            self._cut(at)

    def _parse(self, html: str) -> None:
        at, search = 0, TOKEN.search
        while found := search(html, at):
            self._text(html[at : found.start()])
            at = found.end()
            end, name, attributes = found.group(1, 2, 3)
            if name is None:
                continue
            name = name.lower()
            if end:
                self._end(name)
                continue
            self._start(name, attributes)
            if name in RAW:
                close = RAW_END[name].search(html, at)
                at = close.end() if close else len(html)
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], references.unescape(text) if "&" in text else text, self._link >= 0))


def blocks(page: Page, gone: list[bool]) -> list[tuple[int, str, int, int]]:
    """Container, text, number of characters in links and of links of the blocks that stay, in page order."""
    out, held, links, inside, before = [], [], 0, 0, False
    holder = list(range(len(page.names)))
    for node, name in enumerate(page.names):
        if name not in BLOCKS and node:
            holder[node] = holder[page.parents[node]]
    at = 0
    for piece in [*page.pieces, None]:
        if piece is None:
            if text := " ".join("".join(held).split()):
                out.append((at, text, min(links, len(text)), inside))
            held, links, inside, before = [], 0, 0, False
        elif not gone[piece[0]]:
            held.append(piece[1])
            at = holder[piece[0]]
            if piece[2]:
                links += len(" ".join(piece[1].split()))
                inside += not before
            before = piece[2]
    return out


def removed(page: Page) -> list[bool]:
    """Whether each element is no part of an article, by itself or by one that holds it."""
    size = len(page.names)
    main, heading, chars = [False] * size, [False] * size, [0] * size
    for piece in page.pieces:
        if piece:
            chars[piece[0]] += len(piece[1])
    for node in range(size - 1, 0, -1):
        up, name = page.parents[node], page.names[node]
        main[up] |= not page.gone[node] and (main[node] or name in ("main", "article") and not page.named[node])
        heading[up] |= heading[node] or name in HEADINGS
        chars[up] += chars[node]
    gone, article = [False] * size, [False] * size
    for node in range(1, size):
        up, name = page.parents[node], page.names[node]
        out = gone[up] or page.gone[node] or page.named[node] and not main[node]
        if name == "form":
            out |= not main[node] and 2 * chars[node] <= chars[0]
        elif name == "header":
            out |= not main[node] and not (article[up] and heading[node])
        gone[node] = out
        article[node] = not out and (article[up] or name in ("main", "article"))
    return gone


def points(text: str) -> float:
    return 1 + sum(map(text.count, ",،、，")) + min(len(text) / 100, 3)


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Page(html)
    gone = removed(page)
    found = blocks(page, gone)
    if not found:
        return ""
    names, parents, size = page.names, page.parents, len(page.names)
    score, chars, links, counts = [0.0] * size, [0] * size, [0] * size, [0] * size
    for node, text, linked, number in found:
        chars[node] += len(text)
        links[node] += linked
        counts[node] += number
        name, up = names[node], node
        if name in HEADINGS:
            continue
        if name in ("p", "pre"):
            up = parents[node]
        while names[up] in INNER and name in INNER and up:
            up = parents[up]
        worth = points(text) * (1 - linked / len(text))
        for level in range(LEVELS):
            score[up] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
            if not up:
                break
            up = parents[up]
    for node in range(size - 1, 0, -1):
        for totals in (chars, links, counts):
            totals[parents[node]] += totals[node]
    score = [s * (1 - l / c) if c else 0.0 for s, l, c in zip(score, links, chars)]
    within = [-1] * size  # the outermost article or main element
    for node in range(1, size):
        if not gone[node]:
            within[node] = within[parents[node]] if within[parents[node]] >= 0 else node if names[node] in ("article", "main") else -1
    inside = [n for n in range(size) if within[n] >= 0 and chars[within[n]]]
    best = max(inside or range(size), key=score.__getitem__)
    top = within[best] if within[best] >= 0 else best
    kept = [False] * size
    kept[top] = True
    for node in range(1, size):
        if node != top and parents[node] == parents[top] and not gone[node] and chars[node]:
            if inside:
                kept[node] = names[node] in ("article", "section") and score[node] >= NEAR * score[best]
            elif names[node] == "p":
                kept[node] = links[node] < 0.25 * chars[node]
            else:
                kept[node] = names[node] in HEADINGS or score[node] >= NEAR * score[best]
    menu = [False] * size
    for node in range(1, size):
        kept[node] |= kept[parents[node]]
        menu[node] = menu[parents[node]] or (names[node] in LISTS and node != top and counts[node] >= MENU_LINKS
                                             and links[node] > MENU_DENSITY * chars[node] and links[node] < MENU_LENGTH * counts[node])
    return "\n".join(text for node, text, _, _ in found if kept[node] and not menu[node])


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars (its code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([extract(h.as_py()) for h in part.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], names=[*keep, "text"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    rows = pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, f"{fields}, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
