"""Main text of web pages by minimum-cut labelling.

A page is parsed into blocks of text. A small classifier gives each block the
cost of calling it content and the cost of calling it boilerplate; these are
the capacities of its edges to the two terminals. Neighbours in page order
and blocks that are close in the DOM are joined by smoothness edges. The
minimum cut of that graph is the cheapest labelling; the blocks on the content
side are the text. Blocks whose terminal capacities outweigh all their edges are
decided first; maximum flow by blocking flows over what is left finds the cut.

Words in class, id and role are finite costs. One that names a part of the layout
costs the less, the more of the page's text its element holds, and an article or
main element inside is free of it. One for other people's texts (comments, related
pages) costs a fixed amount, which a long text without links outweighs. Names
that say what a layout has or lacks, and names with a content word, don't count.

Character references are decoded, white space inside a block becomes one blank,
blocks are joined by line breaks. Defined cases: null and empty pages, and
pages without content, give an empty string; tags left open are closed by
what follows them; repeated rows are extracted alike; extra columns play no
part. A page's graph is linear in its blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import small_batches

#: Elements by their role.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg".split())
#: Formulas: text in a line; these and svg can close themselves.
FORMULA = frozenset("math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | FORMULA
BOILER = frozenset("nav footer aside button select option menu dialog head".split())
#: Elements that can also wrap a whole page; they lean as a layout word does.
WRAPPERS = frozenset("form fieldset".split())
CONTENT = frozenset("article main".split())
#: What a start tag closes: an open element of the same group, inside the nearest of the limits.
CLOSES = {"p": ({"p"}, None), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that speak for boilerplate, and for content.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail footer "
    "foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments disqus reply replies respond related recommended recommendations widget widgets pagination pager search complementary contentinfo copyright legal tags form".split()
)
#: Those of texts beside the page's own; the others name parts of the layout.
BESIDE_WORDS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
#: A name with one of these says what a layout has, lacks or is filed under.
MODIFIERS = frozenset("has with without no not is tag category".split())
CONTENT_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
#: Leaning of an element: never content; beside the page's own text; part of the layout.
NEVER, BESIDE, LAYOUT = -12.0, -5.0, -4.0
#: Less than this is no room.
LEAST = 1e-9
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | {"xmp"}}


class Block:
    """``depth`` counts the block elements around it, ``common`` those it has in common with the block before;
    ``parent`` is the second last of them, ``inner`` the innermost element of any kind."""

    __slots__ = ("common", "depth", "holder", "inner", "linked", "parent", "score", "text")

    def __init__(self, text: str, linked: int, score: float, holder: int, depth: int, common: int, parent: int, inner: int):
        self.text, self.linked, self.score, self.holder = text, linked, score, holder
        self.depth, self.common, self.parent, self.inner = depth, common, parent, inner


def _named(value: str) -> tuple[float, float]:
    """What the names in a class, id or role say for boilerplate and for content."""
    low = high = 0.0
    for name in value.strip("\"'").split():
        parts = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if parts & CONTENT_WORDS:
            high = high if parts & BOILER_WORDS else 3.0
        elif parts & BOILER_WORDS and not parts & MODIFIERS:
            low = min(low, BESIDE if parts & BESIDE_WORDS else LAYOUT)
    return low, high


def _leaning(tag: str, attrs: str, above: float, inside: bool) -> float:
    """What an element says of all it holds: below 0 boilerplate, above 0 content."""
    own = 0.0
    if tag in BOILER or tag == "header" and not inside:
        own = NEVER
    elif tag in CONTENT:
        own = 6.0
    elif tag in WRAPPERS:
        own = LAYOUT
    if attrs:
        low = high = 0.0
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            if name in ("class", "id", "role"):
                worst, best = _named(m[2] or "")
                low, high = min(low, worst), max(high, best)
            elif name == "hidden" or name == "aria-hidden" and "true" in (m[2] or "") or name == "style" and re.search(r"display\s*:\s*none", m[2] or "", re.I):
                own = NEVER
        # names for content and for boilerplate on one element: the text decides
        named = 0.0 if low < 0 < high else low or high
        if named < 0 and tag not in ("body", "html", "article", "main"):
            own = min(own, named)
        elif named > 0 and own >= 0:
            own = max(own, named)
    if tag in CONTENT and own > 0 and above == LAYOUT:
        return own  # the article of a layout
    # content inside boilerplate stays boilerplate, boilerplate inside content is boilerplate
    return min(own, above) if own < 0 or above < 0 else max(own, above)


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The page's blocks, and of each element's number the number of the one around it."""
    out: list[Block] = []
    stack: list[tuple[str, float, int, int]] = []  # element, leaning, its number, the number of what lays it out
    solid: list[int] = []  # numbers of those that are no inline elements
    n_open: Counter[str] = Counter()
    around = [0]
    words: list[str] = []
    linked = number = links = inside = low = 0

    def flush() -> None:
        nonlocal words, linked, low
        text = " ".join("".join(words).split())
        if text:
            leans, holder = stack[-1][1::2] if stack else (0.0, 0)
            out.append(Block(text, linked, leans, holder, len(solid), low, solid[-2] if len(solid) > 1 else 0, stack[-1][2] if stack else 0))
            low = len(solid)
        words, linked = [], 0

    def pop(to: int) -> None:
        nonlocal links, inside, low
        for tag, *_ in stack[to:]:
            links -= tag == "a"
            inside -= tag in CONTENT
            n_open[tag] -= 1
            if tag not in INLINE:
                solid.pop()
        del stack[to:]
        low = min(low, len(solid))

    def add(text: str) -> None:
        nonlocal linked
        if text:
            words.append(unescape(text) if "&" in text else text)
            if links:
                linked += len(text)

    at = 0
    while (m := _TAG.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1) if n_open[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            add(" " if tag == "br" else "")
            continue
        if (tag in FORMULA or tag == "svg") and m[3].rstrip().endswith("/"):
            continue
        if tag == "xmp":  # its text is as it stands, without tags and references
            flush()
            end = _END[tag].search(html, at)
            words.append(html[at : end.start() if end else len(html)])
            at = end.start() if end else len(html)
            flush()
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = end.start() if end else len(html)
            continue
        if tag not in INLINE:
            flush()
            # a block element ends open inline ones: their end tags are missing
            i = len(stack)
            while i and stack[i - 1][0] in INLINE and stack[i - 1][0] != "a":
                i -= 1
            pop(i)
            if tag in CLOSES or tag in ("ul", "ol", "div", "section", "article", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "footer", "aside", "header", "main", "form", "blockquote", "pre", "dl"):
                ends, limits = CLOSES.get(tag, ({"p"}, None))
                for i in range(len(stack) - 1, -1, -1) if any(map(n_open.__getitem__, ends)) else ():
                    if stack[i][0] in ends:
                        pop(i)
                        break
                    if limits and stack[i][0] in limits or not limits and stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
        if tag in VOID:
            continue
        number += 1
        above = stack[-1][1] if stack else 0.0
        leans = _leaning(tag, m[3], above, bool(inside))
        # the innermost element that says so by itself
        holder = 0 if leans != LAYOUT else number if above != LAYOUT or _leaning(tag, m[3], 0.0, bool(inside)) == LAYOUT else stack[-1][3]
        around.append(stack[-1][2] if stack else 0)
        stack.append((tag, leans, number, holder))
        n_open[tag] += 1
        if tag not in INLINE:
            solid.append(number)
        links += tag == "a"
        inside += tag in CONTENT
    add(html[at:])
    flush()
    return out, around


def costs(b: Block) -> tuple[float, float]:
    """Costs of calling a block content, and boilerplate."""
    n = len(b.text)
    for_content = b.score - 4.0 * min(1.0, b.linked / n)
    for_content += min(3.0, n / 80) - 0.5
    # more than a long paragraph without links: others' texts may be the page's own
    for_content += min(2.0, max(0, n - b.linked - 400) / 400)
    if b.text[-1] in ".!?…:;\"'”»":
        for_content += 0.5
    return (0.0, for_content) if for_content > 0 else (-for_content, 0.0)


def relieve(found: list[Block], around: list[int]) -> None:
    """A layout word costs the less, the larger the share of the page's unlinked text in its element."""
    if not any(b.holder for b in found):
        return
    held = [0] * len(around)
    for b in found:
        if b.score > NEVER:
            held[b.inner] += len(b.text) - min(len(b.text), b.linked)
    for e in range(len(around) - 1, 0, -1):  # an element's number is above that of the one around it
        held[around[e]] += held[e]
    for b in found:
        if b.holder:
            b.score *= 1 - held[b.holder] / max(1, held[0])


def smoothness(b: Block, before: Block) -> float:
    """Cost of unlike labels of neighbours in page order; the more ancestors they share, the more."""
    return 1.0 / (1 + before.depth + b.depth - 2 * b.common)


def graph(html: str) -> tuple[list[Block], list[tuple[float, float]], list[tuple[int, int, float]]]:
    """A page's blocks, their costs as content and as boilerplate, and the smoothness edges."""
    found, around = blocks(html)
    relieve(found, around)
    edges = [(i, i + 1, smoothness(b, a)) for i, (a, b) in enumerate(zip(found, found[1:], strict=False))]
    last: dict[int, int] = {}  # the block last seen directly in an element
    for i, b in enumerate(found):
        if last.get(b.parent, i - 1) != i - 1:
            edges.append((last[b.parent], i, 0.5))
        last[b.parent] = i
    return found, [costs(b) for b in found], edges


def content_side(unary: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> set[int]:
    """Minimum cut: the nodes whose content label is cheapest, and of equally cheap cuts the one with the fewest."""
    pull = [as_boiler - as_content for as_content, as_boiler in unary]
    near: list[list[tuple[int, float]]] = [[] for _ in unary]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    room = [sum(w for _, w in ws) for ws in near]
    label: list[bool | None] = [None] * len(unary)
    todo = list(range(len(unary)))
    while todo:  # what outweighs all its edges is decided, and leans on its neighbours
        i = todo.pop()
        if label[i] is not None or -room[i] < pull[i] <= room[i] + LEAST:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                room[j] -= w
                todo.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    at = {i: k for k, i in enumerate(left)}
    reached = _flow([pull[i] for i in left], [(at[a], at[b], w) for a, b, w in edges if a in at and b in at])
    return {i for i, x in enumerate(label) if x} | {left[k] for k in reached}


def _flow(pull: list[float], edges: list[tuple[int, int, float]]) -> list[int]:
    """The nodes that the source still reaches when the flow is largest: blocking flows along shortest paths."""
    n = len(pull)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    for a, b, forth, back in [(source, i, p, 0.0) if p > 0 else (i, sink, -p, 0.0) for i, p in enumerate(pull)] + [(a, b, w, w) for a, b, w in edges]:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (forth, back)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] > LEAST and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [i for i in queue if i < n]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= LEAST)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > LEAST and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                tried[a] += 1


def main_text(html: str | None) -> str:
    found, unary, edges = graph(html or "")
    keep = content_side(unary, edges)
    return "\n".join(b.text for i, b in enumerate(found) if i in keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
