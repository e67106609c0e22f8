"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Every line weighs what it holds outside links. Lines
of menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing and part the
page into regions. Weights are summed over a sliding window of lines; in each region the text runs from the
first surge point, where the window's sum rises above the bar, to the last dive point, where it falls back,
and short lines between them belong to it. The bar is a share of a window of median lines, so neither one long
paragraph nor a large page moves it.

Article markup only weighs lines: those inside gain, and those outside lose, by the share of the page's text
that the markup holds, so that an article element with a teaser in it doesn't hide the text beside it. Furniture
is no furniture where it wraps the page: a form that holds most of the text, or any other element, but for
reader comments, that holds most of the text and an article in it.

Null, empty or tag-only html gives empty text; every row gives one row, repeated rows and identifiers too; a page
that breaks off in the middle gives what it has. Regions of equal size are all kept. Time and memory are in
proportion to a page's length, whatever is left open in it. Columns other than the named ones are ignored; the
kept columns may not be called ``text`` or ``n_chars``, which is an error.
"""

from __future__ import annotations

import html
import re
import statistics
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: Share of a window of median lines at which the text surges and dives.
SURGE = 0.12
#: A region outside article markup counts if it has this share of the largest region's weight.
LEAST_REGION = 0.125

# Element names of the HTML standard and the usual names of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu head button select dialog fieldset frameset datalist audio video canvas map object applet".split())
CELLS = frozenset("td th br".split())
# A name of furniture is a whole class or id, alone or with a usual word for its place or kind before or behind it.
NAMED = re.compile(
    r"(?i)(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sticky|mobile|cookies?|social|user|reader|post|entry|article)[_-]+)*(?:ads?|advert\w*|adsense|banner|billboard|breadcrumbs?|byline-links|comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|"
    r"footer|foot|form|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|alert|overlay|pager|pagination|popup|promo\w*|recommended|related|"
    r"replies|respond|search|share|sharing|sidebar|side-bar|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|topbar|widget)"
    r"(?:[_-]+(?:area|banner|bar|block|box|buttons?|container|form|icons?|inner|items?|left|links?|list|menu|nav|notice|popup|posts?|right|section|slot|top|unit|widget|wrap|wrapper|\d+))*"
)
#: Names of reader comments, which are furniture however much of a page they fill.
READERS = re.compile(r"(?i)(?:[a-z]+[_-]+)*(?:comments?|commentlist|disqus|replies|respond)(?:[_-]+[a-z0-9]+)*")
#: Classes of an article and its parts: furniture names beside them, or of headers in them, don't count.
WRAPPER = re.compile(r"(?i)(?:h?entry|post|article|story)(?:[_-]+(?:header|head|title|body|content|text|inner|main|container|wrap|wrapper))*")
HEADING = re.compile(r"(?i)(?:[a-z]+[_-]+)*(?:header|masthead|banner)(?:[_-]+[a-z]+)*")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|math|iframe)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)


def _furniture(name: str, attrs: str, in_article: bool) -> str | None:
    """The kind of furniture that an element is, if any: 'form', 'readers' or 'other'."""
    found = [(key.lower(), value.strip("\"'")) for key, value in ATTRIBUTE.findall(attrs)] if attrs else []
    names = [n for key, value in found if key in ("class", "id") for n in value.split()]
    if name in FURNITURE:
        return "form" if name == "form" else "readers" if any(READERS.fullmatch(n) for n in names) else "other"
    wrapper = any(WRAPPER.fullmatch(n) for n in names)
    if name == "header" and not in_article and not wrapper:
        return "other"
    if not attrs or name in ("html", "body", "article", "main") and "omment" not in attrs:
        return None
    for key, value in found:
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return "other"
    if wrapper:
        return None
    named = [n for n in names if NAMED.fullmatch(n) and not (in_article and HEADING.fullmatch(n))]
    return None if not named else "readers" if any(READERS.fullmatch(n) for n in named) else "other"


class _Line(NamedTuple):
    text: str
    #: Characters outside links.
    prose: int
    in_article: bool
    #: The innermost furniture element around it, or -1.
    furniture: int


class _Box:
    """A furniture element: the one around it, its kind, the prose in it, and whether an article begins in it."""

    __slots__ = ("article", "kind", "outer", "prose")

    def __init__(self, outer: int, kind: str):
        self.outer, self.kind, self.prose, self.article = outer, kind, 0, False


def lines(page: str) -> tuple[list[_Line], list[_Box]]:
    """The lines of a page and its furniture elements, outer ones first. Each tag costs constant time on the average."""
    out: list[_Line] = []
    boxes: list[_Box] = []
    stack: list[tuple[str, int, bool]] = []  # name, innermost furniture, in article
    places: dict[str, list[int]] = {}  # of the open elements by name
    blocks: list[int] = []  # of the open block elements
    buffer: list[str] = []
    linked = 0

    def state() -> tuple[int, bool]:
        return stack[-1][1:] if stack else (-1, False)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            box, inside = state()
            out.append(_Line(text, max(0, len(text) - linked), inside, box))
        buffer.clear()
        linked = 0

    def close(to: int) -> None:
        if blocks and blocks[-1] >= to:
            flush()
        while len(stack) > to:
            places[stack.pop()[0]].pop()
        while blocks and blocks[-1] >= to:
            blocks.pop()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if places.get("a"):
                linked += len(text.strip())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if places.get(name):
                close(places[name][-1])
            elif name in BLOCKS:
                flush()
            continue
        if name in CELLS:
            buffer.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            # An open paragraph, and an open item of a list, end where the next block or item begins.
            if blocks and ((inner := stack[blocks[-1]][0]) == "p" or inner == name and name in ("li", "dt", "dd", "tr", "option")):
                close(blocks[-1])
            flush()
        attrs = m["attrs"] or m["attrs2"] or ""
        box, in_article = state()
        if kind := _furniture(name, attrs, in_article):
            flush()
            boxes.append(_Box(box, kind))
            box = len(boxes) - 1
        if attrs.rstrip().endswith("/") and name not in BLOCKS:
            continue
        article = name in ("article", "main") or "role" in attrs and bool(re.search(r"""role\s*=\s*["']?(?:main|article)\b""", attrs, re.I))
        if article and not in_article and box >= 0:
            boxes[box].article = True
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, box, in_article or article))
    if at < len(page):
        rest = page[at:]
        buffer.append(html.unescape(rest) if "&" in rest else rest)
    flush()
    for line in out:
        if line.furniture >= 0:
            boxes[line.furniture].prose += line.prose
    for box in reversed(boxes):
        if box.outer >= 0:
            boxes[box.outer].prose += box.prose
            boxes[box.outer].article |= box.article
    return out, boxes


def _open(found: list[_Line], boxes: list[_Box]) -> list[bool]:
    """Whether each line stands outside furniture, or in furniture that wraps the page."""
    among: list[bool] = []  # readers' comments
    for b in boxes:
        among.append(b.outer >= 0 and (among[b.outer] or boxes[b.outer].kind == "readers"))
    readers = sum(b.prose for b, inner in zip(boxes, among, strict=True) if b.kind == "readers" and not inner)
    half = (sum(line.prose for line in found) - readers) / 2
    wraps = [b.kind != "readers" and b.prose > half and (b.article or b.kind == "form") for b in boxes]

    def spread() -> list[bool]:
        free: list[bool] = []
        for b, wrap in zip(boxes, wraps, strict=True):
            free.append(wrap and (b.outer < 0 or free[b.outer]))
        return [line.furniture < 0 or free[line.furniture] for line in found]

    out = spread()
    if not any(o and line.prose for o, line in zip(out, found, strict=True)):
        # All prose lies in furniture: what holds most of it wraps the page.
        wraps = [b.kind != "readers" and b.prose > half for b in boxes]
        out = spread()
    return out


def _weights(found: list[_Line], is_open: list[bool]) -> tuple[list[float], float]:
    """The weight of each line, and the bar that a window has to pass."""
    prose = [line.prose if o and 2 * line.prose > len(line.text) else 0 for line, o in zip(found, is_open, strict=True)]
    filled = [n for n in prose if n]
    if not filled:
        return [0.0] * len(found), 0.0
    # One long paragraph doesn't move the median, so it sets no bar for the others.
    median, total = statistics.median_low(filled), sum(filled)
    inside = sum(n for n, line in zip(prose, found, strict=True) if line.in_article) / total
    weigh = lambda n, line: n + median * inside if line.in_article else n * (1 - inside) ** 2
    return [weigh(n, line) if o and (n or line.in_article) else 0.0 for n, line, o in zip(prose, found, is_open, strict=True)], SURGE * WINDOW * median


def _regions(found: list[_Line], is_open: list[bool]) -> list[list[int]]:
    """Runs of open lines: furniture parts them, but not within an article, and so does an article's beginning and end."""
    out: list[list[int]] = [[]]
    for k, line in enumerate(found):
        if is_open[k]:
            if out[-1] and found[out[-1][-1]].in_article != line.in_article:
                out.append([])
            out[-1].append(k)
        elif not line.in_article:
            out.append([])
    return out


def _part(weights: list[float], least: float) -> slice:
    """From the first surge to the last dive: short lines between prose belong to it."""
    above = [k for k in range(len(weights)) if sum(weights[k : k + WINDOW]) > least]
    if not above:
        return slice(0, 0)
    last = min(above[-1] + WINDOW, len(weights))
    while not weights[last - 1]:
        last -= 1
    return slice(above[0], last)


def main_text(page: str | None) -> str:
    """The article of one page, its blocks joined by a line feed."""
    if not page:
        return ""
    found, boxes = lines(page)
    is_open = _open(found, boxes)
    weights, least = _weights(found, is_open)
    parts = [own[_part([weights[k] for k in own], least)] for own in _regions(found, is_open)]
    sizes = [sum(weights[k] for k in own) for own in parts]
    kept = [k for own, size in zip(parts, sizes, strict=True) if own and (found[own[0]].in_article or size >= LEAST_REGION * max(sizes)) for k in own]
    return "\n".join(found[k].text for k in kept if found[k].in_article or 2 * found[k].prose > len(found[k].text))


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page."""
    if clash := {c.lower() for c in keep} & {"text", "n_chars"}:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")

    def batch_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(batch_text, f"{kinds}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from constella.llm._store import table

    return extract_text(table(spark, sf_dir, "pages"))
