"""HTML extraction by layout: a tree builder with implied tags and visibility rules, then rendering of all visible text.

Tokens are tags, comments and text; raw text elements end at their own end tag. The builder keeps a stack: an element that
can't stand inside an open one closes it first (a paragraph before a block, list items, table cells and rows, options),
end tags close up to their element and are ignored without one, void elements stay empty. Elements that browsers don't
show, and those hidden by attribute or inline style, are skipped with all they hold.

Rendering: white space runs are one space except in preformatted text; blocks begin on a line of their own, paragraphs,
headings, lists and tables after a blank one; list items have a dash or their number, indented by depth; a table's cells are
padded to their column's width (at most ``PAD`` characters, so that one long cell doesn't widen every row) and joined by
" | ", spans of columns and rows keep their places empty; nested tables are rendered into their cell first.

No recursion, so nesting may be of any depth, and open elements are found by name, so time grows with the page alone. Cases:
null pages are empty; broken markup is text or ignored, never an error: a tag that the page's end cuts off is text with all
that follows; a table whose spans take more than ``GRID`` places is laid out without spans; page_id may be null or repeat;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Attributes: a quote is one only after an equals sign; unquoted values run to white space or the tag's end. Possessive, so without backtracking.
GIVEN = r"(?:[^>=]|=[ \t\n\r\f]*+(?:\"[^\"]*\"|'[^']*'|[^ \t\n\r\f\"'>][^ \t\n\r\f>]*+)?+)*+"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)(" + GIVEN + r")>|<", re.S)
TAG = re.compile(r"</?[A-Za-z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f\"'>][^ \t\n\r\f>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object canvas audio video datalist title".split())
FOREIGN = frozenset("svg math".split())
#: Elements that aren't shown inside svg or math, besides those above.
UNSEEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
#: Inline elements that stand apart from what is beside them; some only inside svg or math.
APART, APART_FOREIGN = frozenset("option textarea".split()), frozenset("text mtd".split())
#: What may stand in an open head; any other start tag, and text, ends it.
IN_HEAD = frozenset("title meta link base style script noscript noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul xmp tr caption thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: A start tag closes the nearest of the first set, unless one of the second stands in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Most characters that a column is padded to, and places of a table that spans may take.
PAD, GRID = 120, 1 << 16
#: Tables inside each other that are laid out, and depth of lists that is indented; further cells are lines, and items go no deeper.
DEEP = 16
#: Of an element's start within which a paragraph stays open, and end tags that reach beyond a cell or table.
KEEPS_P, CELLS, BEYOND = ("td", "th", "table", "li", "div"), ("td", "th", "table"), frozenset("table tr thead tbody tfoot body html".split())


class _Box:
    """Lines of text that are being laid out: the page, or a table cell."""

    def __init__(self):
        self.lines, self.line, self.blank = [], [], False

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.line.append(first)
            for x in rest:
                self.lines.append("".join(self.line).rstrip())
                self.line = [x]
            return
        text = SPACE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] in ("", " ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def end_line(self, blank: bool = False, prefix: str = "") -> None:
        text = "".join(self.line).rstrip()
        if text.strip():
            self.lines.append(text)
        if blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.line = [prefix] if prefix else []

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, columns, rows) in a grid; the places that spans cover are empty. Columns in which no cell begins are left out."""
    grid: list[dict[int, str]] = []
    below: dict[int, int] = {}  # column: rows that a cell above still covers
    taken = 0
    for r in rows:
        out, at, after = {}, 0, {c: n - 1 for c, n in below.items() if n > 1}
        for text, wide, high in r:
            while at in below:
                at += 1
            out[at] = text
            taken += wide * high
            if taken > GRID:
                return [[c[0] for c in r] for r in rows]
            if high > 1:
                after |= dict.fromkeys(range(at, at + wide), high - 1)
            at += wide
        grid.append(out)
        below = after
    columns = {c: i for i, c in enumerate(sorted({c for out in grid for c in out}))}
    lines = []
    for out in grid:
        line = [""] * (1 + max((columns[c] for c in out), default=-1))
        for c, text in out.items():
            line[columns[c]] = text
        lines.append(line)
    return lines


def _laid_out(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """A table's lines: columns as wide as their widest cell; a cell of several lines takes as many."""
    spans = any(wide > 1 or high > 1 for r in rows for _, wide, high in r)
    rows = [[c.split("\n") for c in r] for r in (_placed(rows) if spans else [[c[0] for c in r] for r in rows]) if any(c.strip() for c in r)]
    width: dict[int, int] = {}
    for r in rows:
        for i, c in enumerate(r):
            width[i] = max(width.get(i, 0), *(min(PAD, len(x)) for x in c))
    out = []
    for r in rows:
        for k in range(max(map(len, r))):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(width[i]) for i, c in enumerate(r)).rstrip())
    return out


def _span(value: str, most: int) -> int:
    """A colspan or rowspan: 1 where it is no number, or 0."""
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


class _Page:
    def __init__(self):
        self.stack: list[str] = []
        self.open: dict[str, list[int]] = {}  # places of each name in the stack
        self.spans: list[tuple[int, int]] = []  # of open cells
        self.boxes, self.tables, self.lists = [_Box()], [], []
        self.unseen, self.pre = 0, 0

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, else -1."""
        return at[-1] if (at := self.open.get(name)) else -1

    def start(self, name: str, attributes: str) -> bool:
        """Opens an element; says whether it stays open."""
        if name not in IN_HEAD:
            self.end_head()
        if name in BLOCK and (k := self.last("p")) > max(map(self.last, KEEPS_P)):
            self.close(k)
        if name in CLOSES:
            these, until = CLOSES[name]
            if (k := max(map(self.last, these))) > max(map(self.last, until), default=-1):
                self.close(k)
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        foreign = self.foreign()
        if foreign and name not in VOID and ATTRIBUTE.sub("", attributes).endswith("/"):
            return False  # empty; in HTML itself the slash means nothing
        hidden = name in UNSEEN or (foreign and name in UNSEEN_FOREIGN) or "hidden" in given or HIDING.search(given.get("style", "")) is not None
        if name in VOID:
            if not self.unseen and not hidden:
                box = self.boxes[-1]
                if name == "br":
                    box.lines.append("".join(box.line).rstrip())
                    box.line = []
                elif name == "hr":
                    box.end_line()
                elif name == "img" and given.get("alt"):
                    box.add(html.unescape(given["alt"]), False)
            return False
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)
        if self.unseen or hidden:
            self.unseen += 1
            return True
        box = self.boxes[-1]
        if name in APART or (foreign and name in APART_FOREIGN):
            box.add(" ", False)
        if name in ("td", "th"):
            if self.tables and self.tables[-1] is None:
                box.end_line()
            elif self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.boxes.append(_Box())
                self.spans.append((_span(given.get("colspan", ""), 1000), _span(given.get("rowspan", ""), 65534)))
            return True
        if name in BLOCK:
            box.end_line(blank=name in SPACED and not (name in ("ul", "ol") and self.lists))
        if name == "table":
            self.tables.append([] if len(self.tables) < DEEP else None)
        elif name == "tr" and self.tables and self.tables[-1] is not None:
            self.tables[-1].append([])
        elif name in ("ul", "ol", "menu"):
            self.lists.append([name, int(given["start"]) - 1 if given.get("start", "").isascii() and given.get("start", "").isdigit() else 0])
        elif name == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else mark
            box.line = ["  " * min(depth, DEEP) + mark]
        elif name in ("pre", "xmp", "textarea"):
            self.pre += 1
        return True

    def close(self, k: int) -> None:
        """Closes all elements from the k-th on."""
        while len(self.stack) > k:
            name = self.stack.pop()
            self.open[name].pop()
            if self.unseen:
                self.unseen -= 1
                continue
            box = self.boxes[-1]
            if name in ("td", "th"):
                if self.tables and self.tables[-1] is None:
                    box.end_line()
                elif self.tables:
                    self.tables[-1][-1].append((self.boxes.pop().text(), *self.spans.pop()))
                continue
            if name == "table":
                lines = _laid_out(self.tables.pop() or [])
                box.end_line()
                box.lines += lines
            elif name in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
            elif name in ("pre", "xmp", "textarea"):
                self.pre -= 1
            if name in APART or (name in APART_FOREIGN and self.foreign()):
                box.add(" ", False)
            if name in BLOCK:
                box.end_line(blank=name in SPACED and not (name in ("ul", "ol") and self.lists))

    def foreign(self) -> bool:
        return any(self.last(x) >= 0 for x in FOREIGN)

    def end_head(self) -> None:
        """Closes a head that is open without an element in it."""
        if self.stack and self.stack[-1] == "head":
            self.close(len(self.stack) - 1)

    def text(self, value: str) -> None:
        if self.stack and self.stack[-1] == "head" and html.unescape(value).strip(" \t\n\r\f"):
            self.end_head()
        if not self.unseen and value:
            # text in a table but in no cell stands before the table
            self.boxes[-1].add(html.unescape(value), self.pre > 0)


def render(page: str) -> str:
    """All visible text of an HTML page."""
    out, at = _Page(), 0
    for_ = TOKEN.search
    while m := for_(page, at):
        out.text(page[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            if m[0] == "<":
                if TAG.match(page, m.start()):  # cut off by the page's end
                    at = m.start()
                    break
                out.text("<")
            continue
        name = name.lower()
        if m[1]:
            k = out.last(name)
            if k >= 0 and (name in BEYOND or k >= max(map(out.last, CELLS))):
                out.close(k)
            continue
        if out.start(name, m[3]) and name in RAW:
            # in the page itself: lower case may differ in length
            closing = RAW_END[name].search(page, at)
            end = closing.start() if closing else len(page)
            if name in ("xmp", "textarea"):
                out.text(page[at:end].removeprefix("\n" if name == "textarea" else ""))
            at = end
    out.text(page[at:])
    out.close(0)
    while len(out.boxes) > 1:
        out.boxes[-2].add(out.boxes.pop().text(), True)
    return re.sub(r"\n{3,}", "\n\n", out.boxes[0].text())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # so that no batch of long pages is held twice
            part = batch.slice(i, 256)
            texts = [render(p) if p else "" for p in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of each row of ``pages`` (page_id, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
