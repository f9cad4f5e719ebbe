"""Layout-aware text of web pages: a small tree builder and a block renderer.

The builder knows void elements, implied start and end tags (paragraphs, list items, definition lists, options, table
parts), raw-text elements and stray end tags. Nothing is emitted for elements that are not shown: scripts, styles, templates,
the head, ``hidden``, ``display:none``, a closed ``dialog``, a closed ``details`` but for its summary, or text with ``visibility:hidden`` unless ``visible`` inside of it. Blocks stand on their own lines, paragraphs, headings, lists
and tables with a blank line around them, list items have a bullet or their number and an indent, and table cells
stand under one another, those of several rows or columns in all of theirs. An element is rendered when it closes, so that no tree is kept and depth costs no
recursion.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = set("annotation annotation-xml audio canvas datalist defs desc head iframe metadata noembed noframes script style template title video".split())
#: Blank lines around a block.
SPACED = {"blockquote": 1, "dl": 1, "figure": 1, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "hr": 1, "ol": 1, "p": 1, "pre": 1, "table": 1, "ul": 1}
BLOCK = set(SPACED) | set(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav "
    "optgroup option search section select summary tbody td tfoot th thead tr".split()
)
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: A start tag ends an open element of these, unless one of the others is open inside of it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
}
#: Where the search for an open paragraph stops.
SCOPE = set("annotation-xml applet button body caption desc foreignobject html marquee mi mn mo ms mtext object table td template th title".split())
#: Cells longer than this don't widen their column, and a row goes on past it: else one long cell would fill every row with blanks.
MOST_PADDING = 60
#: List items, definitions and quotes inside one another beyond this are not set in further.
MOST_INDENT = 40
INDENTED = ("li", "dd", "blockquote")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")


def _declared(style: str, wanted: tuple[str, ...]) -> dict[str, str]:
    """The values of some properties in a style attribute: the last one of a property counts, or the last important one."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in _COMMENT.sub("", html.unescape(style)).split(";"):
        name, colon, value = declaration.partition(":")
        name = name.strip().lower()
        if colon and name in wanted:
            value, mark, rest = value.strip().lower().partition("!")
            important = bool(mark) and rest.strip() == "important"
            if important or name not in found or not found[name][0]:
                found[name] = important, value.strip()
    return {name: value for name, (_, value) in found.items()}


class _Frame:
    """An open element. Inline elements share the lines of the block around them."""

    __slots__ = ("tag", "hidden", "unseen", "pre", "block", "inline", "blocks", "rows", "span", "down", "number", "shut")

    def __init__(self, tag: str, hidden: bool, unseen: bool, pre: bool, block: _Frame | None):
        self.tag, self.hidden, self.unseen, self.pre = tag, hidden, unseen, pre
        self.block = block or self
        self.inline: list[str] = []  # of a block: its current line, "\0" for a forced break
        self.blocks: list[tuple[int, list[str], int]] = []  # of a block: blank lines before, lines, blank lines after
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # of a table: cells (columns, rows, lines); of a row: one list
        self.span = self.down = 1
        self.number = 1
        self.shut = False  # a closed disclosure: nothing but its first summary is shown

    def flush(self) -> None:
        if not self.inline:
            return
        text, self.inline = "".join(self.inline), []
        if self.pre:
            lines = text.replace("\0", "\n").split("\n")
            lines = lines[1:] if lines and not lines[0].strip() else lines
            lines = [x.rstrip() for x in lines]
            while lines and not lines[-1]:
                lines.pop()
        else:
            lines = [_SPACES.sub(" ", x).strip(" ") for x in text.split("\0")]
            while lines and not lines[-1]:
                lines.pop()
        if any(lines):
            self.blocks.append((0, lines, 0))

    def lines(self) -> tuple[int, list[str], int]:
        """(blank lines before, lines, blank lines after), margins between blocks being the larger of the two."""
        self.flush()
        out: list[str] = []
        before = after = 0
        for top, lines, bottom in self.blocks:
            if not out:
                before = max(before, top)
            else:
                out += [""] * max(after, top)
            out += lines
            after = bottom
        return before, out, after


def _width(text: str) -> int:
    """Columns of a terminal: wide characters take two."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _placed(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells as (column, columns, lines): columns taken by a cell of several rows are passed over in the rows below."""
    taken: dict[int, int] = {}  # column -> rows for which it is still taken
    out = []
    for row in rows:
        at, cells, new = 0, [], {}
        for span, down, lines in row:
            while any(c in taken for c in range(at, at + span)):
                at += 1
            cells.append((at, span, lines))
            if down > 1:
                new |= {c: down for c in range(at, at + span)}
            at += span
        taken = {c: n - 1 for c, n in (taken | new).items() if n > 1}
        out.append(cells)
    return out


def _table(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of a table, cells padded to their columns; a cell of several columns does not widen them."""
    widths: list[int] = []
    grid = _placed(rows)
    for row in grid:
        for at, span, lines in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *(w for w in map(_width, lines) if w <= MOST_PADDING)])
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = []
    for row in grid:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, done, late = [], 0, 0  # late: columns by which long cells have pushed the line on
            for at, _, lines in row:
                text = lines[k] if k < len(lines) else ""
                gap = max(starts[at] + late - done, 2 if done else 0)
                late = done + gap - starts[at]
                line.append(" " * gap + text)
                done += gap + _width(text)
            out.append("".join(line).rstrip())
    return out


class _Page:
    def __init__(self) -> None:
        self.stack = [_Frame("#page", False, False, False, None)]
        self.open: dict[str, int] = {}

    # ---- elements ----

    def push(self, tag: str, hidden: bool = False, pre: bool = False, unseen: bool | None = None) -> _Frame:
        """``hidden``: it has no box, nor has what is inside. ``unseen``: its text is not visible; None takes that over from around it."""
        top = self.stack[-1]
        block = tag in BLOCK
        if top.shut:
            if tag == "summary" and not top.rows:
                top.rows = [[]]  # it has its summary now
            else:
                hidden = True
        frame = _Frame(tag, top.hidden or hidden, top.unseen if unseen is None else unseen, top.pre or pre, None if block else top.block)
        if block:
            top.block.flush() if not frame.hidden else None
        self.stack.append(frame)
        self.open[tag] = self.open.get(tag, 0) + 1
        return frame

    def pop(self) -> None:
        frame = self.stack.pop()
        self.open[frame.tag] -= 1
        if frame.block is not frame or frame.hidden:
            return
        parent, tag = self.stack[-1].block, frame.tag
        if tag == "tr":
            self.add_row(frame)
            return
        top, lines, bottom = frame.lines()
        if tag in ("td", "th"):
            row = next((f for f in reversed(self.stack) if f.tag == "tr"), None)
            if row is not None:
                row.rows = row.rows or [[]]
                row.rows[0].append((frame.span, frame.down, lines))
                return
        if tag == "table":
            if frame.rows:
                lines = [*lines, *_table(frame.rows)]
        elif tag == "li" and not (frame.unseen and not lines):
            holder = next((f for f in reversed(self.stack) if f.tag in ("ul", "ol", "menu")), None)
            mark = "- "
            if holder is not None and holder.tag == "ol":
                number = holder.number if frame.number is None else frame.number
                mark, holder.number = f"{number}. ", number + 1
            pad = " " * len(mark) if self.indent() else ""
            lines = [(mark if i == 0 else pad if x else "") + x for i, x in enumerate(lines)] or [mark.rstrip()]
            top = bottom = 0
        elif tag == "dd" and self.indent():
            lines = ["  " + x if x else x for x in lines]
        elif tag == "blockquote" and self.indent():
            lines = ["> " + x if x else ">" for x in lines]
        if not lines:
            return
        space = SPACED.get(tag, 0)
        if tag in ("ul", "ol", "menu") and (self.open.get("li") or self.open.get("td") or self.open.get("th")):
            space = 0
        parent.flush()
        parent.blocks.append((max(top, space), lines, max(bottom, space)))

    def indent(self) -> bool:
        return sum(self.open.get(t, 0) for t in INDENTED) < MOST_INDENT

    def add_row(self, frame: _Frame) -> None:
        _, loose, _ = frame.lines()
        table = next((f for f in reversed(self.stack) if f.tag == "table"), None)
        cells = frame.rows[0] if frame.rows else []
        if loose:
            cells = [(1, 1, loose), *cells]
        if cells and table is not None:
            table.rows.append(cells)

    def close(self, tag: str) -> None:
        """Pop up to the nearest open element of this name."""
        if not self.open.get(tag):
            return
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()

    def close_within(self, tags: set[str], barrier: set[str]) -> None:
        """Pop the outermost open element of ``tags`` that is not beyond a ``barrier``."""
        left = sum(self.open.get(t, 0) for t in tags)
        found = 0
        for depth in range(len(self.stack) - 1, 0, -1) if left else ():
            tag = self.stack[depth].tag
            if tag in tags:
                found, left = depth, left - 1
                if not left:
                    break
            elif tag in barrier:
                break
        if found:
            while len(self.stack) > found:
                self.pop()

    # ---- tokens ----

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if not (self.stack[-1].hidden or self.stack[-1].unseen or self.stack[-1].shut):
                self.stack[-1].block.inline.append("\0")
            return
        if tag in BLOCK and self.open.get("head"):
            self.close("head")
        if tag in BLOCK:
            self.close_within({"p"}, SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in ENDS:
            self.close_within(*ENDS[tag])
        if tag in ("td", "th") and not self.in_table("tr"):
            self.start("tr", "")
        elif tag in ("tr", "tbody", "thead", "tfoot", "caption") and not self.open.get("table"):
            self.push("table")
        hidden, unseen, span, down, number, kind, opened = tag in UNSEEN, None, 1, 1, None, "", False
        if attributes and ("=" in attributes or "idden" in attributes.lower() or tag in ("details", "dialog")):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden":
                    hidden = True
                elif name == "style":
                    style = _declared(value, ("display", "visibility"))
                    hidden = hidden or style.get("display") == "none"
                    if style.get("visibility") in ("hidden", "collapse", "visible"):
                        unseen = style["visibility"] != "visible"
                elif name == "open":
                    opened = True
                elif name == "rowspan" and value.isascii() and value.isdigit():
                    down = 65_534 if len(value.lstrip("0")) > 5 else min(max(1, int(value)), 65_534)
                elif name == "colspan" and value.isascii() and value.isdigit():
                    span = 1000 if len(value.lstrip("0")) > 4 else min(max(1, int(value)), 1000)
                elif name == ("value" if tag == "li" else "start") and re.fullmatch(r"-?[0-9]{1,9}", value):
                    number = int(value)
                elif name == "type":
                    kind = value.lower()
        elif attributes.strip() == "hidden":
            hidden = True
        if tag in VOID:
            if not (hidden or self.stack[-1].hidden or self.stack[-1].shut or (self.stack[-1].unseen if unseen is None else unseen)):
                block = self.stack[-1].block
                if tag == "hr":
                    block.flush()
                    block.blocks.append((1, ["-" * 8], 1))
                elif tag == "input" and kind in ("submit", "button", "reset", "text"):
                    shown = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "value"), "")
                    block.inline.append(html.unescape(shown).replace("\0", ""))
            return
        hidden = hidden or tag == "dialog" and not opened
        frame = self.push(tag, hidden, tag in ("pre", "textarea", "listing"), unseen)
        frame.span, frame.down, frame.shut = span, down, tag == "details" and not opened
        frame.number = number if tag == "li" else 1 if number is None else number

    def in_table(self, tag: str) -> bool:
        """Whether this table part is open inside the innermost table."""
        for f in reversed(self.stack):
            if f.tag == tag:
                return True
            if f.tag == "table":
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p":
            self.close_within({"p"}, SCOPE)
        elif tag in HEADINGS:
            if open_ := next((f.tag for f in reversed(self.stack) if f.tag in HEADINGS), None):
                self.close(open_)
        elif tag == "li":
            self.close_within(*ENDS["li"])
        elif tag in ("td", "th"):
            self.close_within({"td", "th"}, {"table"})
        elif tag in ("body", "html"):
            pass  # what follows still belongs to the body
        elif tag in BLOCK or tag in ("applet", "button", "marquee", "select", "svg", "object", "template", "video", "audio", "canvas", "head", "noscript"):
            self.close(tag)
        elif self.open.get(tag):
            # An inline element ends here unless a block around it does.
            for depth in range(len(self.stack) - 1, 0, -1):
                f = self.stack[depth]
                if f.tag == tag:
                    while len(self.stack) > depth:
                        self.pop()
                    break
                if f.block is f:
                    break

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.hidden or top.unseen or top.shut:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if "\0" in text:
            text = text.replace("\0", "")
        if top.block.tag in ("table", "tr", "tbody", "thead", "tfoot") and not text.strip():
            return
        top.block.inline.append(text)


def page_text(source: str) -> str:
    """The visible text of one page."""
    page, at, n, plain = _Page(), 0, len(source), False
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            page.text(source[at:])
            break
        if lt > at:
            page.text(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 2)
                at = n if end < 0 else max(end + 3, lt + 4)
            else:
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if not (nxt.isalpha() and nxt.isascii()) and not (nxt == "/" and source[lt + 2 : lt + 3].isalpha()):
            if nxt == "/":
                end = source.find(">", lt)  # a bogus end tag is a comment
                at = n if end < 0 else end + 1
            else:
                page.text("<")
                at = lt + 1
            continue
        m = None if plain else _TAG.match(source, lt)
        if m is None:
            # A quote is never closed; from here on tags end at the first ">", so that each is looked at once.
            plain = True
            m = _PLAIN_TAG.match(source, lt)
            if m is None:
                break  # a tag that never ends
        at, tag = m.end(), m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3])
        if tag in RAW and page.stack[-1].tag == tag:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            page.text(source[at : end.start() if end else n])
            at = end.start() if end else n
            if end:
                close = source.find(">", at)
                at = n if close < 0 else close + 1
            page.close(tag)
    while len(page.stack) > 1:
        page.pop()
    _, lines, _ = page.stack[0].lines()
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, html -> page_id, text, n_chars, n_lines for every row.

    Null and empty pages have an empty text and no lines. Rows with equal or null ids are pages of their own. Text with no
    markup is its own text, white space collapsed. A page of any length is rendered whole, by one task. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [page_text(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string")
    lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
