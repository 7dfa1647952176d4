"""HTML to Markdown with headings, lists, tables, code and links; scripts, styles and navigation left out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_SKIP = {"script", "style", "nav", "head", "noscript", "template", "svg", "footer"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "header", "aside", "figure", "br", "hr", "li", "pre", "dl", "dt", "dd", "caption", "thead", "tbody", "tfoot"}
_CODE = {"code", "kbd", "samp", "tt"}
_HEADS = {f"h{i}": i for i in range(1, 7)}
#: Columns or rows that a cell covers at most, as in HTML; cells past so many columns cover none but their own. Levels of lists that indent.
_SPAN, _DEPTH = 1000, 32


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _fence(text: str, least: int) -> str:
    """Backticks that don't end within the text."""
    return "`" * max([least, *(len(x) + 1 for x in re.findall("`+", text) if len(x) >= least)])


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch("-?[0-9]{1,9}", value.strip()) else default


class _Table:
    """Rows of cells; what a cell spans besides its first column and row is empty (None)."""

    def __init__(self) -> None:
        self.rows: list[list[str | None]] = []
        self.cells: list[str | None] | None = None
        self.span: tuple[int, int] | None = None
        self.below: dict[int, int] = {}

    def begin(self) -> None:
        self.end()
        self.cells = []
        self.covered()

    def covered(self) -> None:
        """Goes on to the next column that no cell above covers."""
        while self.below.get(len(self.cells), 0):
            self.below[len(self.cells)] -= 1
            self.cells.append(None)

    def add(self, text: str) -> None:
        across, down = self.span or (1, 1)
        for i in range(min(across, max(_SPAN - len(self.cells), 1))):
            if len(self.cells) < _SPAN:
                self.below[len(self.cells)] = down - 1
            self.cells.append(None if i else text)
        self.covered()
        self.span = None

    def end(self) -> None:
        if self.cells is not None:
            self.below = {c: n - (c >= len(self.cells)) for c, n in self.below.items() if n - (c >= len(self.cells)) > 0}
            while self.cells and self.cells[-1] is None:
                self.cells.pop()
            self.rows.append(self.cells)
        self.cells = None

    def markdown(self) -> str:
        width = max(map(len, self.rows))
        lines = ["| " + " | ".join([x or "" for x in r] + [""] * (width - len(r))) + " |" for r in self.rows]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.skip: list[str] = []
        self.head = 0
        self.table: _Table | None = None
        #: Tables within a cell: their texts are the cell's.
        self.inner = 0
        self.pre = False
        #: Open links and code: (tag, href, where in text they begin).
        self.spans: list[tuple[str, str, int]] = []
        #: Open lists: number of the next item, None without numbers; and their items: the marker until it is written, then as much space.
        self.lists: list[int | None] = []
        self.items: list[tuple[int, str]] = []

    @property
    def in_cell(self) -> bool:
        return self.table is not None and self.table.span is not None

    def wrapped(self) -> None:
        """Closes the innermost link or code."""
        tag, href, start = self.spans.pop()
        raw = "".join(self.text[start:])
        text = _plain(raw)
        if not text:
            return
        if tag != "a":
            ticks = _fence(text, 1)
            text = f"{ticks} {text} {ticks}" if text[0] == "`" or text[-1] == "`" else ticks + text + ticks
        else:
            if text.count("[") != text.count("]"):
                text = text.replace("[", "\\[").replace("]", "\\]")
            text = f"[{text}](<{href}>)" if re.search(r"[\s()]", href) else f"[{text}]({href})"
        self.text[start:] = [" " * raw[0].isspace() + text + " " * raw[-1].isspace()]

    def taken(self) -> str:
        """The text so far; links and code that are open go on in what follows."""
        again = [(tag, href, 0) for tag, href, _ in self.spans]
        while self.spans and not self.pre:
            self.wrapped()
        out, self.text, self.spans = "".join(self.text), [], again
        return out

    def cut(self) -> None:
        if self.in_cell:
            self.text.append(" ")
            return
        raw = self.taken()
        text = raw.strip("\n") if self.pre else _plain(raw)
        if text:
            if self.pre:
                fence = _fence(text, 3)
                text = f"{fence}\n{text}\n{fence}"
            elif self.head:
                text, self.head = "#" * self.head + " " + text, 0
            self.put(text)

    def put(self, block: str) -> None:
        inmost = self.items[-_DEPTH:]
        before = "".join(marker for _, marker in inmost)
        self.items[-_DEPTH:] = [(of, " " * len(marker)) for of, marker in inmost]
        self.blocks.append(before + block.replace("\n", "\n" + " " * len(before)))

    def end_cell(self) -> None:
        if self.in_cell:
            self.table.add(_plain(self.taken()).replace("|", "\\|"))
            self.spans = []

    def end_table(self) -> None:
        self.end_cell()
        self.cut()
        self.table.end()
        if self.table.rows:
            self.put(self.table.markdown())
        self.table = None

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # begins after a head that nothing ended
            self.skip = [x for x in self.skip if x != "head"]
        if self.skip or tag in _SKIP:
            if tag in _SKIP:
                self.skip.append(tag)
            return
        of = dict(attrs)
        if self.pre and tag != "pre":
            if tag in _BLOCK or tag in _HEADS:
                self.text.append("\n")
        elif tag in _CODE or (tag == "a" and of.get("href")):
            self.begin_span(tag, of)
        elif tag == "table" and self.in_cell:
            self.inner += 1
            self.cut()
        elif self.inner or (self.in_cell and tag not in ("td", "th", "tr", "thead", "tbody", "tfoot")):
            if tag in _BLOCK or tag in _HEADS or tag in ("td", "th"):
                self.cut()
        elif tag in ("td", "th"):
            self.end_cell()
            self.cut()
            self.table = self.table or _Table()
            if self.table.cells is None:
                self.table.begin()
            self.table.span = tuple(min(max(_number(of.get(x), 1), 1), _SPAN) for x in ("colspan", "rowspan"))
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self.end_cell()
            self.cut()
            self.table = self.table or _Table()
            self.table.begin() if tag == "tr" else self.table.end()
        elif tag in _HEADS:
            self.cut()
            self.head = _HEADS[tag]
        elif tag == "br" and self.head:
            self.text.append(" ")
        elif tag in _BLOCK:
            self.cut()
            self.pre = tag == "pre"
            if tag == "table":
                if self.table is not None:
                    self.end_table()
                self.table = _Table()
            elif tag in ("ul", "ol"):
                self.lists.append(_number(of.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                self.item(of)

    def item(self, of: dict) -> None:
        depth = len(self.lists)
        self.end_items(depth)
        marker = "- "
        if self.lists and self.lists[-1] is not None:
            n = _number(of.get("value"), self.lists[-1])
            self.lists[-1], marker = n + 1, f"{n}. "
        self.items.append((depth, marker))

    def end_items(self, depth: int) -> None:
        while self.items and self.items[-1][0] >= depth:
            self.items.pop()

    def begin_span(self, tag: str, of: dict) -> None:
        """Links don't hold links, nor does code hold code; code around a link goes on within it."""
        if tag != "a":
            if not any(x[0] in _CODE for x in self.spans):
                self.spans.append((tag, "", len(self.text)))
            return
        self.end_span("a")
        code = [x[0] for x in self.spans]
        if code:
            self.wrapped()
        self.spans = [(x, h, len(self.text)) for x, h in [("a", _plain(of["href"])), *((x, "") for x in code)]]

    def end_span(self, tag: str) -> None:
        """Ends a link or code; what it holds goes on after it."""
        names = [x[0] for x in self.spans]
        if tag in names:
            i = names.index(tag)
            if self.pre:
                self.spans = [x for x in self.spans if x[0] != tag]
                return
            while len(self.spans) > i:
                self.wrapped()
            self.spans += [(x, "", len(self.text)) for x in names[i + 1 :]]

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "a" or tag in _CODE:
            self.end_span(tag)
        elif self.pre:
            if tag == "pre":
                self.cut()
                self.pre = False
            elif tag in _BLOCK:
                self.text.append("\n")
        elif self.inner:
            self.inner -= tag == "table"
            self.cut()
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag in ("tr", "thead", "tbody", "tfoot") and self.table is not None:
            self.end_cell()
            self.cut()
            self.table.end()
        elif tag == "table" and self.table is not None:
            self.end_table()
        elif tag in _HEADS:
            self.cut()
            self.head = 0
        elif tag in _BLOCK:
            self.cut()
            if self.in_cell:
                return
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.end_items(len(self.lists) + 1)
            elif tag == "li":
                self.end_items(len(self.lists))

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        if self.table is not None:
            self.end_table()
        self.cut()


def to_markdown(html: str | None) -> str:
    r = _Reader()
    r.feed(html or "")
    r.close()
    return "\n\n".join(r.blocks) + "\n" if r.blocks else ""


#: Rows of a batch that are objects at a time.
AT_ONCE = 1 << 6


def _in_parts(html: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([to_markdown(x) for x in html.slice(i, AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(html), AT_ONCE))])


@arrow_udf(StringType())
def _markdown(html: pa.Array) -> pa.Array:
    return _in_parts(html)


def markdown(html: Column) -> Column:
    return _markdown(html)
