"""Splits one Markdown text into chunks: by headings, by other structure, or by separators. Plain Python on code points, for one text at a time.

The signals that choose among them are expressions of `structure`; what comes after (hashes, numbers, links) is in `chunks`.

Every chunk is a slice of the source, `source[start:end]`, after `prefix` characters of a repeated table header.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

from ..config import SplitConfig
from .structure import ALL_CAPS, CHAPTERS, FOOTER, NUMBERED, SEPARATOR_LINE

#: Longest unit that is kept whole, and how far back a forced cut looks for white space.
HARD, LOOK_BACK = 7500, 200
SEPARATORS = ("\n\n", "\n", "。")

# Patterns of structure. White space of the class is space, tab, line feed, form feed and carriage return.
_ROW = r"[ ]*\|[^\n]*\|[\r\n]+"
_ROWS = (re.compile(_ROW + r"[ \t\n\f\r]*(?:\|[ \t\n\f\r]*:?-{3,}:?[ \t\n\f\r]*)+\|[\r\n]+"), re.compile(_ROW))
#: Regions that are not cut, by what a text must hold to have one: most have none, and no pattern reads them.
PROTECTED = {
    "$$": (re.compile(r"\$\$.*?\$\$", re.S),),
    "](": (re.compile(r"!\[[^\]\n]{0,200}\]\([^)\n]{1,500}\)"), re.compile(r"\[[^\]\n]{1,200}\]\([^)\n]{1,500}\)")),
    "|\n": _ROWS,
    "|\r": _ROWS,
    "`": (re.compile(r"```(?:\w+)?[\r\n].*?```", re.S | re.A), re.compile(r"`[^`\r\n]+`")),
}
#: Places where an overlap may begin, the best first.
_BREAKS = tuple(re.compile(x) for x in (r"\n\n+", r"(?<!\n)\n(?!\n)", r"[。？！]|[.?!] "))
TABLE_START = re.compile(r"\A[ \t\n\f\r]*(?:\|[^|\n]*)+[\r\n]+[ \t\n\f\r]*(?:\|[ \t\n\f\r]*:?-{3,}:?[ \t\n\f\r]*)+\|?[\r\n]+\Z")
_HEADING = re.compile(r"^(#{1,6})[ \t\f\r]+(.+)$")
_LINE_KINDS = tuple(re.compile(x, re.A) for x in (NUMBERED, ALL_CAPS, SEPARATOR_LINE, FOOTER))
_CHAPTERS = {k: re.compile(x) for k, x in CHAPTERS.items()}


class Chunk(NamedTuple):
    text: str
    start: int
    end: int
    prefix: int = 0
    breadcrumb: str = ""


class Unit(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def real(self) -> bool:
        return self.end - self.start == len(self.text) > 0


# ---------------------------------------------------------------- protected regions and units


def protected(text: str) -> list[tuple[int, int]]:
    """Regions that are not cut: all matches, earliest and then longest first, without overlaps."""
    found = sorted((m.span() for mark, patterns in PROTECTED.items() if mark in text for p in patterns for m in p.finditer(text)), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def inside(regions: list[tuple[int, int]], at: int) -> bool:
    """Whether a position lies strictly inside a region."""
    i = bisect_right(regions, (at, -1)) - 1
    return i >= 0 and regions[i][0] < at < regions[i][1]


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """text cut at the first separator that it has, which is a piece of its own; pieces over size are cut by the next ones."""
    if len(text) <= size:
        return [text] if text else []
    for i, sep in enumerate(separators):
        if sep in text and text != sep:
            out: list[str] = []
            for k, gap in enumerate(text.split(sep)):
                if k:
                    out.append(sep)
                if len(gap) > size:
                    out += pieces(gap, size, separators[i + 1 :])
                elif gap:
                    out.append(gap)
            return out
    return [text]


def forced(text: str, start: int) -> list[Unit]:
    """Runs of at most HARD, cut after white space near their end where there is some."""
    out, at = [], 0
    while at < len(text):
        cut = min(at + HARD, len(text))
        if cut < len(text):
            back = max(text.rfind("\n", cut - LOOK_BACK + 1, cut), text.rfind(" ", cut - LOOK_BACK + 1, cut))
            cut = back + 1 if back > at else cut
        out.append(Unit(text[at:cut], start + at, start + cut))
        at = cut
    return out


def units(text: str, size: int) -> list[Unit]:
    out: list[Unit] = []
    at = 0

    def gap(a: int, b: int) -> None:
        for p in pieces(text[a:b], size):
            out.append(Unit(p, a, a := a + len(p)))

    for a, b in protected(text):
        gap(at, a)
        out.extend([Unit(text[a:b], a, b)] if b - a <= HARD else forced(text[a:b], a))
        at = b
    gap(at, len(text))
    return out


# ---------------------------------------------------------------- tables


def columns(row: str) -> int:
    """Cells of the first table row of a text, without a blank edge on either side."""
    line = next((x for x in row.splitlines() if "|" in x), "")
    cells = line.strip().split("|")
    return len(cells) - (not cells[0].strip()) - (len(cells) > 1 and not cells[-1].strip())


class TableHeader:
    """Follows units and holds the header of the table that they are in."""

    def __init__(self) -> None:
        self.text: str | None = None
        self.unnamed = self.breaking = False

    def feed(self, unit: str) -> bool:
        """True if a table ended such that the chunk before this unit should end."""
        row, ended = unit.lstrip().startswith("|"), False
        if self.breaking:
            self.text, self.breaking, ended = None, False, row
        if self.text is not None and not row:
            self.text = None
        if self.text is not None and not self.unnamed:
            if re.search(r"\n[ \t\r]*\n\s*\Z", unit):
                self.breaking = True
            elif columns(unit) != columns(self.text):
                self.text, ended = None, True
        elif self.text is not None and self.unnamed:
            dashes = self.text.lstrip("\n").split("\n", 1)[1]
            self.text, self.unnamed = unit.rstrip("\n") + "\n" + dashes, False
        if self.text is None and TABLE_START.match(unit):
            self.text = unit
            self.unnamed = not unit.strip().split("\n", 1)[0].replace("|", "").strip()
        return ended


# ---------------------------------------------------------------- merging


def overlap(held: list[Unit], budget: int) -> list[Unit]:
    """The end of what was emitted that the next chunk repeats: from the best and then earliest boundary within budget; none without one."""
    if budget <= 0:
        return []
    text, start = "", None
    for u in reversed(held):
        if not u.real or len(text) >= budget + 4:
            break
        text, start = u.text + text, u.start
    if start is None:
        return []
    cut = max(0, len(text) - budget - 4)
    text, start = text[cut:], start + cut
    regions, least = protected(text), len(text) - budget
    for pattern in _BREAKS:
        for a, b in (m.span() for m in pattern.finditer(text)):
            if b >= least and not inside(regions, a) and text[b:].strip() and len(text) - b <= budget:
                return [Unit(text[b:], start + b, start + len(text))]
    return []


def chunk_of(held: list[Unit]) -> Chunk | None:
    real = [u for u in held if u.real]
    text = "".join([u.text for u in held])
    if not real or text.isspace():
        return None
    return Chunk(text, real[0].start, real[-1].end, sum(len(u.text) for u in held if not u.real) if len(real) < len(held) else 0)


def merged(parts: list[Unit], size: int, lap: int) -> list[Chunk]:
    """Units packed up to size, with overlap, and a table's header again where its rows go on in a new chunk."""
    out: list[Chunk] = []
    held: list[Unit] = []
    width = 0  # of held
    table = TableHeader() if any("|" in u.text for u in parts) else None

    def flush() -> None:
        if (c := chunk_of(held)) is not None:
            out.append(c)

    for u in parts:
        n = len(u.text)
        if n > HARD:
            flush()
            held, width = [], 0
            if table:
                table.feed(u.text)
            out += [c for x in forced(u.text, u.start) if (c := chunk_of([x]))]
            continue
        if table and table.feed(u.text):
            flush()
            held, width = [], 0
        head = table.text if table and table.text and len(table.text) <= size else ""
        if held and width + n + len(head) > size:
            flush()
            held = overlap(held, min(lap, size - n))
            if head and len(head) + n <= size:
                while held and sum(len(x.text) for x in held) + n + len(head) > size:
                    held = held[1:]
                near, names = "".join(x.text for x in held) + u.text, head.strip().split("\n", 1)[0]
                if names not in near and columns(u.text) == columns(head):
                    at = held[0].start if held else u.start
                    held = [Unit(head, at, at), *held]
            width = sum(len(x.text) for x in held)
        if width + n > HARD:
            flush()
            held, width = [], 0
        held.append(u)
        width += n
    flush()
    return out


def plain(text: str, config: SplitConfig) -> list[Chunk]:
    return merged(units(text, config.size), config.size, config.overlap)


# ---------------------------------------------------------------- lines


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of an ATX heading."""
    m = _HEADING.match(line)
    title = m[2].strip().rstrip("#").strip() if m else ""
    return (len(m[1]), title) if title else None


class Signals(NamedTuple):
    """What `structure.calls` found in a text: the tiers to try, the dominant level of headings and the languages."""

    tiers: tuple[str, ...] = ("legacy",)
    level: int = 0
    languages: tuple[str, ...] = ()


def unfenced(text: str):
    """(offset, line, fence) of each line; fence: None outside fences, "mark" for their bounds, "code" inside."""
    at, open_ = 0, False
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            open_ = not open_
            yield at, line, "mark"
        else:
            yield at, line, "code" if open_ else None
        at += len(line) + 1


# ---------------------------------------------------------------- tiers


def fault(chunks: list[Chunk], total: int, size: int) -> str | None:
    """Why a tier's chunks won't do, None if they will."""
    lengths = [len(c.text) for c in chunks]
    if not lengths:
        return "no chunks"
    if len(lengths) == 1 and total > 2 * size:
        return "one chunk for a long text"
    tiny = sum(n < 50 for n in lengths[:-1])
    if tiny > len(lengths) // 4 and tiny > 2:
        return "too many tiny chunks"
    if max(lengths) < size // 4 and total > size:
        return "all far below size"
    return "a chunk over twice the size" if max(lengths) > 2 * size else None


class HeadingStack:
    """The headings in force."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []

    def see(self, level: int, title: str) -> None:
        self.open = [h for h in self.open if h[0] < level] + [(level, title)]

    @property
    def breadcrumb(self) -> str:
        return "\n".join("#" * k + " " + t for k, t in self.open)


def common(a: str, b: str) -> str:
    """The lines that two breadcrumbs begin with."""
    out = []
    for x, y in zip(a.split("\n"), b.split("\n"), strict=False):
        if x != y:
            break
        out.append(x)
    return "\n".join(out)


def by_headings(text: str, config: SplitConfig, dominant: int) -> list[Chunk]:
    marks = [(at, *h) for at, line, fence in unfenced(text) if fence is None and (h := heading(line))]
    starts = sorted({0, *(at for at, level, _ in marks if level <= dominant)})
    if len(starts) == 1:
        return plain(text, config)
    out: list[Chunk] = []
    stack = HeadingStack()
    at_mark = 0
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        if at_mark < len(marks) and marks[at_mark][0] == a:
            stack.see(*marks[at_mark][1:])
            at_mark += 1
        crumbs = [(a, stack.breadcrumb)]
        while at_mark < len(marks) and marks[at_mark][0] < b:
            stack.see(*marks[at_mark][1:])
            crumbs.append((marks[at_mark][0], stack.breadcrumb))
            at_mark += 1
        section, own = text[a:b], crumbs[0][1]
        if not section.strip():
            continue
        if len(own) + 2 + len(section) <= config.size:
            out.append(Chunk(section, a, b, 0, own))
            continue
        for c in plain(section, config):
            k = bisect_right([x[0] for x in crumbs], a + c.start) - 1
            out.append(c._replace(start=a + c.start, end=a + c.end, breadcrumb=crumbs[max(k, 0)][1]))
    return coalesced(out, config.size)


def coalesced(chunks: list[Chunk], size: int) -> list[Chunk]:
    """Neighbours under a common heading joined while the first is small and both fit."""
    out: list[Chunk] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and (shared := common(last.breadcrumb, c.breadcrumb)) and last.end == c.start and not c.prefix and len(last.text) < max(200, size // 2) and len(last.text) + len(c.text) <= size:
            out[-1] = Chunk(last.text + c.text, last.start, c.end, last.prefix, shared)
        else:
            out.append(c)
    return out


def boundaries(text: str, languages: tuple[str, ...]) -> list[int]:
    """Where a text without Markdown headings may be cut; their kinds and strengths (`structure.boundaries`) don't matter to the packer."""
    found = {m.start() for m in re.finditer("\f", text)} | {m.end() for m in re.finditer(r"\n{3,}", text)}
    kinds = [_CHAPTERS[k] for k in languages or _CHAPTERS if k in _CHAPTERS] + list(_LINE_KINDS)
    found |= {at for at, line, fence in unfenced(text) if fence is None and any(x.match(line) for x in kinds)}
    regions = protected(text)
    return sorted(at for at in found if 0 < at < len(text) and not inside(regions, at))


def by_structure(text: str, config: SplitConfig, languages: tuple[str, ...]) -> list[Chunk]:
    size, lap = config.size, config.overlap
    cuts = boundaries(text, languages) if len(text) > size else []
    if not cuts:
        return plain(text, config)
    out: list[Chunk] = []

    def emit(a: int, b: int) -> None:
        if text[a:b].strip():
            out.append(Chunk(text[a:b], a, b))

    def restart(b: int) -> int:
        low = max(0, b - 2 * lap)
        within = [x for x in cuts if low <= x < b]
        line = text.rfind("\n", low, b)
        return within[-1] if within else line + 1 if 0 <= line + 1 < b and line >= 0 else max(0, b - lap)

    begin = at = 0
    for b in [*cuts, len(text)]:
        if b - at > size:
            if at > begin:
                emit(begin, at)
            for c in plain(text[at:b], config):
                out.append(c._replace(start=at + c.start, end=at + c.end))
            begin = b
        elif b - begin > size and at - begin >= max(50, size // 4):
            emit(begin, at)
            begin = max(restart(at), begin + 1) if b - restart(at) <= size else at
        at = b
    if begin < len(text):
        emit(begin, len(text))
    return out


def split(text: str, config: SplitConfig, signals: Signals) -> tuple[list[Chunk], list[tuple[str, str | None]]]:
    """Chunks of the first tier whose output is sound, and what each tier tried came to; plain splitting as the net."""
    if not text:
        return [], []
    run: dict[str, Callable] = {"heading": lambda: by_headings(text, config, signals.level), "heuristic": lambda: by_structure(text, config, signals.languages), "legacy": lambda: plain(text, config)}
    tried: list[tuple[str, str | None]] = []
    chunks: list[Chunk] = []
    for tier in signals.tiers:
        chunks = run[tier]()
        tried.append((tier, fault(chunks, len(text), config.size)))
        if tried[-1][1] is None:
            break
    return chunks, tried


# ---------------------------------------------------------------- parents and children


def joined_crumbs(parent: str, child: str) -> str:
    a, b = parent.split("\n") if parent else [], child.split("\n") if child else []
    return "\n".join(a + (b[1:] if a and b and a[-1] == b[0] else b))


def children_of(top: Chunk, config: SplitConfig, signals: Signals) -> tuple[bool, list[Chunk]]:
    """Whether a parent stays (not if its one child is the same text), and its children, placed in the text that it is from."""
    found = []
    for c in split(top.text, config, signals)[0]:
        move = lambda x: top.start + max(0, x - top.prefix)
        extra = min(max(top.prefix - c.start, 0), c.end - c.start)
        found.append(Chunk(c.text, move(c.start), move(c.end), c.prefix + extra, joined_crumbs(top.breadcrumb, c.breadcrumb)))
    return not (len(found) == 1 and found[0].text == top.text), found


class PageMap:
    """Pages by the lines of a text; unknown if there isn't a page for each line end."""

    def __init__(self, text: str, pages: list[int] | None) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.pages = pages if pages and len(pages) == text.count("\n") else None

    def of(self, start: int, end: int) -> tuple[int | None, int | None]:
        if not self.pages:
            return None, None
        line = lambda x: self.pages[min(bisect_right(self.starts, x) - 1, len(self.pages) - 1)]
        return line(start), line(max(end - 1, start))
