"""Structure of texts as DataFrame expressions: signals of a text and the tiers that they call for, headings with what is above them, boundaries, checks of chunks.

Nothing here runs Python on rows. Lines end at line feeds; white space is Unicode's. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.text import let

# Patterns of structure of one line. White space of their classes is space, tab, form feed and carriage return.
NUMBERED = r"^[ \t]*(?:\d+(?:\.\d+){1,3}\.?|(?:\d+|[IVX]{1,5})\.)[ \t]+\S.{0,200}$"
ALL_CAPS = r"^[ \t]*([A-ZÄÖÜ][A-ZÄÖÜ \-]{3,80}):?[ \t\f\r]*$"
SEPARATOR_LINE = r"^[ \t]*(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$"
FOOTER = r"(?i)^[ \t]*(?:Seite|Page|页码?)[ \t\f\r]+\d+(?:[ \t\f\r]*(?:von|of|/)[ \t\f\r]*\d+)?[ \t]*$"
CHAPTERS = {
    "de": r"^[ \t]*(?:Kapitel|Abschnitt|Teil)[ \t\f\r]+(?:[0-9]+|[IVX]{1,5})[\.: ].{0,200}$",
    "en": r"^[ \t]*(?:Chapter|Section|Part)[ \t\f\r]+(?:[0-9]+|[IVX]{1,5})[\.: ].{0,200}$",
    "zh": r"^[ \t]*第[ \t]*[一二三四五六七八九十百千零〇0-9]+[ \t]*(?:章|节|節|部分|篇)[ \t]?.{0,200}$",
}
#: Strength of a boundary by its kind.
PRIORITIES = {"form feed": 100, "numbered": 90, "chapter": 85, "capitals": 70, "separator": 60, "footer": 50, "blank": 40}

# Kinds of lines that are counted, where they are no heading.
_KINDS = (NUMBERED, *CHAPTERS.values(), ALL_CAPS, SEPARATOR_LINE, FOOTER)

WS = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A line that opens or closes code, without its line feed.
FENCE = f"(?dm)^{WS}*```[^\\n]*"
HEADING = f"(?d)^(#{{1,6}})[ \\t\\f\\r]+(?!{WS}*#*{WS}*$)(.+)$"
TABLE_ROW = f"(?ds)^{WS}*\\|(.*\\|)?{WS}*$"
LANGUAGES = ("en", "de", "zh")
#: Begins whatever may be a heading, or is a line of another kind but a row of a table; a line without it adds nothing to their counts.
MARKED = "^(?:#{1,6}[ \\t\\f\\r]|" + "|".join(f"(?:{p})" for p in _KINDS) + ")"


#: Bytes for each core up to which a table of few files is dealt over the cores before its texts are worked on.
DEAL = 64 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """docs over all cores where few files hold them, as a file of one row group is one task whatever its rows cost. Tables of many files, or of more than
    DEAL bytes for each core, whose scans have tasks enough, stay as they are: no text of theirs is moved."""
    cores, files = docs.sparkSession.sparkContext.defaultParallelism, len(docs.inputFiles())
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(2 * cores) if 0 < files < cores and size < DEAL * cores else docs


def is_like(line: Column, pattern: str) -> Column:
    return F.rlike(line, F.lit("(?d)" + pattern))


def pieces_of_lines(text: Column) -> Column:
    """The lines of a text as arrays, in turn of those outside and inside code; lines that open or close code belong to none."""

    def inner(pieces: Column) -> Column:
        n = F.size(pieces)
        # a fence takes its whole line, so what is next to it begins or ends with that line's line feed
        lines = lambda p, i: let(F.split(p, "\n"), lambda x: F.slice(x, F.when(i > 0, 2).otherwise(1), F.size(x) - (i > 0).cast("int") - (i < n - 1).cast("int")))
        return F.transform(pieces, lines)

    return F.when(F.contains(text, F.lit("```")), let(F.split(text, FENCE), inner)).otherwise(F.array(F.split(text, "\n")))


def _outside(pieces: Column) -> Column:
    """The lines outside code."""
    return F.flatten(F.filter(pieces, lambda _, i: i % 2 == 0))


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading with a title, else 0."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_extract(line, HEADING, 2), f"^{WS}+|{WS}+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "#+$", ""), f"{WS}+$", "")


_LEVELS = tuple(f"h{k}" for k in range(1, 7))
_COUNTED = ("numbered", *CHAPTERS, "capitals", "separators", "footers", "tables")


def _line(line: Column) -> Column:
    """What one line outside code adds to the counts."""

    def fields(level: Column) -> Column:
        plain = lambda pattern: F.when((level == 0) & is_like(line, pattern), 1).otherwise(0)
        counts = [plain(p).alias(name) for name, p in zip(_COUNTED, (*_KINDS, TABLE_ROW), strict=True)]
        return F.struct(*[F.when(level == k, 1).otherwise(0).alias(h) for k, h in enumerate(_LEVELS, 1)], *counts)

    return let(heading_level(line), fields)


def _counts(lines: Column) -> Column:
    """The sums of what lines add; most lines of prose add nothing and are left out at once."""
    names = (*_LEVELS, *_COUNTED)
    zero = F.struct(*[F.lit(0).alias(x) for x in names])
    found = F.filter(lines, lambda x: F.contains(x, F.lit("|")) | is_like(x, MARKED))
    return F.aggregate(F.transform(found, _line), zero, lambda acc, x: F.struct(*[(acc[n] + x[n]).alias(n) for n in names]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _many(text: Column, part: str) -> Column:
    """How often a text holds a part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _languages(own: Column) -> Column:
    return F.when(own == "mixed", F.array(*map(F.lit, LANGUAGES))).otherwise(F.array(own))


def _own(text: Column) -> Column:
    return T.language(T.truncated_bytes(text, 4096))


def profile(text: Column) -> Column:
    """The structure signals of a text, and under `tiers` what they call for, as one struct.

    Headings, and numbered, chapter, capital, separator, footer and table lines, are counted outside code; a heading is nothing else. The dominant level is
    the shallowest with three headings, else the deepest there is, else 0. Lines have the mean and the population deviation of their lengths.
    """

    def finished(text: Column, own: Column, lines: Column, code: Column, pieces: Column) -> Column:
        n, size = F.length(text), F.size(lines)
        lengths = F.transform(lines, F.length)
        mean = F.when(size > 0, _total(lengths) / size).otherwise(0.0)
        sd = let(mean, lambda m: F.when(size > 0, F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / size)).otherwise(0.0))
        count = lambda part: _many(text, part)
        shared = F.struct(
            n.alias("total_chars"), F.when(n > 0, count("\n") + 1).otherwise(0).alias("total_lines"), count("\f").alias("form_feeds"), count("\n\n\n").alias("blank_breaks"),
            (F.size(pieces) > 1).alias("has_code"), F.when(n > 0, code / n).otherwise(0.0).alias("code_ratio"), mean.alias("mean_line"), sd.alias("sd_line"),
            F.when(n == 0, F.array().cast("array<string>")).otherwise(_languages(own)).alias("languages"),
        )
        return let(F.struct(shared.alias("of"), _counts(lines).alias("n")), _signals)

    def inner(pieces: Column) -> Column:
        code = F.aggregate(F.flatten(F.filter(pieces, lambda _, i: i % 2 == 1)), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
        lines = _outside(pieces)
        return let(F.struct(text.alias("text"), _own(text).alias("own"), F.when(F.length(text) > 0, lines).otherwise(F.slice(lines, 1, 0)).alias("lines"), code.alias("code"), pieces.alias("pieces")), lambda x: finished(*[x[k] for k in ("text", "own", "lines", "code", "pieces")]))

    return let(pieces_of_lines(text), inner)


def _headings(n: Column) -> tuple[list[tuple[int, Column]], Column, Column]:
    """Of counts: those of each level, of all headings, and the dominant level."""
    levels = [(k, n[h]) for k, h in enumerate(_LEVELS, 1)]
    dominant = F.coalesce(*[F.when(c >= 3, k) for k, c in levels], *[F.when(c > 0, k) for k, c in reversed(levels)], F.lit(0))
    return levels, sum((c for _, c in levels), F.lit(0)), dominant


def _tiers(of: Column, n: Column) -> Column:
    """The tiers that counts of lines call for; of has form_feeds and total_lines."""
    chapters, (_, headings, dominant) = sum((n[c] for c in CHAPTERS), F.lit(0)), _headings(n)
    markers = n["numbered"] + chapters + n["capitals"] + n["separators"] + n["footers"] + of["form_feeds"]
    chosen = F.when((headings >= 3) & (headings / of["total_lines"] > 0.005) & (dominant > 0), "heading"), F.when((markers >= 5) | (of["form_feeds"] > 0) | (chapters > 0), "heuristic"), F.lit("legacy")
    return F.array_compact(F.array(*chosen))


def calls(text: Column, strategy: str = "auto") -> Column:
    """What the splitter asks for of `profile`, as a struct: tiers (`chain`), level (the dominant one) and languages.

    One look over a text tells whether it has a line of any kind; most prose has none, and its lines are not counted. Languages choose among chapters, so they are empty where the heuristic tier isn't tried.
    """

    def counted(x: Column) -> Column:
        return F.struct(_tiers(x["of"], x["n"]).alias("tiers"), _headings(x["n"])[2].alias("level"))

    prose = F.struct(F.when(F.contains(text, F.lit("\f")), F.array(F.lit("heuristic"), F.lit("legacy"))).otherwise(F.array(F.lit("legacy"))).alias("tiers"), F.lit(0).alias("level"))
    of = F.struct(_many(text, "\f").alias("form_feeds"), (_many(text, "\n") + 1).alias("total_lines"))
    lines = F.struct(of.alias("of"), _counts(_outside(pieces_of_lines(text))).alias("n"))
    found = F.when(F.rlike(text, F.lit("(?dm)" + MARKED)), let(lines, counted)).otherwise(prose)

    def finished(x: Column) -> Column:
        tiers = chain(x, strategy)
        return F.struct(tiers.alias("tiers"), x["level"].alias("level"), F.when(F.array_contains(tiers, "heuristic"), let(_own(text), _languages)).otherwise(F.array().cast("array<string>")).alias("languages"))

    return let(found, finished)


def _signals(x: Column) -> Column:
    of, n = x["of"], x["n"]
    chapters, (levels, headings, dominant) = sum((n[c] for c in CHAPTERS), F.lit(0)), _headings(n)
    return F.struct(
        of["total_chars"].alias("total_chars"), of["total_lines"].alias("total_lines"), headings.alias("headings"),
        F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("n")) for k, c in levels]), lambda e: e["n"] > 0)).alias("heading_counts"),
        dominant.alias("dominant_level"), n["numbered"].alias("numbered"), chapters.alias("chapters"), n["capitals"].alias("all_caps"), n["separators"].alias("separators"), n["footers"].alias("footers"),
        of["form_feeds"].alias("form_feeds"), of["blank_breaks"].alias("blank_breaks"), of["has_code"].alias("has_code"), (n["tables"] > 0).alias("has_tables"), of["code_ratio"].alias("code_ratio"),
        of["mean_line"].alias("mean_line"), of["sd_line"].alias("sd_line"), of["languages"].alias("languages"), _tiers(of, n).alias("tiers"),
    )


def chain(profile: Column, strategy: str = "auto") -> Column:
    """The tiers to try, in order: those of a strategy, or those that the signals call for."""
    fixed = {"heading": ("heading", "legacy"), "heuristic": ("heuristic", "legacy"), "recursive": ("legacy",), "legacy": ("legacy",)}.get(strategy)
    return F.array(*map(F.lit, fixed)) if fixed else profile["tiers"]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Structure signals of each text and the tiers that they call for: a projection; a row is a document."""
    rows = dealt(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return rows.select("doc_id", profile(F.col("text")).alias("p")).select("doc_id", "p.*")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, at, line, code) of each line, from 0; at is where it begins in code points, code whether it is inside code or bounds it.

    Lines of a document are ordered by a window over it, so ids tell documents apart: a repeated id is an error of the caller.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.rlike("line", F.lit(f"(?d)^{WS}*```"))
    at = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0).cast("long"))
    return rows.select("doc_id", "line_no", at.alias("at"), "line", (fence | (F.sum(fence.cast("int")).over(upto) % 2 == 1)).alias("code"))


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, at, level, title, breadcrumb) of each heading outside code; the breadcrumb holds the headings in force, its own last.

    A heading is in force until one of its level or a shallower one. So the last heading of a level counts if no shallower one came after it.
    """
    found = lines(docs, id_col, text_col).where("not code").withColumn("level", heading_level(F.col("line"))).where("level > 0").withColumn("title", heading_title(F.col("line"))).drop("code")
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == k, F.struct("line_no", "title"))).over(upto).alias(f"last{k}") for k in range(1, 7)]
    held = found.select("*", *last)
    parts = []
    for k in range(1, 7):
        own, above = F.col(f"last{k}"), [F.coalesce(F.col(f"last{j}.line_no"), F.lit(-1)) for j in range(1, k)]
        in_force = (F.col("level") >= k) & (own["line_no"] > F.greatest(F.lit(-1), F.lit(-1), *above))
        parts.append(F.when(in_force, F.concat(F.lit("#" * k + " "), own["title"])))
    return held.select("doc_id", "line_no", "at", "level", "title", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("breadcrumb"))


def boundaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, kind, priority) of where a text may be cut that has no Markdown headings, the strongest kind of each place.

    Lines outside code count by the first kind that fits, in the order chapter, numbered, capitals, separator, footer; chapters in the languages of the text. Form feeds, and the end of three
    and more line feeds, count anywhere. The start and the end of a text are none. Places inside regions that are never cut are for the splitter to leave out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), T.language(T.truncated_bytes(text, 4096)).alias("own"))
    chapter = F.lit(False)
    for lang, pattern in CHAPTERS.items():
        chapter = chapter | (F.col("own").isin(lang, "mixed") & is_like(F.col("line"), pattern))
    kind = F.when(chapter, "chapter")
    for name, pattern in (("numbered", NUMBERED), ("capitals", ALL_CAPS), ("separator", SEPARATOR_LINE), ("footer", FOOTER)):
        kind = kind.when(is_like(F.col("line"), pattern), name)
    by_line = lines(own).where("not code").join(own.select("doc_id", "own", F.length("text").alias("n")), "doc_id").select("doc_id", "at", "n", kind.alias("kind")).where("kind is not null")

    def cuts(pattern: str, kind: str, at_end: bool) -> DataFrame:
        """Places of matches: the lengths of what is before them, added up; the gaps of a split and the matches take turns."""
        rows = own.where(F.rlike("text", F.lit(pattern))).select("doc_id", F.length("text").alias("n"), F.split("text", pattern).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
        turns = rows.select("doc_id", "n", F.posexplode(F.arrays_zip("gaps", "found")).alias("k", "t"))
        w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        gap, match = F.length("t.gaps"), F.coalesce(F.length("t.found"), F.lit(0))
        end = F.sum(gap + match).over(w)
        return turns.select("doc_id", (end if at_end else end - match).alias("at"), "n", F.lit(kind).alias("kind"), "t").where("t.found is not null").drop("t")

    rows = by_line.unionByName(cuts("\f", "form feed", False)).unionByName(cuts("\n{3,}", "blank", True)).where("at > 0 and at < n")
    priority = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[F.col("kind")]
    return rows.groupBy("doc_id", "at").agg(F.max(F.struct(priority.alias("priority"), "kind")).alias("best")).select("doc_id", "at", "best.kind", "best.priority")


def chunk_faults(chunks: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, fault) of each document of totals (doc_id, total): why its chunks (doc_id, start, text) won't do for a size, null if they will.

    Tiny chunks, of less than 50 code points, don't count where they are a document's last. One aggregate, merged before the exchange; no list of chunks is kept.
    """
    n = F.length("text").cast("long")
    # the last chunk is taken back out of the tiny ones
    held = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(n < 50).alias("tiny"), F.max(n).alias("most"), F.max_by(n, F.struct("start", n)).alias("last"))
    tiny = F.col("tiny") - (F.col("last") < 50).cast("long")
    fault = (
        F.when(F.col("n").isNull(), "no chunks").when((F.col("n") == 1) & (F.col("total") > 2 * size), "one chunk for a long text").when((tiny > F.floor(F.col("n") / 4)) & (tiny > 2), "too many tiny chunks")
        .when((F.col("most") < size // 4) & (F.col("total") > size), "all far below size").when(F.col("most") > 2 * size, "a chunk over twice the size")
    )
    return totals.join(held, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), fault.alias("fault"))
