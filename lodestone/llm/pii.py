"""Personal data in texts: spans with kind, place and score, in DataFrame operations only.

Method: a regular expression for each kind proposes spans, leftmost first and without overlap within the kind. Validators confirm them: parts of an
address at most 255, digits counted, the Luhn sum of card numbers, the remainder by 97 of account numbers. Words near a span move its score.
Four kinds are always kept once they are confirmed (email, ip, card, phone); of the others, which numbers in prose resemble, only spans
that reach THRESHOLD are: account numbers (iban) by their checksum, US social security numbers and phone numbers without a country code by the words nearby.
Spans of the added kinds that overlap one of the four are left out, but for account numbers.

Places are code points from 0, end exclusive. They are sums of the lengths of matches and of what lies between them, added up in blocks of 256, so a text with
many spans takes time in proportion. The patterns say the same as simpler ones with greedy loops, but start at a run's first character
only and never step back, so that long runs of digits or letters cost no more than their length, and no depth of the stack.

Context of a span: at most NEAR characters before and AFTER it, as far as the next proposal of its kind.

Results for odd input: a null or empty text has no spans; ids may be null or repeat, each row has its own result; other columns are not looked
at, and `masked` keeps them whatever their names. There is no exchange, so no key can be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ._store import fresh

NEAR, AFTER, THRESHOLD = 40, 20, 0.5
_BLOCK = 256
_LOCAL, _DIGITS = r"[A-Za-z0-9._%+-]", r"regexp_replace(v, '[^0-9]', '')"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. cheap: what a text has that has a span; valid: SQL over v, the match; prior: the score without context."""

    name: str
    pattern: str
    cheap: str
    valid: str
    prior: float
    words: str
    base: bool = True


def _luhn(digits: str) -> str:
    at = f"cast(substr({digits}, length({digits}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 0, 2 * {at} - if({at} > 4, 9, 0), {at})) % 10 = 0"


def _mod97(account: str) -> str:
    turned = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    code = f"ascii(substr({turned}, i, 1))"
    return f"aggregate(sequence(1, length({account})), 0, (r, i) -> if({code} < 58, (r * 10 + {code} - 48) % 97, (r * 100 + {code} - 55) % 97)) = 1"


#: The kinds in the order in which spans of one start are listed.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({0}, '@')", "true", 0.9, "mail|email|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"{0} rlike '[0-9]\\.[0-9]'", r"forall(split(v, '\\.'), x -> length(ltrim('0', x)) < 4 and int(right(concat('0', x), 3)) < 256)", 0.6, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13}(?:[\x20-]?[0-9])*+", r"{0} rlike '[0-9](?:[\\x20-]?[0-9]){{13}}'", f"length({_DIGITS}) between 14 and 19 and {_luhn(_DIGITS)}", 0.7, "card|visa|mastercard|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({0}, '+')", f"length({_DIGITS}) between 10 and 15", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", r"{0} rlike '[A-Z]{{2}}[0-9]{{2}}'", _mod97("replace(v, ' ', '')"), 0.7, "iban|account|bank|transfer", False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"{0} rlike '[0-9]-[0-9]{{2}}-[0-9]'", "substr(v, 1, 3) not in ('000', '666') and substr(v, 1, 1) <> '9' and substr(v, 5, 2) <> '00' and substr(v, 8) <> '0000'", 0.3, "ssn|social security", False),
    Kind("local_phone", r"\b[0-9]{3}[\x20.-][0-9]{3}[.-][0-9]{4}\b", r"{0} rlike '[0-9]{{3}}[.-][0-9]{{4}}'", "true", 0.3, "phone|call|tel|mobile|fax", False),
)
GAIN = 0.3


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans (start, end, kind, score, base) by start, then in the order of kinds; base: of a kind that is always kept."""
    return _spanned(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "text", kinds).select(F.col("id").alias(id_col), "spans")


def _spanned(rows: DataFrame, text: str, kinds: tuple[Kind, ...], spans: str = "spans") -> DataFrame:
    """rows with a column of spans; rows have no column named like those made here, which begin with spans."""
    own = rows.columns
    name = lambda what, i: f"`{spans}_{what}{i}`"
    found = {}
    for i, kind in enumerate(kinds):
        cheap = kind.cheap.format(f"`{text}`")
        found[f"{spans}_p{i}"] = F.expr(f"if({cheap}, split(`{text}`, {_literal(kind.pattern)}, -1), null)")
        found[f"{spans}_m{i}"] = F.expr(f"if({cheap}, regexp_extract_all(`{text}`, {_literal(kind.pattern)}, 0), null)")
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"{spans}_s{i}": F.expr(f"transform({name('m', i)}, (v, i) -> cast(char_length({name('p', i)}[i]) + char_length(v) as bigint))") for i in range(len(kinds))})
    rows = rows.withColumns({f"{spans}_b{i}": F.expr(f"transform(sequence(0, size({name('s', i)}) div {_BLOCK}), b -> aggregate(slice({name('s', i)}, b * {_BLOCK} + 1, {_BLOCK}), 0L, (s, v) -> s + v))") for i in range(len(kinds))})
    rows = rows.withColumns({f"{spans}_o{i}": F.expr(f"transform({name('b', i)}, (v, b) -> aggregate(slice({name('b', i)}, 1, b), 0L, (s, x) -> s + x))") for i in range(len(kinds))})
    each = {}
    for i, kind in enumerate(kinds):
        end = f"{name('o', i)}[i div {_BLOCK}] + aggregate(slice({name('s', i)}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0L, (s, x) -> s + x)"
        near = f"lower(concat(right({name('p', i)}[i], {NEAR}), ' ', left({name('p', i)}[i + 1], {AFTER}))) rlike '\\\\b(?:{kind.words})'"
        score = f"if({near}, least(1D, {kind.prior}D + {GAIN}D), {kind.prior}D)"
        match = f"transform({name('m', i)}, (v, i) -> if({kind.valid}, named_struct('e', {end}, 'n', char_length(v), 'score', {score}), null))"
        kept = f"filter({match}, x -> x is not null and ({str(kind.base).lower()} or x.score >= {THRESHOLD}D))"
        each[f"{spans}_k{i}"] = F.expr(f"transform(coalesce({kept}, array()), x -> named_struct('start', x.e - x.n, 'order', {i}, 'end', x.e, 'kind', '{kind.name}', 'score', x.score, 'base', {str(kind.base).lower()}))")
    rows = rows.select(*[F.col(f"`{c}`") for c in own], *[c.alias(n) for n, c in each.items()])
    base = "concat(" + ", ".join(name("k", i) for i, kind in enumerate(kinds) if kind.base) + ")"
    more = ", ".join(name("k", i) if kind.name == "iban" else f"filter({name('k', i)}, x -> not exists(`{spans}_base`, y -> y.start < x.end and x.start < y.end))" for i, kind in enumerate(kinds) if not kind.base)
    rows = rows.withColumn(f"{spans}_base", F.expr(base))
    every = f"array_sort(concat(`{spans}_base`{', ' + more if more else ''}))"
    return rows.select(*[F.col(f"`{c}`") for c in own], F.expr(f"transform({every}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'score', x.score, 'base', x.base))").alias(spans))


def masked(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; of overlapping spans the first stands for all. Nulls stay null."""
    spans = fresh(docs, "spans")
    while any(c.lower().startswith(f"{spans}_") for c in docs.columns):
        spans = fresh(docs, f"{spans}_")
    text = f"`{text_col}`"
    rows = _spanned(docs, text_col, kinds, spans)
    step = f"if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), named_struct('at', x.end, 'out', concat(a.out, substring({text}, int(a.at) + 1, int(x.start - a.at)), '<', x.kind, '>')))"
    changed = f"aggregate(`{spans}`, named_struct('at', 0L, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, int(a.at) + 1)))"
    return rows.withColumn(text_col, F.expr(f"if(size(`{spans}`) > 0, {changed}, {text})")).select(*[F.col(f"`{c}`") for c in docs.columns])
