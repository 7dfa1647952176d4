"""Column functions on text: lengths in code points, tokens, language, hashes, ids, titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Characters a token by language.
CHARS_PER_TOKEN = {"en": 4.0, "de": 4.5, "zh": 1.7, "mixed": 3.0}
#: Words that mark German in the first 512 bytes.
GERMAN_WORDS = (" der ", " die ", " das ", " und ", " ist ", " nicht ", " mit ", " auf ")
CJK = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]"
UMLAUTS = "äöüÄÖÜß"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


#: Ends of sentences by language, for cuts inside a section.
SENTENCE_ENDS = {"zh": ("。", "！", "？", "；", "\n"), "de": (". ", "! ", "? ", "; ", "\n"), "en": (". ", "! ", "? ", "; ", "\n")}
ANY_SENTENCE_END = ("。", "！", "？", "；", ". ", "! ", "? ", "; ", "\n")


def sentence_ends(lang: str) -> tuple[str, ...]:
    return SENTENCE_ENDS.get(lang, ANY_SENTENCE_END)


def sentence_end_count(text: Column, lang: Column) -> Column:
    """How many ends of sentences of its language a text has."""
    count = lambda ends: sum(((F.length(text) - F.length(F.replace(text, F.lit(e), F.lit("")))) / len(e) for e in ends), F.lit(0.0))
    out = count(ANY_SENTENCE_END)
    for name, ends in SENTENCE_ENDS.items():
        out = F.when(lang == name, count(ends)).otherwise(out)
    return F.coalesce(out, F.lit(0.0)).cast("long")


def normal_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def token_estimate(text: Column, lang: str | Column = "mixed") -> Column:
    """Code points / ratio, rounded half up, at least 1; 0 for empty or null."""
    ratio = F.lit(CHARS_PER_TOKEN.get(lang, 3.0)) if isinstance(lang, str) else F.coalesce(F.create_map(*[F.lit(x) for kv in CHARS_PER_TOKEN.items() for x in kv])[lang], F.lit(3.0))
    n = F.length(text) / ratio
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n + 0.5))).cast("int")


def chars_for_tokens(tokens: int, lang: str = "mixed") -> int:
    return int(tokens * CHARS_PER_TOKEN.get(lang, 3.0) * 0.9) if tokens > 0 else 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, wherever it stands: inside functions of arrays no common part is found."""
    return F.transform(F.array(value), body)[0]


def truncated_bytes(text: Column, n: int) -> Column:
    """The longest beginning of at most n bytes that cuts no code point."""
    if n <= 0:
        return F.when(text.isNotNull(), "")

    def cut(held: Column) -> Column:
        begins = lambda at: ~F.substring(F.hex(F.substring(held, at + 1, 1)), 1, 1).isin("8", "9", "A", "B")  # noqa: E731  not in the midst of a code point
        at = F.when(begins(n), n)
        for back in range(1, min(n, 3) + 1):
            at = at.when(begins(n - back), n - back)
        return F.decode(F.substring(held, F.lit(1), at.otherwise(0)), "UTF-8")

    return F.when(F.octet_length(text) <= n, text).otherwise(let(F.encode(F.substring(text, 1, n + 1), "UTF-8"), cut))


def preview(text: Column, n: int = 500) -> Column:
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(truncated_bytes(text, n), F.lit("…")))


def language(text: Column) -> Column:
    """Coarse label by script: mixed, zh, de or en."""

    def counts(text: Column) -> Column:
        kept = lambda c: F.length(F.regexp_replace(text, f"[^{c}]+", ""))  # noqa: E731  runs of the rest go in one match each
        german = lambda head: F.exists(F.array(*map(F.lit, GERMAN_WORDS)), lambda w: head.contains(w))
        umlaut = kept(UMLAUTS)
        return F.struct(kept(CJK.strip("[]")).alias("cjk"), umlaut.alias("umlaut"), kept("a-zA-Z").alias("ascii"), let(F.lower(truncated_bytes(text, 512)), german).alias("german"))

    def label(n: Column) -> Column:
        cjk, latin = n["cjk"], n["umlaut"] + n["ascii"]
        total = cjk + latin
        return (
            F.when(total == 0, "mixed").when((cjk / total >= 0.15) & (latin / total >= 0.15), "mixed").when(cjk / total > 0.3, "zh")
            .when((n["umlaut"] > 0) | n["german"], "de").otherwise("en")
        )

    return F.when(text.isNotNull(), let(let(text, counts), label)).otherwise("en")


def word_list(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def collapsed(text: Column) -> Column:
    return F.array_join(word_list(text), " ")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(word_list(text), 1, n), " ")


def chunk_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of name in namespace (hex)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(doc_id: Column, hash_: Column) -> Column:
    return uuid5(F.concat(F.lit("chunk:"), doc_id, F.lit(":"), hash_))


def embedding_text(breadcrumb: Column, content: Column) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    edges = F.concat(F.substring(content, 1, 1), F.substring(content, -1, 1))  # few chunks have white space there
    body = F.when(F.rlike(edges, F.lit(r"(?U)\s")), F.regexp_replace(content, r"(?U)^\s+|\s+$", "")).otherwise(content)
    return F.when(F.coalesce(breadcrumb, F.lit("")) == "", body).otherwise(F.concat(breadcrumb, F.lit("\n\n"), body))


def heading_path(breadcrumb: Column) -> Column:
    """Lines of a breadcrumb without their marks; null if none is left."""
    parts = F.filter(F.transform(F.split(breadcrumb, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def payload_markdown(payload: Column) -> Column:
    """The `markdown` of a JSON payload, else the payload."""
    return F.when(F.ltrim(payload).startswith("{"), F.coalesce(F.get_json_object(payload, "$.markdown"), payload)).otherwise(payload)


def yields_enough(markdown: Column, pages: Column, least: int = 50) -> Column:
    return (F.octet_length(markdown) > 0) & (F.floor(F.octet_length(markdown) / F.greatest(pages, F.lit(1))) >= least)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def normal_title(title: Column) -> Column:
    x = F.translate(F.replace(F.replace(title, F.lit("+"), F.lit("plus")), F.lit("#"), F.lit("sharp")), "._-", "   ")
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def titles_match(a: Column, b: Column) -> Column:
    """Equal normal forms, or one without spaces inside the other with 8 characters in both."""
    x, y = normal_title(a), normal_title(b)
    u, v = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    return (x == y) | ((F.length(u) >= 8) & (F.length(v) >= 8) & (F.contains(u, v) | F.contains(v, u)))


def heading_hit(expected: Column, path: Column) -> Column:
    joined = F.lower(F.array_join(path, " › "))
    return F.coalesce(F.exists(expected, lambda e: F.contains(joined, F.lower(e))), F.lit(False))


def is_junk(path: Column, title: Column) -> Column:
    """Table of contents, index-like last headings, or titles of front matter."""
    last = F.lower(F.trim(F.try_element_at(path, F.lit(-1))))
    return F.coalesce(
        F.contains(F.lower(F.array_join(path, " › ")), F.lit("table of contents")) | last.isin("index", "see also", "problem", "solution"), F.lit(False)
    ) | F.coalesce(F.rlike(title, F.lit(r"(?i)(^\d+-FM-|\.(?:indd|dvi|pdf)$)")), F.lit(False))


def is_uuid(x: Column) -> Column:
    return F.rlike(x, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))


def rank_class(base: Column, candidate: Column, k: int) -> Column:
    """A missing rank counts as k + 1."""
    b, c = F.coalesce(base, F.lit(k + 1)), F.coalesce(candidate, F.lit(k + 1))
    return F.when(c < b, "improved").when(c > b, "regressed").otherwise("unchanged")
