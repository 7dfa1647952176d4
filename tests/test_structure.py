"""Structure of texts as expressions, against line-by-line versions."""

import random
import re
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import structure as X

BITS = ["# H\n", "## Sub #\n\n", "### \n", "#no\n", "\n", "\n\n\n", "Word word. ", "中文。", "```\ncode\n```\n", "  ```py\nx = 1\n", "\f", "1. Intro\n", "1.2.3 x\n", "ALL CAPS HEADING\n", "Chapter 3: x\n", "Kapitel IV. y\n"]
BITS += ["第三章 z\n", "---\n", "Seite 3 von 4\n", "page 7\n", "| a | b |\n", " | a | \n", "ü", "x" * 300, " # q\n", "\r\n", " mit ", "\u2003```\n"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", "\n", "```", "```\n```", "a\n```\nb\n```\nc", "```\n", "#", "# a\n## b\n# c\n### d\n## e"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string")


def lines_of(text):
    at, open_ = 0, False
    for line in text.split("\n"):
        fence = line.strip().startswith("```")
        open_ ^= fence
        yield at, line, open_ or fence, fence
        at += len(line) + 1


def title(line):
    m = re.match(r"(#{1,6})[ \t\f\r]+(.+)$", line)
    t = m[2].strip().rstrip("#").strip() if m else ""
    return (len(m[1]), t) if t else None


def like(pattern, line):
    return bool(re.match(pattern, line, re.A))


def test_profiles(docs, texts):
    got = {int(r["doc_id"]): r for r in X.profiles(docs).collect()}
    for i, text in [*enumerate(texts), (-1, "")]:
        rows = list(lines_of(text)) if text else []
        plain = [line for _, line, code, _ in rows if not code]
        levels, rest = [title(x)[0] for x in plain if title(x)], [x for x in plain if not title(x)]
        n = lambda pattern, rest=rest: sum(like(pattern, x) for x in rest)
        chapters = sum(n(x) for x in X.CHAPTERS.values())
        counts = {k: levels.count(k) for k in sorted(set(levels))}
        level = next((k for k, c in counts.items() if c >= 3), max(counts, default=0))
        r = got[i]
        assert (r["total_chars"], r["total_lines"], r["headings"], r["heading_counts"], r["dominant_level"]) == (len(text), len(rows), len(levels), counts, level), text
        assert (r["numbered"], r["chapters"], r["all_caps"], r["separators"], r["footers"]) == (n(X.NUMBERED), chapters, n(X.ALL_CAPS), n(X.SEPARATOR_LINE), n(X.FOOTER)), text
        assert (r["form_feeds"], r["blank_breaks"], r["has_code"]) == (text.count("\f"), text.count("\n\n\n"), any(f for *_, f in rows))
        assert r["has_tables"] == any(x.strip().startswith("|") and x.strip().endswith("|") for x in rest)
        inside = sum(len(line) for _, line, code, fence in rows if code and not fence)
        assert (r["code_ratio"], r["mean_line"], r["sd_line"]) == pytest.approx((inside / len(text) if text else 0, fmean(map(len, plain)) if plain else 0, pstdev(map(len, plain)) if plain else 0))
        markers = sum(r[x] for x in ("numbered", "chapters", "all_caps", "separators", "footers", "form_feeds"))
        tiers = ["heading"] * bool(len(levels) >= 3 and len(levels) / len(rows) > 0.005) + ["heuristic"] * bool(markers >= 5 or "\f" in text or chapters) + ["legacy"]
        assert r["tiers"] == tiers


def test_no_python_and_no_exchange_of_a_profile(spark, docs, tmp_path):
    docs.repartition(12).write.parquet(str(tmp_path / "docs"))
    plan = X.profiles(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_headings_have_what_is_above_them(docs, texts):
    got = {}
    for r in X.headings(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["level"], r["title"], r["breadcrumb"]))
    for i, text in enumerate(texts):
        held, want = [], []
        for at, line, code, _ in lines_of(text):
            if not code and (h := title(line)):
                held = [x for x in held if x[0] < h[0]] + [h]
                want.append((at, *h, "\n".join("#" * k + " " + t for k, t in held)))
        assert sorted(got.get(i, [])) == want, text


def test_boundaries(docs, texts):
    got = {}
    for r in X.boundaries(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["kind"]))
    langs = {r[0]: r[1] for r in X.profiles(docs).select(F.col("doc_id").cast("int"), "languages").collect()}
    for i, text in enumerate(texts):
        best = {}
        found = [(m.start(), "form feed") for m in re.finditer("\f", text)] + [(m.end(), "blank") for m in re.finditer("\n{3,}", text)]
        for at, line, code, _ in lines_of(text):
            kinds = [("chapter", X.CHAPTERS[k]) for k in langs[i]] + [("numbered", X.NUMBERED), ("capitals", X.ALL_CAPS), ("separator", X.SEPARATOR_LINE), ("footer", X.FOOTER)]
            found += [(at, k) for k, p in kinds if like(p, line)][:1] if not code else []
        for at, k in found:
            if 0 < at < len(text):
                best[at] = max(best.get(at, k), k, key=X.PRIORITIES.get)
        assert sorted(got.get(i, [])) == sorted(best.items()), text


def test_chunk_faults(spark):
    sizes = {"none": (500, []), "one": (900, [900]), "tiny": (400, [10, 20, 30, 300, 40]), "small": (200, [20, 20]), "over": (400, [300, 100]), "good": (200, [100, 100]), "last": (300, [90, 90, 90, 30])}
    rows = [(k, i, "x" * n) for k, (_, ns) in sizes.items() for i, n in enumerate(ns)]
    got = X.chunk_faults(spark.createDataFrame(rows, "doc_id string, start int, text string"), spark.createDataFrame([(k, t) for k, (t, _) in sizes.items()], "doc_id string, total int"), 100)
    assert {r["doc_id"]: r["fault"] for r in got.collect()} == {"none": "no chunks", "one": "one chunk for a long text", "tiny": "too many tiny chunks", "small": "all far below size", "over": "a chunk over twice the size", "good": None, "last": None}


def test_bytes_cut_no_code_point(spark):
    texts = ["", "abc", "aé", "日本語", "a𝄞b𝄞", "é" * 9, None]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    for n in (-1, 0, 1, 2, 3, 4, 5, 7, 50):
        got = [r[0] for r in d.select(T.truncated_bytes(F.col("t"), n)).collect()]
        assert got == [None if x is None else x.encode()[: max(n, 0)].decode("utf-8", "ignore") for x in texts]
