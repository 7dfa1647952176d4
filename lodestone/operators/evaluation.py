"""Retrieval evaluation: ranks of matching titles, hit rates, MRR, junk, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import heading_hit, is_junk, rank_class, titles_match

CATEGORIES = ("exact", "conceptual", "drift")


def numbered_lines(spark, path: str, whole: bool = False) -> DataFrame:
    """(file, line, value) of text files: lines from 1 in each file, or with whole from 1 over all files in the order of their names, also where a file is read in many splits. Lines are counted for each split, which a
    line belongs to where it begins, and sums of the counts before a split say where it starts; a row for each split is all that is moved."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    before = F.coalesce(F.sum("n").over((Window.orderBy("own_file", "own_split") if whole else Window.partitionBy("own_file").orderBy("own_split")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy(F.col("file").alias("own_file"), F.col("split").alias("own_split")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select("own_file", "own_split", "first", before.alias("before"))
    return lines.join(F.broadcast(splits), (F.col("file") == F.col("own_file")) & (F.col("split") == F.col("own_split"))).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def load_cases(spark, path: str, categories=CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(cases, faults) of JSON lines: cases (file, line, id, query, …) of every line that isn't blank, faults a row (file, line, id, fault) for each broken rule. An id
    that another line had before is a fault of the later lines."""
    from ..functions.text import normal_title

    schema = "id string, query string, expected_doc_titles array<string>, category string, expected_headings array<string>, notes string, _corrupt_record string"
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    raw = lines.select("file", "line", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).select("file", "line", "j.*")
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    short = F.exists("expected_doc_titles", lambda t: F.length(F.replace(normal_title(t), F.lit(" "), F.lit(""))) < 8)
    no_titles = (F.coalesce(F.size("expected_doc_titles"), F.lit(0)) < 1) | F.coalesce(F.exists("expected_doc_titles", lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""), F.lit(False))
    rules = [
        (F.col("_corrupt_record").isNotNull(), "not JSON"), (empty("id"), "no id"), (empty("query"), "no query"), (no_titles, "no titles"),
        (~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown category"), (F.coalesce(short, F.lit(False)), "a title under 8 characters"),
    ]
    faults = raw.select("file", "line", "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))).alias("fault"))
    # of each id that occurs twice, the first place; ids that occur once move nothing but themselves
    first = raw.where(~empty("id")).groupBy(F.col("id").alias("own")).agg(F.min(F.struct("file", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = raw.join(first, F.col("id") == F.col("own")).where(F.struct("file", "line") != F.col("first")).select("file", "line", "id", F.lit("id used twice").alias("fault"))
    return raw.drop("_corrupt_record"), faults.unionByName(twice)


def ranked_hits(cases: DataFrame, results: DataFrame, top_k: int) -> DataFrame:
    """A row for each case: rank of the first result whose title matches, whether its heading matches, junk among the results.

    results: (id, rank, doc_title, heading_path); a case without results keeps null rank.
    """
    # the size of compressed files says little about rows: a table of many cases must not be sent whole to the driver and the tasks
    few = _few(cases)
    asked = cases.select("id", "expected_doc_titles", "expected_headings", "category")
    rows = results.where(F.col("rank") <= top_k).join(F.broadcast(asked) if few else asked.hint("merge"), "id")
    match = F.col("doc_title").isNotNull() & F.exists("expected_doc_titles", lambda t: titles_match(F.col("doc_title"), t))
    hit = rows.withColumn("hit", match).withColumn("junk", is_junk(F.col("heading_path"), F.col("doc_title")))
    found = hit.groupBy("id").agg(
        F.min(F.when(F.col("hit"), F.struct("rank", heading_hit(F.col("expected_headings"), F.col("heading_path")).alias("heading")))).alias("first"),
        F.count(F.lit(1)).alias("results"), F.count_if("junk").alias("junk"),
    )
    return cases.select("id", "category", F.coalesce(F.size("expected_headings"), F.lit(0)).alias("headings")).join(found if few else found.hint("merge"), "id", "left").select(
        "id", "category", F.col("first.rank").alias("rank"), F.when(F.col("headings") > 0, F.coalesce("first.heading", F.lit(False))).alias("heading_hit"),
        F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("junk", F.lit(0)).alias("junk"),
    )


def _few(cases: DataFrame) -> bool:
    return cases.limit(10_001).count() <= 10_000


def summary(ranked: DataFrame, top_k: int) -> DataFrame:
    """Rates by category and overall (category null). MRR is the mean over hits only; overall leaves out cases without results."""

    def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
        at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(8).alias("hit_8"), at(top_k).alias("hit_k"), F.avg(1.0 / F.col("rank")).alias("mrr"),
            F.count_if("heading_hit").alias("heading_hits"), F.sum("junk").alias("junk"), F.sum("results").alias("results"),
        )

    overall = rates(ranked.where("results > 0"), []).withColumn("category", F.lit(None).cast("string"))
    return rates(ranked, ["category"]).unionByName(overall)


def compared(base: DataFrame, candidate: DataFrame, top_k: int) -> DataFrame:
    """(id, base_rank, candidate_rank, verdict): shared cases by rank, others base_only or candidate_only."""
    b, c = base.select("id", F.col("rank").alias("base_rank"), F.lit(True).alias("in_base")), candidate.select("id", F.col("rank").alias("candidate_rank"), F.lit(True).alias("in_candidate"))
    rows = b.join(c.hint("merge"), "id", "full")  # neither side fits one machine
    verdict = F.when(F.col("in_candidate").isNull(), "base_only").when(F.col("in_base").isNull(), "candidate_only").otherwise(rank_class(F.col("base_rank"), F.col("candidate_rank"), top_k))
    return rows.select("id", "base_rank", "candidate_rank", verdict.alias("verdict"))


def any_results_rate(results: DataFrame) -> DataFrame:
    return results.where("error is null").agg(F.avg((F.col("results") > 0).cast("int")).alias("rate"))


def report(rows: list[dict]) -> str:
    """A Markdown table of a summary; percentages are cut to whole numbers."""
    lines = ["| category | n | hit@1 | hit@3 | hit@8 | MRR |", "|---|---|---|---|---|---|"]
    for r in sorted(rows, key=lambda r: (r["category"] is None, r["category"] or "")):
        pct = [f"{int((r[x] or 0) * 100)}%" for x in ("hit_1", "hit_3", "hit_8")]
        lines.append(f"| {r['category'] or 'overall'} | {r['n']} | {' | '.join(pct)} | {r['mrr'] or 0:.3f} |")
    return "\n".join(lines) + "\n"
