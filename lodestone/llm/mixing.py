"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Method: of all document rates that bring every source to its target of words, the ones closest in
entropy to taking each document once are exponentially tilted: rate = exp(l * size / mean size), held at the
cap, with one dual variable l for each source. The dual is convex, and Newton's method with a bracket
finds l: every round is one join and one sum over the counts of (source, size), in Spark. The rates then
become whole copies by systematic rounding along the sizes, in parts of a source of bounded size, and a
few last picks of one document for each source close what rounding left.

Targets: sources by code point, null last, weigh `weights`, repeating, and share the words of all documents; a target stops
at `cap` times its source's words and the excess is shared again by weight until none is above.

Results for odd input: a null text has size 0, and nothing is taken of texts without words; repeated rows count and are taken each
for itself; a null id is allowed, and such rows are told apart by their place in the table; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._store import written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Rows that one rounding window has on average at most.
WINDOW_ROWS = 2000
ROUNDS, UNROLLED, CLOSE = 40, 4, 1e-9
PICKS = 4
#: Sources up to which a table with a row for each is sent to every task.
SMALL = 50_000


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= SMALL else df


def numbered(sources: DataFrame) -> DataFrame:
    """sources with `place`, 0.. by code point, null last; sorted by range, so that no task has them all."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))  # a row for each partition
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inner", inner).join(F.broadcast(counts), "part").select("source", "words", "n", (F.col("before") + F.col("inner") - 1).alias("place"))


def with_targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, words, n, place) with `target`."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(sources.withColumn("weight", weight), "weights")
    total, level = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], None
    while True:
        held = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= cap * F.col("words")
        got = rows.agg(F.sum(F.when(held, cap * F.col("words")).otherwise(0)), F.sum(F.when(~held, F.col("weight")).otherwise(0.0))).first()
        if not got[1]:
            break
        new = (total - got[0]) / got[1]
        if new == level:
            break
        level = new
    return rows.withColumn("target", F.least((cap * F.col("words")).cast("double"), F.lit(level or 0.0) * F.col("weight")))


def _rate(dual, x, cap: int):
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(dual * x, F.lit(50.0)))))


def duals(counts: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources with the dual variable `dual` that meets each target; counts: (place, size, n)."""
    count = sources.count()
    state = sources.select(
        "place", "target", (F.col("words") / F.greatest(F.col("n"), F.lit(1))).alias("mean"), (F.col("target") >= cap * F.col("words")).alias("full"),
        F.lit(0.0).alias("dual"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(1.0).alias("gap"),
    )
    state = written(state.where("mean > 0"), "duals")
    counts = counts.where("size > 0")
    for _ in range(0, ROUNDS, UNROLLED):
        for _ in range(UNROLLED):
            x = F.col("size") / F.col("mean")
            words = F.col("n") * F.col("size") * _rate(F.col("dual"), x, cap)
            slope = F.when(words < cap * F.col("n") * F.col("size"), words * x).otherwise(0.0)
            sums = counts.join(_small(state, count), "place").groupBy("place").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
            both = _small(state, count).join(sums, "place") if count > SMALL else sums.join(F.broadcast(state), "place")
            over = F.col("got") > F.col("target")
            low, high = F.when(over, F.col("low")).otherwise(F.col("dual")), F.when(over, F.col("dual")).otherwise(F.col("high"))
            step = F.col("dual") - (F.col("got") - F.col("target")) / F.col("slope")
            middle = F.when(F.abs(low) + F.abs(high) > 1e8, F.when(over, F.least(2 * F.col("dual"), F.lit(-1.0))).otherwise(F.greatest(2 * F.col("dual"), F.lit(1.0)))).otherwise((low + high) / 2)
            newton = F.when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise(middle)
            gap = F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
            state = both.select("place", "target", "mean", "full", F.when(gap <= CLOSE, F.col("dual")).otherwise(newton).alias("dual"), low.alias("low"), high.alias("high"), gap.alias("gap"))
        state = written(state, "duals")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= CLOSE:
            break
    return sources.join(_small(state.select("place", "mean", "full", "dual"), count), "place", "left")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) for every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), own.alias("row")), "sizes")
    counts = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = written(with_targets(numbered(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))), weights, cap), "targets")
    many = sources.count()
    places = sources.select(F.col("source").alias("own"), "place")
    counts = written(counts.join(_small(places, many), F.col("source").eqNullSafe(F.col("own"))).select("place", "size", "n"), "counts")
    solved = written(duals(counts, sources, cap), "solved")
    known = solved.select(F.col("source").alias("own"), "place", "words", "target", "n", "mean", "full", "dual")
    rates = rows.join(_small(known, many), F.col("source").eqNullSafe(F.col("own")))
    rate = F.when(F.col("size") > 0, _rate(F.col("dual"), F.col("size") / F.col("mean"), cap)).otherwise(0.0)
    rates = rates.select("id", "place", "size", "words", "target", rate.alias("rate"), F.pmod(F.xxhash64("id", "size", "row"), F.expr(f"n div {WINDOW_ROWS} + 1")).alias("part"))
    order = Window.partitionBy("place", "part").orderBy("size", "id")
    rates = rates.withColumn("sum", F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(order))
    before = F.coalesce(F.lag("sum").over(order), F.lit(0.0))
    copies = F.least(F.floor(F.col("sum") + 0.5) - F.floor(before + 0.5), F.lit(cap))
    taken = written(rates.select("id", "place", "size", "words", "target", "part", "row", copies.cast("long").alias("copies")), "copies")
    for _ in range(PICKS):
        last = taken
        left = last.groupBy("place").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        off = F.abs(F.abs("left") - F.col("size"))
        can = (F.col("size") > 0) & (off < F.abs("left")) & F.when(F.col("left") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        best = last.join(_small(left, many), "place").where(can).groupBy("place").agg(F.min(F.struct(off.alias("off"), "part", "row", F.signum("left").cast("long").alias("sign"))).alias("x"))
        picks = written(best.select("place", "x.part", "x.row", "x.sign"), "picks")
        if picks.isEmpty():
            break
        taken = last.join(_small(picks, many), ["place", "part", "row"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign")
    return taken.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
