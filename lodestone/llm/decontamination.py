"""Benchmark decontamination in DataFrame operations only: documents that hold a benchmark passage.

Method: windows of a document as long as an item (in words) get a SimHash of their 5-word shingles, and so
does the item. Fingerprints of 64 bits are cut into RADIUS + 1 blocks: two that differ in at most RADIUS bits
agree in one block at least, so an equality join on (item, block, value) meets every pair within the radius.
Pairs within it are verified: shared weight / united weight of the shingle bags, a shingle weighing its count,
must reach SIMILARITY.

At a similarity of 0.8 the fingerprints of a window and its item differ in some 10 of 64 bits, up to RADIUS, and blocks that
guarantee such a radius are of 3 bits at any width (6 at most): over all windows and items they would meet nearly all pairs. So what can be
alike is found first, without loss. A window that alike holds 8/9 of the item's shingles by weight, so it lacks less weight than the item's
first n div 9 + 1 distinct shingles (by hash), its anchors, have. Texts without an anchor of any item go; of the others, each
distinct one once, only windows that hold 8/9 of an item's shingles are fingerprinted, and SimHash prunes the pairs of such windows and their
items before the exact comparison.

Words are runs of anything but ASCII white space, lower-cased. An item of fewer than five words has one shingle,
all its words. Null, empty and blank texts and items match nothing; repeated rows each get their row; ids may be null;
texts are told apart by SHA-256; extra columns are ignored, and kept by `decontaminated` whatever their names. An empty benchmark or table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import fresh, written

GRAM, RADIUS, BITS = 5, 20, 64
#: Rows of a table, and anchors (8 bytes each), up to which they are sent to every task; a join by shuffle beyond.
SMALL, ANCHORS = 200_000, 1_000_000
_SPACE = "\t\n\x0b\x0c\r "


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null or blank text."""
    clean = F.btrim(F.coalesce(F.lower(text), F.lit("")), F.lit(_SPACE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+"))


def hashes(ws: str) -> Column:
    return F.expr(f"transform({ws}, w -> xxhash64(w))")


def shingles(h: str, k: int = GRAM) -> Column:
    """Hashes of the k-word shingles of word hashes h."""
    each = ", ".join(f"{h}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({h}) < {k}, cast(array() as array<long>), transform(sequence(0, size({h}) - {k}), i -> xxhash64({k}, {each})))")


def fingerprint(shingle: str) -> Column:
    """SimHash: bit b is set where over half of the shingles, by count, have it."""
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | shiftleft(if(2 * aggregate({shingle}, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size({shingle}), 1L, 0L), b))")


def blocks(fp: str, parts: int = RADIUS + 1) -> Column:
    """(block, value) of each of `parts` runs of bits, which together are all bits."""
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fp}, {a}) & {2 ** (b - a) - 1}L").alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def shared_weight(a: str, b: str) -> Column:
    """Sum over shingles of the lesser of their counts; plain sets are intersected."""
    counted = f"aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.expr(f"if(size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), {counted})")


def _sized(df: DataFrame, count: int, most: int = SMALL) -> DataFrame:
    return F.broadcast(df) if count <= most else df


def _exploded(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, g, at, x) of rows (k, ws): the shingles of g words, for each g of sizes, at word `at`."""
    rows = rows.select("k", hashes("ws").alias("h"))
    if len(sizes) == 1:
        return rows.select("k", F.lit(sizes[0]).alias("g"), F.posexplode(shingles("h", sizes[0])).alias("at", "x"))
    each = [F.struct(F.lit(g).alias("g"), shingles("h", g).alias("x")) for g in sizes]
    return rows.select("k", F.explode(F.array(*each)).alias("s")).select("k", "s.g", F.posexplode("s.x").alias("at", "x"))


def _anchored(docs: DataFrame, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of docs (k, text) with an anchor; 64 bits of the text stand for it, which can only let more through."""
    own = F.xxhash64("text").alias("k")
    rows = docs.select(own, words(F.col("text")).alias("ws")).select("k", hashes("ws").alias("h"))
    held = rows.select("k", F.explode(F.flatten(F.array(*[shingles("h", g) for g in sizes])) if len(sizes) > 1 else shingles("h", sizes[0])).alias("x"))
    keys = written(held.join(_sized(anchors, anchors.count(), ANCHORS), "x", "left_semi").select(F.col("k").alias("own")).distinct(), "keys")
    return docs.join(_sized(keys, keys.count()), F.xxhash64("text") == F.col("own"), "left_semi")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, id_col="item_id", item_text="text") -> DataFrame:
    """(k, item, start, similarity) from docs (k, text): the best window for each text and item. k tells texts apart."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(item_text)).alias("ws")).where("size(ws) > 0")
    items = items.select("item", F.size("ws").alias("m"), hashes("ws").alias("h"))
    sizes = sorted(r[0] for r in items.select(F.least("m", F.lit(GRAM)).alias("k")).distinct().collect())  # at most GRAM values
    if not sizes:
        return docs.limit(0).select("k").join(items.limit(0).select("item")).select("k", "item", F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    whole = F.expr("cast(array() as array<long>)")
    for k in sizes:
        whole = F.when(F.least("m", F.lit(GRAM)) == k, shingles("h", k)).otherwise(whole)
    items = written(items.select("item", "m", whole.alias("bag")).withColumn("fp", fingerprint("bag")), "items")
    anchors = written(items.select(F.explode(F.expr("slice(array_sort(array_distinct(bag)), 1, size(bag) div 9 + 1)")).alias("x")).distinct(), "anchors")
    texts = _anchored(docs, anchors, sizes).groupBy("k").agg(F.first("text").alias("text"))
    texts = written(texts.select("k", words(F.col("text")).alias("ws")), "texts")
    sought = items.select("item", "m", F.size("bag").alias("n"), F.explode(F.array_distinct("bag")).alias("x"))
    found = _exploded(texts, sizes).join(sought, "x").where(F.col("g") == F.least("m", F.lit(GRAM)))
    need = "cast((8 * n + 8) div 9 as int)"
    spots = found.groupBy("k", "item", "m", "n").agg(F.collect_set("at").alias("p")).where(f"size(p) >= {need}").withColumn("p", F.sort_array("p"))
    starts = F.expr(f"array_distinct(flatten(transform(sequence(0, size(p) - {need}), j -> if(p[j + {need} - 1] - p[j] < n, sequence(greatest(0, p[j + {need} - 1] - n + 1), p[j]), cast(array() as array<int>)))))")
    spots = written(spots.select("k", "item", "m", "n", F.explode(starts).alias("start")), "spots")
    bag = F.expr("cast(array() as array<long>)")
    for k in sizes:
        bag = F.when(F.least("m", F.lit(GRAM)) == k, F.slice(F.col(f"s{k}"), F.col("start") + 1, F.col("n"))).otherwise(bag)
    texts = texts.select("k", hashes("ws").alias("h")).select("k", *[shingles("h", k).alias(f"s{k}") for k in sizes])
    seen = spots.select("k", "m", "n", "start").distinct().join(texts, "k").select("k", "m", "start", bag.alias("seen")).withColumn("seen_fp", fingerprint("seen"))
    seen = written(seen.where("size(seen) > 0"), "windows")
    left = spots.select("k", "item", "m", "start").join(seen.drop("seen"), ["k", "m", "start"]).select("k", "item", "m", "start", "seen_fp", F.explode(blocks("seen_fp")).alias("b")).select("*", "b.block", "b.value").drop("b")
    right = items.select("item", "fp", F.explode(blocks("fp")).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = left.join(right, ["item", "block", "value"]).where(f"bit_count(seen_fp ^ fp) <= {RADIUS}").select("k", "item", "m", "start").distinct()
    both = near.join(seen.drop("seen_fp"), ["k", "m", "start"]).join(items.select("item", "bag"), "item").select("k", "item", "start", F.size("bag").alias("n"), shared_weight("seen", "bag").alias("both"))
    best = written(both, "shared").where("10 * both >= 8 * (2 * n - both)").withColumn("similarity", F.col("both") / (2 * F.col("n") - F.col("both")))
    best = best.groupBy("k", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return best.select("k", "item", (-F.col("x.s")).alias("start"), "x.similarity")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, similarity): one row for each document and each item that it holds; start: first word of the best window."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    hits = written(contaminated_texts(rows.select(text_key(F.col("text")).alias("k"), "text"), benchmark, item_col, item_text), "leaks")
    out = rows.select("id", text_key(F.col("text")).alias("k")).join(_sized(hits, hits.count()), "k")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; all their columns."""
    rows, name = docs.select(F.col(text_col).alias("text")).where("text is not null"), fresh(docs, "leak")
    hits = written(contaminated_texts(rows.select(text_key(F.col("text")).alias("k"), "text"), benchmark, item_col, item_text).select(F.col("k").alias(name)).distinct(), "leaks")
    return docs.join(_sized(hits, hits.count()), text_key(docs[text_col]) == F.col(name), "left_anti")
