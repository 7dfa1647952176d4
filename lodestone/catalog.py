"""The library's queries over the given tables, each with its SQL where SQL can express it.

Documents stand for chunks (source: collection), embeddings for their vectors (label: model group), events for shards, calls
and queue entries, labels for completeness, conversations for shards of Markdown, pages for HTML sources.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import text as T
from .functions.metadata import metadata_filter
from .operators import evaluation, events as event_rows, index, metrics, retrieval, shards, structure, vector_index
from .operators.index import Index, clause
from .operators.vector_index import VectorIndex, nearest_of_each
from .plans import views
from .plans.engine import Engine
from .session import shared_folder, shared_path
from .sources import feeds, formats, page_rows
from .sources.tables import Change, Tables
from .sources.versions import fingerprint
from .streaming import event_log, intake, jobs, leases, rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The query text of the retrieval queries and its terms.
ASKED = "the worthless reand of thion"
TERMS = sorted(set(ASKED.split()))
K = 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents in the shared folder, under the digest of the table's files; written where that is absent, as `build_index` does."""
    table = f"{sf_dir}/documents.parquet"
    path = f"{shared_folder(spark)}/index-{index.FORMAT}-{fingerprint(spark, table)}"
    found = Index(spark, path)
    return found if found.version else Index.create(_chunk_rows(spark, sf_dir), path, "doc_id", ("text",), ("collection_id",))


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection_id"), "text")


# ---------------------------------------------------------------- retrieval

_DENSE = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
    dist AS (SELECT vec_id AS id, label, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS distance
             FROM embeddings, q WHERE len(embedding) = len(v))"""
_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _bm25(where: str = "TRUE") -> str:
    return rf"""toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents WHERE {where}),
    lens AS (SELECT id, len(t) AS dl, t FROM toks),
    stat AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS mean FROM lens),
    tfs AS (SELECT id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM lens, (SELECT unnest([{_TERM_LIST}]) AS term)),
    dfs AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tfs GROUP BY term),
    bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tfs JOIN dfs USING (term), stat WHERE tf > 0 GROUP BY id)"""


@query(f"WITH {_DENSE} SELECT id AS vec_id, round(distance, 9) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM dist ORDER BY distance, id LIMIT 25")
def dense_topk(spark, sf_dir):
    top = retrieval.dense_top(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 25, "vec_id")
    return top.select(F.col("id").alias("vec_id"), (F.round("distance", 9) + 0.0).alias("distance"), "rank")


@query(f"""WITH {_DENSE}, f AS (SELECT dist.* FROM dist JOIN documents d ON d.doc_id = dist.id WHERE d.source IN ('src0', 'src1', 'src2', 'src3') AND d.lang = 'en')
    SELECT id AS vec_id, round(distance, 9) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM f ORDER BY distance, id LIMIT 10""")
def dense_topk_filtered(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3") & (F.col("lang") == "en"))
    rows = _table(spark, sf_dir, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    top = retrieval.dense_top(rows, _vector(spark, sf_dir), 10, "vec_id")
    return top.select(F.col("id").alias("vec_id"), (F.round("distance", 9) + 0.0).alias("distance"), "rank")


@query(f"WITH {_bm25()} SELECT id AS doc_id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM bm ORDER BY round(score, 9) DESC, id LIMIT 25")
def bm25_topk(spark, sf_dir):
    top = _index(spark, sf_dir).top(ASKED, 25)
    top = top.select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM p GROUP BY term""")
def bm25_postings_stats(spark, sf_dir):
    return retrieval.term_stats(_table(spark, sf_dir, "documents"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
    SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS words, count(DISTINCT term) AS terms, count(DISTINCT (term, doc_id)) AS entries FROM t""")
def build_index(spark, sf_dir):
    """A new index, and what it holds."""
    made = Index.create(_chunk_rows(spark, sf_dir), shared_path(spark, "index"), "doc_id", ("text",), ("collection_id",))
    return made.stats()


def _best(top: DataFrame) -> DataFrame:
    return top.select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


_BEST = "SELECT id AS doc_id, round(score, 9) AS score FROM bm ORDER BY score DESC, id LIMIT 25"


@query(f"WITH {_bm25('doc_id % 5 <> 0')} {_BEST}")
def search_after_changes(spark, sf_dir):
    """An index of two loads, without the rows deleted since."""
    rows = _chunk_rows(spark, sf_dir)
    made = Index.create(rows.where("doc_id % 2 = 0"), shared_path(spark, "index"), "doc_id", ("text",), ("collection_id",))
    made = made.insert(rows.where("doc_id % 2 = 1")).delete(rows.where("doc_id % 5 = 0").select("doc_id"))
    return _best(made.top(ASKED, 25))


@query(f"WITH {_bm25('doc_id % 5 <> 0')} {_BEST}")
def search_after_merge(spark, sf_dir):
    """The same after its segments have been merged into one without the deleted rows."""
    rows = _chunk_rows(spark, sf_dir)
    made = Index.create(rows.where("doc_id % 2 = 0"), shared_path(spark, "index"), "doc_id", ("text",), ("collection_id",))
    made = made.insert(rows.where("doc_id % 2 = 1")).delete(rows.where("doc_id % 5 = 0").select("doc_id"))
    return _best(made.merge().top(ASKED, 25))


#: Lists of tokens, and the score of tf occurrences in a text of length dl where df of n texts have any.
_TOKENS = r"""t AS (SELECT doc_id AS id, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t, regexp_extract_all(lower(source), '[\p{L}\p{N}]+') AS s FROM documents),
    stat AS (SELECT count(*) AS n, avg(len(t)) AS mean, avg(len(t) + coalesce(len(s), 0)) AS mean2 FROM t)"""
_IDF = "ln(1 + (n - {0} + 0.5) / ({0} + 0.5))"
_WEIGHT = "{0} * 2.2 / ({0} + 1.2 * (0.25 + 0.75 * {1} / {2}))"
_COUNT = "len(list_filter(t, lambda x: x = '{0}'))"


def _phrase(a: str, b: str, slop: int) -> str:
    """SQL for the places of a that a b follows with at most slop words between."""
    return f"len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{a}' AND list_contains(t[i + 1 : i + 1 + {slop}], '{b}')))"


@query(f"""WITH {_TOKENS}, f AS (SELECT id, len(t) AS dl, {_COUNT.format('the')} AS a, {_COUNT.format('of')} AS b, {_phrase('the', 'of', 3)} AS tf FROM t),
    d AS (SELECT count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f)
    SELECT id AS doc_id, round(({_IDF.format('da')} + {_IDF.format('db')}) * {_WEIGHT.format('tf', 'dl', 'mean')}, 9) AS score FROM f, d, stat WHERE tf > 0 ORDER BY score DESC, id LIMIT 25""")
def phrase_search(spark, sf_dir):
    """Two words in this order, at most three others between."""
    return _best(_index(spark, sf_dir).top([clause("the of", slop=3)], 25))


@query(f"""WITH {_TOKENS}, f AS (SELECT id, len(t) AS dl, {_COUNT.format('the')} AS a, {_COUNT.format('of')} AS b, {_COUNT.format('und')} AS c, {_COUNT.format('reand')} AS e FROM t),
    d AS (SELECT count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE e > 0) AS de FROM f)
    SELECT id AS doc_id, round({_IDF.format('da')} * {_WEIGHT.format('a', 'dl', 'mean')} + CASE WHEN b > 0 THEN 2.5 * {_IDF.format('db')} * {_WEIGHT.format('b', 'dl', 'mean')} ELSE 0 END + CASE WHEN e > 0 THEN {_IDF.format('de')} * {_WEIGHT.format('e', 'dl', 'mean')} ELSE 0 END, 9) AS score
    FROM f, d, stat WHERE a > 0 AND c = 0 ORDER BY score DESC, id LIMIT 25""")
def boolean_search(spark, sf_dir):
    """One word must occur, one must not, two add to the score, one of them more."""
    return _best(_index(spark, sf_dir).top([clause("the", "all"), clause("und", "none"), clause("of", boost=2.5), clause("reand")], 25))


@query(f"""WITH {_TOKENS}, f AS (SELECT id, len(t) + len(s) AS dl, len(list_filter(s, lambda x: x = 'src1')) AS a, {_COUNT.format('thion')} AS b, {_phrase('the', 'of', 0)} AS p, {_COUNT.format('the')} AS c, {_COUNT.format('of')} AS e FROM t),
    d AS (SELECT count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc, count(*) FILTER (WHERE e > 0) AS de FROM f)
    SELECT id AS doc_id, round({_IDF.format('da')} * {_WEIGHT.format('a', 'dl', 'mean2')} + CASE WHEN b > 0 THEN {_IDF.format('db')} * {_WEIGHT.format('b', 'dl', 'mean2')} ELSE 0 END + CASE WHEN p > 0 THEN ({_IDF.format('dc')} + {_IDF.format('de')}) * {_WEIGHT.format('p', 'dl', 'mean2')} ELSE 0 END, 9) AS score
    FROM f, d, stat WHERE a > 0 ORDER BY score DESC, id LIMIT 25""")
def field_search(spark, sf_dir):
    """A word that must occur in one field, a word and a phrase in the other."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = Index.create(rows, shared_path(spark, "index"), "doc_id", ("source", "text"))
    return _best(made.top([clause("src1", "all", field="source"), clause("thion", field="text"), clause("the of", slop=0, field="text")], 25))


@query(f"""WITH {_DENSE}, {_bm25()},
    d AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM dist ORDER BY distance, id LIMIT {K}),
    b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm ORDER BY round(score, 9) DESC, id LIMIT {K}),
    f AS (SELECT coalesce(d.id, b.id) AS id, coalesce(1.0 / (60 + d.r), 0) + coalesce(0.3 / (60 + b.r), 0) AS score, d.r AS dense_rank, b.r AS bm25_rank FROM d FULL JOIN b ON d.id = b.id)
    SELECT f.id AS doc_id, round(score, 12) AS score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, doc.lang AS lang, substr(doc.text, 1, 80) AS head
    FROM f JOIN documents doc ON doc.doc_id = f.id ORDER BY score DESC, f.id LIMIT {K}""")
def hybrid_rrf_topk(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    dense = retrieval.dense_top(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), K, "vec_id")
    hits = retrieval.fused(dense, _index(spark, sf_dir).top(ASKED, K))
    rows = retrieval.with_rows(hits, docs, "doc_id").orderBy(F.desc("score"), "doc_id").limit(K)
    return rows.select("doc_id", F.round("score", 12).alias("score"), "dense_rank", "bm25_rank", "lang", F.substring("text", 1, 80).alias("head"))


@query(f"""WITH {_DENSE}, {_bm25()},
    d AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS r FROM dist QUALIFY r <= {K}),
    b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm ORDER BY round(score, 9) DESC, id LIMIT {K}),
    u AS (SELECT id, 1.0 / (60 + r) AS s FROM d UNION ALL SELECT id, 0.3 / (60 + r) FROM b)
    SELECT u.id AS doc_id, round(sum(s), 12) AS score, any_value(octet_length(encode(text))) AS bytes FROM u JOIN documents ON doc_id = u.id GROUP BY u.id ORDER BY sum(s) DESC, u.id LIMIT {K}""")
def multi_group_rrf(spark, sf_dir):
    docs, vectors, q = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)
    legs = [(_index(spark, sf_dir).top(ASKED, K), 0.3), (retrieval.dense_top_groups(vectors, q, K, "label", "vec_id"), 1.0)]
    top = retrieval.with_rows(retrieval.fused_legs(legs), docs, "doc_id").orderBy(F.desc("score"), "doc_id").limit(K)
    return top.select("doc_id", F.round("score", 12).alias("score"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"""WITH {_DENSE}, {_bm25()}, pool AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM dist ORDER BY distance, id LIMIT 30),
    s AS (SELECT id, r, length(text) % 97 AS score FROM pool JOIN documents ON doc_id = id)
    SELECT id AS doc_id, CAST(score AS DOUBLE) AS score FROM s ORDER BY score DESC, r LIMIT {K}""")
def rerank_pool(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    pool = retrieval.dense_top(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 30, "vec_id")
    hits = retrieval.with_rows(pool, docs, "doc_id").select(F.col("doc_id").alias("chunk_id"), "text", (-F.col("rank")).cast("double").alias("score"), F.lit(False).alias("reranked"))
    out = retrieval.reranked(hits, ASKED, lambda _, texts: [len(t) % 97 for t in texts], K)
    return out.select(F.col("chunk_id").alias("doc_id"), "score")


#: Chunks are the documents' texts below one parent for ten of them; the collections of even sources have model m0, those of odd ones m1.
_PARENTS = 10_000_000


def _engine(spark, sf_dir) -> Engine:
    docs, vectors = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    up = F.expr(f"{_PARENTS} + doc_id div 10")
    path = F.lit(None).cast("array<string>").alias("heading_path")
    page = F.lit(None).cast("int")
    low = docs.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("id"), "doc_id", F.col("source").alias("collection_id"), up.alias("parent_id"), F.lit(False).alias("is_parent"), page.alias("page_start"), page.alias("page_end"), path, "text", "embedding")
    top = docs.where("doc_id % 10 = 0").select(up.alias("id"), "doc_id", F.col("source").alias("collection_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(True).alias("is_parent"), page.alias("page_start"), page.alias("page_end"), path, F.concat(F.lit("parent "), up).alias("text"), F.lit(None).cast("array<float>").alias("embedding"))
    rows = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("title "), "doc_id").alias("title"), F.expr("if(doc_id % 3 = 0, 0.5D, 1D)").alias("completeness"), F.to_json(F.struct("lang")).alias("metadata"), F.col("source").alias("author"))
    cols = docs.select(F.col("source").alias("id")).distinct().withColumn("embedding_model_id", F.concat(F.lit("m"), F.expr("cast(substr(id, 4) as int) % 2")))
    given = {"m0": _vector(spark, sf_dir), "m1": _vector(spark, sf_dir, 1)}
    return Engine(rows, low.unionByName(top), cols, embed=lambda model, _: given[model], index=_index(spark, sf_dir))


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "doc_id", "title", "parent_text", F.round("score", 12).alias("score"), "partial")


_HIT = f"""f.id AS chunk_id, f.id AS doc_id, 'title ' || f.id AS title, CASE WHEN EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = f.id - f.id % 10) THEN 'parent ' || ({_PARENTS} + f.id // 10) ELSE '' END AS parent_text,
    round(score, 12) AS score, f.id % 3 = 0 AS partial FROM f ORDER BY score DESC, f.id LIMIT {K}"""


def _legs(where: str) -> str:
    return rf"""{_bm25(where)}, dist AS (SELECT vec_id AS id, 1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))) AS distance, m
             FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN qs ON m = CAST(substr(source, 4) AS INTEGER) % 2 WHERE {where}),
        d AS (SELECT id, row_number() OVER (PARTITION BY m ORDER BY distance, id) AS r FROM dist QUALIFY r <= {K}),
        b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY score DESC, id LIMIT {K}),
        f AS (SELECT id, sum(s) AS score FROM (SELECT id, 1.0 / (60 + r) AS s FROM d UNION ALL SELECT id, 0.3 / (60 + r) FROM b) GROUP BY id)"""


_QS = "qs AS (SELECT vec_id AS m, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (0, 1))"


@query(f"WITH {_QS}, {_legs("source = 'src0' AND lang = 'en'")} SELECT {_HIT}")
def search_one_collection(spark, sf_dir):
    return _hits(_engine(spark, sf_dir).search(ASKED, ["src0"], {"lang": "en"}))


@query(f"WITH {_QS}, {_legs("source IN ('src0', 'src1', 'src3', 'src4') AND lang = 'en'")} SELECT {_HIT}")
def search_in_scope(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.scope = ["src0", "src1", "src3", "src4"]
    return _hits(engine.search(ASKED, metadata={"lang": "en"}))


@query("SELECT doc_id AS id, source AS collection_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'de'")
def search_candidates(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return retrieval.candidates(e.chunks, ["src0", "src1", "src2"], ["src1", "src2"], e.documents, metadata_filter({"lang": "de"})).select("id", "collection_id")


@query("SELECT source AS id, 'm' || CAST(substr(source, 4) AS INTEGER) % 2 AS embedding_model_id, count(*) AS documents FROM documents GROUP BY source")
def list_collections(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.collections, e.documents = e.collections.withColumn("created_at", F.lit(0)), e.documents.withColumn("collection_id", F.col("author"))
    return e.list_collections().select("id", "embedding_model_id", "documents")


def _vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The vector index of the embeddings in the shared folder, under the digest of the table's files."""
    path = f"{shared_folder(spark)}/vectors-{vector_index.FORMAT}-{fingerprint(spark, f'{sf_dir}/embeddings.parquet')}"
    found = VectorIndex(spark, path)
    return found if found.version else VectorIndex.create(_table(spark, sf_dir, "embeddings"), path, "vec_id", keep=("label",))


@query("SELECT 64 AS dim, count(*) AS vectors, count(DISTINCT vec_id) AS ids FROM embeddings WHERE len(embedding) = 64")
def build_vector_index(spark, sf_dir):
    """A new vector index, and how many vectors its lists hold."""
    made = VectorIndex.create(_table(spark, sf_dir, "embeddings"), shared_path(spark, "vectors"), "vec_id", keep=("label",))
    return made.vectors(64).agg(F.lit(64).alias("dim"), F.count(F.lit(1)).alias("vectors"), F.count_distinct("id").alias("ids"))


@query(f"WITH {_DENSE} SELECT id AS vec_id, round(distance, 9) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM dist ORDER BY distance, id LIMIT 25")
def vector_index_exact(spark, sf_dir):
    top = _vectors(spark, sf_dir).nearest(_vector(spark, sf_dir), 25)
    return top.select(F.col("id").alias("vec_id"), (F.round("distance", 9) + 0.0).alias("distance"), "rank")


@query(f"""WITH {_DENSE}, f AS (SELECT * FROM dist WHERE id % 3 <> 0 OR id % 2 = 0), g AS (SELECT * FROM f WHERE label IS NULL OR label % 2 = 0)
    SELECT id AS vec_id, round(distance, 9) + 0.0 AS distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank FROM g ORDER BY distance, id LIMIT 25""")
def vector_index_after_changes(spark, sf_dir):
    """Two loads, rows deleted since, and a filter."""
    rows = _table(spark, sf_dir, "embeddings")
    made = VectorIndex.create(rows.where("vec_id % 2 = 0"), shared_path(spark, "vectors"), "vec_id", keep=("label",))
    made = made.insert(rows.where("vec_id % 2 = 1")).delete(rows.where("vec_id % 3 = 0 and vec_id % 2 = 1").select("vec_id"))
    top = made.nearest(_vector(spark, sf_dir), 25, among=rows.where("label is null or label % 2 = 0").select("vec_id"))
    return top.select(F.col("id").alias("vec_id"), (F.round("distance", 9) + 0.0).alias("distance"), "rank")


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, r.vec_id, round(1 - list_dot_product(q.v, r.v) / (q.n * r.n), 9) + 0.0 AS distance FROM u q, u r WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""")
def batch_dense_search(spark, sf_dir):
    """The ten nearest vectors of each twentieth one."""
    rows = _table(spark, sf_dir, "embeddings")
    top = nearest_of_each(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "embedding", "vec_id", "embedding").toDF("query_id", "vec_id", "distance", "rank")
    return top.withColumn("distance", F.round("distance", 9) + 0.0)


#: A query for each twentieth document: its first six words.
_FIRST_WORDS = "array_join(slice(regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}]+', 0), 1, 6), ' ')"


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
    stat AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS mean FROM t), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT doc_id AS query_id, unnest(t[1:6]) AS term FROM t WHERE doc_id % 20 = 0),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM q JOIN p USING (term) JOIN df USING (term), stat GROUP BY ALL)
    SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def batch_bm25_search(spark, sf_dir):
    """The ten best documents for the first words of each twentieth one."""
    asked = _table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.expr(_FIRST_WORDS).alias("query"))
    top = _index(spark, sf_dir).top_of_each(asked, 12).select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))
    # ties of rounded scores by id
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")


# ---------------------------------------------------------------- streams and tables in versions


def _in_loads(rows: DataFrame, parts: list[str], run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a stream of rows that come in loads, one for each condition, in their order: each is a batch, in as many files as tasks wrote it, however large it is."""
    spark = rows.sparkSession
    path = shared_path(spark, "stream")
    for part in parts:
        rows.where(part).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@query("""WITH e AS (SELECT date_trunc('minute', ts) AS bucket, user_id % 20 + 1 AS pages, event_type = 'error' AS failed, CAST(round(value * 100) AS BIGINT) AS ms, user_id % 700 AS rss FROM events)
    SELECT bucket, CAST(sum(pages) AS BIGINT) AS pages_parsed, count(*) AS shards_done, count(*) FILTER (WHERE failed) AS shards_failed,
    list_sort(list(ms) FILTER (WHERE NOT failed))[(count(ms) FILTER (WHERE NOT failed) - 1) * 50 // 100 + 1] AS parse_p50_ms, list_sort(list(ms) FILTER (WHERE NOT failed))[(count(ms) FILTER (WHERE NOT failed) - 1) * 95 // 100 + 1] AS parse_p95_ms,
    list_sort(list(rss) FILTER (WHERE NOT failed))[(count(rss) FILTER (WHERE NOT failed) - 1) * 95 // 100 + 1] AS peak_rss_p95_mb FROM e GROUP BY bucket""")
def rollup_stream(spark, sf_dir):
    """The rollup of a stream of three batches that share their minutes, kept in a versioned table."""
    events = _table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("done_at"), F.lit(1).alias("page_start"), (F.col("user_id") % 20 + 1).alias("page_end"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (F.col("user_id") % 700).cast("int").alias("peak_rss_mb"), "event_id",
    )
    path, checkpoint = shared_path(spark, "rollup"), shared_path(spark, "checkpoint")
    _in_loads(events, [f"event_id % 3 = {i}" for i in range(3)], lambda stream: rollup.keep_rollup(stream, path, checkpoint, late="60 days"))
    return Tables(spark, path).read("rollup").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id % 3 AS idx, ts AS tm, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'renew' ELSE 'claim' END AS kind, 'w' || CAST(floor(value) AS BIGINT) % 2 AS w FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY tm, kind, w) AS n FROM e),
    s AS (SELECT doc_id, idx, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS tm, CAST('' AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS w, 'pending' AS state, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS until, CAST(NULL AS VARCHAR) AS worker, '' AS action, CAST(NULL AS TIMESTAMP) AS ended, CAST(NULL AS VARCHAR) AS ended_worker, 0 AS before FROM (SELECT DISTINCT doc_id, idx FROM e)
        UNION ALL SELECT doc_id, idx, n, tm, kind, w, CASE WHEN action = 'claimed' THEN 'running' WHEN action IN ('done', 'failed') THEN action ELSE st END, CASE WHEN action = 'claimed' THEN attempts + 1 ELSE attempts END,
            CASE WHEN action IN ('claimed', 'renewed') THEN tm + INTERVAL 10 HOUR ELSE until END, CASE WHEN action = 'claimed' THEN w WHEN action IN ('done', 'failed') THEN NULL ELSE wk END, action, ended, ended_worker, attempts
        FROM (SELECT *, CASE WHEN kind = 'claim' AND st IN ('pending', 'failed') THEN 'claimed' WHEN kind <> 'claim' AND st = 'running' AND wk = w THEN CASE kind WHEN 'renew' THEN 'renewed' ELSE kind END ELSE 'refused' END AS action
            FROM (SELECT o.doc_id, o.idx, o.n, o.tm, o.kind, o.w, s.attempts, s.until, CASE WHEN s.state = 'running' AND s.until <= o.tm THEN s.until END AS ended, CASE WHEN s.state = 'running' AND s.until <= o.tm THEN s.worker END AS ended_worker,
                CASE WHEN s.state = 'running' AND s.until <= o.tm THEN CASE WHEN s.attempts >= 4 THEN 'failed' ELSE 'pending' END ELSE s.state END AS st, CASE WHEN s.state = 'running' AND s.until <= o.tm THEN NULL ELSE s.worker END AS wk
                FROM s JOIN o ON s.doc_id = o.doc_id AND s.idx = o.idx AND o.n = s.n + 1))),
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC) = 1),
    t AS (SELECT doc_id, idx, tm, action, attempts, w AS worker_id FROM s WHERE n > 0
        UNION ALL SELECT doc_id, idx, ended, CASE WHEN before >= 4 THEN 'escalated' ELSE 'requeued' END, before, ended_worker FROM s WHERE ended IS NOT NULL
        UNION ALL SELECT doc_id, idx, until, CASE WHEN attempts >= 4 THEN 'escalated' ELSE 'requeued' END, attempts, worker FROM last WHERE state = 'running' AND until < date_trunc('millisecond', (SELECT max(tm) FROM e)))
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, tm AS "at", action, CAST(attempts AS INTEGER) AS attempts, worker_id FROM t""")
def lease_transitions(spark, sf_dir):
    """Claims, renewals, ends and lapses of leases over a stream of three batches in the order of time."""
    kind = F.expr("case event_type when 'purchase' then 'done' when 'error' then 'failed' when 'signup' then 'renew' else 'claim' end")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("idx"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.expr("concat('w', cast(floor(value) as bigint) % 2)").alias("worker_id"))
    a, b = events.selectExpr("percentile_approx(at, array(0.33, 0.66)) as q").first()[0]
    path, checkpoint = shared_path(spark, "transitions"), shared_path(spark, "checkpoint")
    _in_loads(events, [f"at < timestamp'{a}'", f"at >= timestamp'{a}' and at < timestamp'{b}'", f"at >= timestamp'{b}'"], lambda stream: leases.keep_leases(stream, path, checkpoint, lease_seconds=36_000))
    return spark.read.schema(leases.TRANSITIONS.format(kind="bigint")).parquet(path).withColumn("at", F.col("at").cast("timestamp_ntz"))


_DOCS = ("doc_id bigint, source string, n_chars bigint", ("doc_id",))


@query("""WITH n AS (SELECT doc_id, source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 = 0),
    d AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT * FROM n),
    k AS (SELECT * FROM d WHERE source IS DISTINCT FROM 'src1'), v AS (SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM d WHERE source = 'src1'))
    SELECT doc_id, source, n_chars, label FROM k LEFT JOIN v ON vec_id = doc_id""")
def tables_in_versions(spark, sf_dir):
    """Inserts, an upsert that replaces and adds rows, and a delete that cascades, each one commit over two tables."""
    docs, vectors = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    made = Tables(spark, shared_path(spark, "tables"), {"documents": _DOCS, "vectors": ("vec_id bigint, label int", ("vec_id",))})
    made.commit({"documents": Change(upserts=docs.where("doc_id % 2 = 0")), "vectors": Change(upserts=vectors)})
    made.commit({"documents": Change(upserts=docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1))})
    made.cascade("documents", made.read("documents").where("source = 'src1'").select("doc_id"), {"vectors": "vec_id"})
    kept = made.read("vectors").withColumnRenamed("vec_id", "own")
    return made.read("documents").join(kept, F.col("doc_id") == F.col("own"), "left").drop("own")


@query("""WITH j AS (SELECT event_type AS stream, user_id AS doc_id, event_id % 3 AS idx, min(ts) AS first FROM events GROUP BY ALL)
    SELECT stream, doc_id, CAST(idx AS INTEGER) AS idx, CAST((row_number() OVER (PARTITION BY stream ORDER BY first, CAST(doc_id AS VARCHAR), idx) - 1) // 300 AS INTEGER) AS round FROM j""")
def queue_intake(spark, sf_dir):
    """A flood of jobs, many of them repeated, into queues of 300 jobs at most, and the round in which each is queued when consumers finish all that is queued."""
    jobs = _table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("idx"), F.col("ts").cast("timestamp").alias("at"), F.lit("{}").alias("job"))
    a = jobs.selectExpr("percentile_approx(at, 0.5) as q").first()[0]
    path, checkpoint = shared_path(spark, "queue"), shared_path(spark, "checkpoint")
    _in_loads(jobs, [f"at < timestamp'{a}'", f"at >= timestamp'{a}'"], lambda stream: intake.intake(stream, path, checkpoint, cap=300, late="60 days"))
    return intake.rounds(intake.queue_tables(spark, path), cap=300).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT doc_id AS id, CAST(doc_id % 4 AS INTEGER) AS feed_no, CAST(doc_id // 4 % 3 AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY doc_id % 4, doc_id // 4 % 3 ORDER BY doc_id) - 1 AS INTEGER) AS entry_no, source AS title, CASE WHEN doc_id % 5 > 0 THEN 'https://host/' || doc_id || '.epub' END AS href FROM documents")
def feed_pages(spark, sf_dir):
    """Entries of four feeds of three pages each, made of the documents, read through the data source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id") % 4, F.expr("doc_id div 4 % 3"), F.coalesce("source", F.lit(""))).toDF("doc_id", "feed", "page", "source")
    link = F.expr(f"""if(doc_id % 5 > 0, concat('<link rel="{feeds.RELATION}" href="https://host/', doc_id, '.pdf" type="application/pdf"/><link rel="{feeds.RELATION}" href="https://host/', doc_id, '.epub" type="application/epub+zip"/>'), '')""")
    entry = F.concat(F.lit("<entry><id>"), "doc_id", F.lit("</id><title>"), "source", F.lit("</title>"), link, F.lit("</entry>"))
    # a page is a folder of files whose lines are its parts in turn, so none is put together in one place
    after = F.expr("if(page < 2, concat('<link rel=\"next\" href=\"page=', page + 1, '\"/>'), '')")
    ends = docs.select("feed", "page").distinct()
    begun = ends.select("feed", "page", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("<feed>"), after).alias("value"))
    ended = ends.select("feed", "page", F.lit(2).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit("</feed>").alias("value"))
    lines = docs.select("feed", "page", F.lit(1).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), entry.alias("value")).unionByName(begun).unionByName(ended)
    order, path = ("feed", "page", "part", "doc_id"), shared_path(spark, "feeds")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("feed", "page", "value").write.partitionBy("feed", "page").text(path)
    spark.dataSource.register(feeds.FeedSource)
    at = path if ":/" in path else f"file://{path}"
    rows = spark.read.format("feed").option("urls", json.dumps([f"{at}/feed={i}/page=0" for i in range(4)])).load()
    return rows.select(F.col("id").cast("long").alias("id"), F.regexp_extract("feed", r"feed=(\d+)", 1).cast("int").alias("feed_no"), "page_no", "entry_no", "title", "href")


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'view') AS searches, CAST(sum(CASE WHEN event_type = 'view' THEN user_id END) // nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS search_mean_ms FROM events")
def observed_counters(spark, sf_dir):
    """The counters of requests, taken while they are written into a log of theirs."""
    requests = _table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "search").otherwise("ingest").alias("kind"), F.col("user_id").alias("milliseconds"))
    passed, seen = event_log.counted(requests)
    passed.write.parquet(shared_path(spark, "requests"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("requests", "searches", "search_mean_ms"))], "requests bigint, searches bigint, search_mean_ms bigint")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS line FROM documents")
def dataset_lines(spark, sf_dir):
    """Numbers of the lines of a set of files, read in splits."""
    path = shared_path(spark, "lines")
    _table(spark, sf_dir, "documents").orderBy("doc_id").select(F.to_json(F.struct("doc_id", "source", "text"))).write.text(path)
    return evaluation.numbered_lines(spark, path, whole=True).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "line")


# ---------------------------------------------------------------- predicates and listings


@query(r"""SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events
    WHERE regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+(\.[0-9]+)?$') AND TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20 AND lower(event_type) = 'click'""")
def metadata_filter_push(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("meta", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("year"))))
    return rows.where(metadata_filter({"year_from": "10", "year_to": 20, "author": "CLICK"}, "meta", "event_type")).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


def _listed_docs(spark, sf_dir) -> Engine:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("collection_id"), F.col("n_chars").alias("updated_at"))
    return Engine(rows, rows, rows)


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' AND text ILIKE '%the%' ORDER BY n_chars DESC, doc_id LIMIT 5 OFFSET 5")
def list_documents_page(spark, sf_dir):
    rows = _listed_docs(spark, sf_dir).list_documents(collection="src3", title="the", page=2, size=5)
    return rows.select(F.col("id").alias("doc_id"), F.col("collection_id").alias("source"), F.col("updated_at").alias("n_chars"))


@query("SELECT doc_id, source FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return _listed_docs(spark, sf_dir).get_document(7).select(F.col("id").alias("doc_id"), F.col("collection_id").alias("source"))


def _events(spark, sf_dir) -> DataFrame:
    stage = F.when(F.col("user_id") % 3 == 0, "dlq").when(F.col("user_id") % 3 == 1, "janitor").otherwise("parse")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").otherwise("warn").alias("level"), stage.alias("stage"))


_EVENTS = "WITH e AS (SELECT event_id AS id, user_id AS doc_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'warn' END AS level, CASE user_id % 3 WHEN 0 THEN 'dlq' WHEN 1 THEN 'janitor' ELSE 'parse' END AS stage FROM events)"


@query(f"{_EVENTS} SELECT * FROM e WHERE id > 100 AND level = 'error' ORDER BY id LIMIT 100")
def events_tail(spark, sf_dir):
    return event_rows.listed(_events(spark, sf_dir), level="error", after=100, oldest_first=True, limit=0)


@query(f"{_EVENTS} SELECT * FROM e WHERE stage = 'parse' AND level = 'warn' ORDER BY id DESC LIMIT 500")
def events_newest(spark, sf_dir):
    return event_rows.listed(_events(spark, sf_dir), level="warn", stage="parse", limit=500)


@query(f"{_EVENTS} SELECT count(*) FILTER (WHERE stage = 'dlq') AS dlq, count(*) FILTER (WHERE stage = 'janitor' AND level <> 'info') AS janitor_warnings FROM e")
def event_warnings(spark, sf_dir):
    return event_rows.warnings(_events(spark, sf_dir))


@query("""WITH q AS (SELECT event_type AS stream, event_id, event_id % 4 AS delivered, user_id * 30 AS idle FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS n FROM q WHERE delivered > 0),
    p AS (SELECT stream, count(*) AS in_flight, count(*) FILTER (WHERE idle > 900) AS stale FROM n WHERE n <= 100 GROUP BY stream)
    SELECT s.stream, coalesce((SELECT count(*) FROM q WHERE q.stream = s.stream AND delivered = 0), 0) + coalesce(in_flight, 0) AS waiting, coalesce(in_flight, 0) AS in_flight, coalesce(stale, 0) AS stale,
    (SELECT count(DISTINCT user_id) FROM events e WHERE e.event_type = s.stream AND user_id % 500 < 300) AS consumers
    FROM (SELECT DISTINCT event_type AS stream FROM events UNION ALL SELECT 'idle') s LEFT JOIN p USING (stream)""")
def pipeline_lanes(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    entries = e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"), (F.col("event_id") % 4).alias("delivered_count"), (F.col("user_id") * 30).alias("idle_seconds"))
    consumers = e.select(F.col("event_type").alias("stream"), F.col("user_id").alias("consumer"), (F.col("user_id") % 500).alias("idle_seconds")).distinct()
    return views.lanes(entries.select("stream").distinct().unionByName(spark.sql("select 'idle' as stream")), entries, consumers)


@query("SELECT event_type AS stream, count(*) AS depth, count(*) <= 2000 AS admitted FROM events GROUP BY event_type")
def admission(spark, sf_dir):
    entries = _table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.lit(0).alias("delivered_count"))
    return views.admitted(jobs.queue_depth(entries).select("stream", "depth"))


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'view') AS searches, CAST(sum(CASE WHEN event_type = 'view' THEN user_id END) // nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS search_mean_ms FROM events")
def request_counters(spark, sf_dir):
    return views.request_counters(_table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "search").otherwise("ingest").alias("kind"), F.col("user_id").alias("milliseconds")))


@query("SELECT conv_id AS doc_id, turn AS page, CAST(coalesce(length(text), 0) AS INTEGER) AS chars FROM conversations")
def page_lengths(spark, sf_dir):
    return page_rows.page_chars(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("SELECT conv_id AS doc_id, 1 AS idx, CAST(turn AS INTEGER) AS page, text FROM conversations WHERE turn BETWEEN 1 AND 2")
def page_slices(spark, sf_dir):
    pages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    shard = pages.select("doc_id").distinct().select("doc_id", F.lit(1).alias("idx"), F.lit(1).cast("long").alias("page_start"), F.lit(2).cast("long").alias("page_end"))
    return page_rows.sliced(pages, shard)


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, '。', ''))) + (length(text) - length(replace(text, '！', ''))) + (length(text) - length(replace(text, '？', ''))) + (length(text) - length(replace(text, '；', ''))) AS BIGINT) * CAST(lang = 'zh' OR lang NOT IN ('de', 'en') AS BIGINT)
    + CAST(((length(text) - length(replace(text, '. ', ''))) + (length(text) - length(replace(text, '! ', ''))) + (length(text) - length(replace(text, '? ', ''))) + (length(text) - length(replace(text, '; ', '')))) / 2 AS BIGINT) * CAST(lang <> 'zh' AS BIGINT)
    + CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS ends FROM documents""")
def sentence_ends(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.sentence_end_count(F.col("text"), F.col("lang")).alias("ends"))


@query("SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE c.turn BETWEEN 1 AND 3 AND (c.role = 'assistant') = (SELECT max((o.role = 'assistant')::INT) = 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn BETWEEN 1 AND 3)")
def read_pages_overlap(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), (F.col("role") == "assistant").alias("is_parent"))
    return retrieval.read_pages(c, F.lit(1), F.lit(3)).select(F.col("doc_id").alias("conv_id"), "turn", "role")


@query("SELECT c.conv_id, a.turn AS anchor, c.turn FROM conversations a JOIN conversations c ON a.conv_id = c.conv_id AND c.turn BETWEEN a.turn - 2 AND a.turn + 2 AND (c.role = 'assistant') = (a.role = 'assistant') WHERE a.turn = 2")
def neighbour_window(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), (F.col("role") == "assistant").alias("is_parent"))
    return retrieval.neighbours(c, c.where("seq = 2").select("doc_id", "seq"), 2).select(F.col("doc_id").alias("conv_id"), "anchor", F.col("seq").alias("turn"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE turn BETWEEN 1 AND 30 GROUP BY conv_id")
def page_text(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text", F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), F.lit(False).alias("is_parent"))
    return retrieval.page_text(c, 1, 99).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("body"))


# ---------------------------------------------------------------- text


@query("""SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 4.5 ELSE 3.0 END + 0.5)) END AS INTEGER) AS tokens,
    CAST(greatest(1, floor(length(text) / 3.0 + 0.5)) AS INTEGER) AS stored FROM documents""")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text"), F.col("lang")).alias("tokens"), F.greatest(F.lit(1), T.token_estimate(F.col("text"))).alias("stored"))


@query(r"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]')) AS cjk, len(regexp_extract_all(text, '[äöüÄÖÜß]')) AS um, len(regexp_extract_all(text, '[a-zA-Z]')) AS la FROM documents),
    h AS (SELECT *, um + la AS latin, lower(substr(text, 1, coalesce(list_max(list_filter(range(1, 513), lambda n: octet_length(encode(substr(text, 1, n))) <= 512)), 0))) AS head FROM c)
    SELECT CASE WHEN cjk + latin = 0 THEN 'mixed' WHEN cjk / (cjk + latin) >= 0.15 AND latin / (cjk + latin) >= 0.15 THEN 'mixed' WHEN cjk / (cjk + latin) > 0.3 THEN 'zh'
    WHEN um > 0 OR contains(head, ' der ') OR contains(head, ' die ') OR contains(head, ' das ') OR contains(head, ' und ') OR contains(head, ' ist ') OR contains(head, ' nicht ') OR contains(head, ' mit ') OR contains(head, ' auf ') THEN 'de' ELSE 'en' END AS label, count(*) AS n FROM h GROUP BY 1""")
def script_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(T.language(F.col("text")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS lines, round(avg(length(line)), 9) AS mean, round(stddev_pop(length(line)), 6) AS sd, count(*) FILTER (WHERE regexp_matches(line, '^#{1,6}[ \t]')) AS headings FROM l GROUP BY doc_id""")
def line_profile(spark, sf_dir):
    lines = structure.lines(_table(spark, sf_dir, "documents").where("text is not null"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(F.length("line")), 9).alias("mean"), F.round(F.stddev_pop(F.length("line")), 6).alias("sd"), F.count_if(F.rlike("line", F.lit(r"^#{1,6}[ \t]"))).alias("headings"))


@query(r"""WITH h AS (SELECT doc_id, sha256(array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), ' ')) AS hash FROM documents)
    SELECT hash, min(doc_id) AS first_id, count(*) AS n FROM h GROUP BY hash""")
def chunk_hash_dedupe(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.chunk_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id || ':' || sha256(text))) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM s""")
def uuid5_ids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("id"))


@query("""WITH r AS (SELECT conv_id, turn, role = 'system' AS is_parent, sha256(text) AS hash FROM conversations),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, is_parent, hash ORDER BY turn) AS k FROM r),
    u AS (SELECT * FROM f WHERE k = 1 AND (is_parent OR NOT EXISTS (SELECT 1 FROM f p WHERE p.is_parent AND p.conv_id = f.conv_id AND p.hash = f.hash)))
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY (NOT is_parent)::INT, turn) - 1 AS INTEGER) AS seq FROM u""")
def renumber_seq(spark, sf_dir):
    from .operators.chunks import deduplicated

    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("turn"), (F.col("role") == "system").alias("is_parent"), F.sha2("text", 256).alias("chunk_hash"))
    return deduplicated(c).select(F.col("doc_id").alias("conv_id"), "turn", "seq")


@query(r"""SELECT page_id, CASE WHEN lower(substr(html, 1, 15)) = '<!doctype html' OR starts_with(lower(ltrim(substr(html, 1, 200))), '<!doctype html') OR starts_with(lower(ltrim(substr(html, 1, 200))), '<html') THEN 'html' ELSE 'txt' END AS format,
    sha256(html) AS sha, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, contains(html, '<') AS valid FROM pages""")
def format_sniff(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), F.lit("page").alias("name"))
    return p.select("page_id", formats.sniffed(F.col("body"), F.col("name")).alias("format"), F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("bytes"), formats.html_ok(F.col("body")).alias("valid"))


# ---------------------------------------------------------------- shards


@query("""WITH p AS (SELECT doc_id, CAST(ceil(n_chars / 900.0) AS INTEGER) AS pages FROM documents),
    w AS (SELECT doc_id, pages, unnest(range(greatest(0, CAST(ceil((pages - 5) / 4.0) AS BIGINT)) + 1)) AS i FROM p WHERE pages >= 1)
    SELECT doc_id, CAST(i AS INTEGER) AS idx, CAST(1 + 4 * i AS INTEGER) AS page_start, CAST(least(pages, 5 + 4 * i) AS INTEGER) AS page_end FROM w""")
def shard_fixed_bounds(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 900).cast("int").alias("pages"))
    return shards.fixed_bounds(docs, "doc_id", "pages", 5, 1)


@query("""WITH p AS (SELECT doc_id, CAST(ceil(n_chars / 900.0) AS INTEGER) AS pages FROM documents WHERE n_chars > 0),
    s AS (SELECT DISTINCT doc_id, pages, least(pages, CAST(m AS INTEGER)) AS first FROM p, (SELECT unnest([1, 4, 11, 12, 400]) AS m)),
    c AS (SELECT *, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first) - 1, pages) AS last FROM s),
    w AS (SELECT doc_id, first, last, unnest(range(CAST(ceil((last - first + 1) / 5.0) AS BIGINT))) AS i FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first + 5 * i) - 1 AS INTEGER) AS idx, CAST(first + 5 * i AS INTEGER) AS page_start, CAST(least(last, first + 5 * i + 4) AS INTEGER) AS page_end FROM w""")
def shard_chapter_bounds(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 900).cast("int").alias("pages"))
    outline = docs.select("doc_id", F.explode(F.array(*map(F.lit, (4, 11, 12, 400)))).alias("page"))
    return shards.chapter_bounds(docs, outline, "doc_id", "pages", 5)


@query("""WITH r AS (SELECT event_id, CAST(user_id % 25 + 1 AS INTEGER) AS span, CAST(event_id % 4 + 1 AS INTEGER) AS attempts FROM events)
    SELECT event_id, CASE WHEN span < 2 THEN 'text_only' WHEN attempts = 2 AND span >= 10 THEN 'split' WHEN attempts = 3 THEN 'split' ELSE 'text_only' END AS action FROM r""")
def retry_ladder(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25 + 1).cast("int").alias("span"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"))
    return rows.select("event_id", shards.ladder_action(F.col("span"), F.col("attempts")).alias("action"))


@query("""WITH s AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS idx, CAST(event_id % 10 + 1 AS INTEGER) AS page_start, CAST(event_id % 10 + 1 + user_id % 13 AS INTEGER) AS page_end, CAST(event_id % 4 + 1 AS INTEGER) AS attempts FROM events),
    x AS (SELECT *, page_end - page_start + 1 AS span FROM s), y AS (SELECT *, CASE WHEN attempts < 3 THEN greatest(1, span // 4) ELSE 1 END AS size FROM x WHERE span >= 2 AND ((attempts = 2 AND span >= 10) OR attempts = 3)),
    w AS (SELECT doc_id, idx AS parent_idx, page_start, page_end, size, unnest(range(CAST(ceil(span / CAST(size AS DOUBLE)) AS BIGINT))) AS i FROM y),
    m AS (SELECT doc_id, max(idx) + 1 AS nxt FROM s GROUP BY doc_id)
    SELECT w.doc_id, parent_idx, CAST(nxt + row_number() OVER (PARTITION BY w.doc_id ORDER BY parent_idx, page_start + i * size) - 1 AS INTEGER) AS idx, CAST(page_start + i * size AS INTEGER) AS page_start, CAST(least(page_end, page_start + (i + 1) * size - 1) AS INTEGER) AS page_end FROM w JOIN m USING (doc_id)""")
def resplit_shards(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int")
    rows = e.select(F.col("user_id").alias("doc_id"), idx.alias("idx"), (F.col("event_id") % 10 + 1).cast("int").alias("page_start"), (F.col("event_id") % 10 + 1 + F.col("user_id") % 13).cast("int").alias("page_end"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"))
    return shards.resplit(rows)


@query("SELECT conv_id AS doc_id, round(avg(length(text)), 9) AS mean_chars, avg(length(text)) < 400 AS needs_ocr FROM conversations GROUP BY conv_id")
def ocr_gate(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.length("text").alias("chars"))
    return shards.needs_ocr(rows, least=400).withColumn("mean_chars", F.round("mean_chars", 9))


# ---------------------------------------------------------------- counters


@query("""WITH b AS (SELECT date_trunc('minute', ts) AS bucket, CAST(value * 100 AS BIGINT) AS ms, CAST(user_id % 700 AS INTEGER) AS rss, event_type, user_id FROM events),
    r AS (SELECT bucket, count(*) AS shards_done, count(*) FILTER (WHERE event_type = 'error') AS shards_failed, CAST(sum(user_id % 20 + 1) AS BIGINT) AS pages_parsed, count(*) FILTER (WHERE event_type = 'purchase') AS chunks_embedded FROM b GROUP BY bucket),
    d AS (SELECT bucket, list_sort(list(ms)) AS x, list_sort(list(rss)) AS y FROM b WHERE event_type <> 'error' GROUP BY bucket)
    SELECT r.*, x[(len(x) - 1) * 50 // 100 + 1] AS parse_p50_ms, x[(len(x) - 1) * 95 // 100 + 1] AS parse_p95_ms, y[(len(y) - 1) * 95 // 100 + 1] AS peak_rss_p95_mb FROM r LEFT JOIN d USING (bucket)""")
def minute_rollup_p50_p95(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    e = events.select(
        F.col("ts").alias("done_at"), F.lit(1).alias("page_start"), (F.col("user_id") % 20 + 1).alias("page_end"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (F.col("user_id") % 700).cast("int").alias("peak_rss_mb"),
    )
    return metrics.minute_rollup(e, events.where("event_type = 'purchase'").select(F.col("ts").alias("embedded_at")))


@query("SELECT date_trunc('minute', ts) AS bucket, count(*) AS shards_done FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
def rollups_latest(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("ts").alias("done_at"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("done").alias("state"), F.lit(1).alias("duration_ms"), F.lit(1).alias("peak_rss_mb"))
    return views.latest_rollups(metrics.minute_rollup(e)).select("bucket", "shards_done")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def state_counters(spark, sf_dir):
    return metrics.state_counts(_table(spark, sf_dir, "events"), "event_type")


@query("""WITH d AS (SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'ready' WHEN quality IS NULL THEN 'uploaded' ELSE 'parsing' END AS state, doc_id % 4 AS done FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'done' END AS state FROM events)
    SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d WHERE state = 'uploaded') AS documents_uploaded, (SELECT count(*) FROM d WHERE state = 'parsing') AS documents_parsing, (SELECT count(*) FROM d WHERE state = 'ready') AS documents_ready, (SELECT count(*) FROM d WHERE state = 'failed') AS documents_failed,
    (SELECT count(*) FROM d WHERE state = 'parsing' AND done = 3) AS awaiting_embed, (SELECT count(*) FROM d WHERE state IN ('uploaded', 'parsing')) AS active,
    (SELECT count(*) FROM s WHERE state = 'pending') AS shards_pending, (SELECT count(*) FROM s WHERE state = 'running') AS shards_running, (SELECT count(*) FROM s WHERE state = 'done') AS shards_done, (SELECT count(*) FROM s WHERE state = 'failed') AS shards_failed""")
def state_snapshot(spark, sf_dir):
    state = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "ready").when(F.col("quality").isNull(), "uploaded").otherwise("parsing")
    docs = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left").select(state.alias("state"), F.lit(3).alias("total_shards"), (F.col("doc_id") % 4).alias("shards_done"), F.lit(0).alias("shards_failed"))
    kinds = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").otherwise("done")
    snap = metrics.snapshot(docs, _table(spark, sf_dir, "events").select(kinds.alias("state")))
    return snap.drop("documents_embedding", "documents_partial", "shards_skipped")


@query("SELECT user_id AS id, count(*) AS calls, max(ts) AS last_call FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def usage_summary(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("api_key_id"), F.col("ts").alias("created_at"))
    return metrics.usage(e.select(F.col("api_key_id").alias("id")).distinct(), e, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("SELECT source AS collection_id, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(ceil(n_chars / 1800.0)) AS BIGINT) AS shards FROM documents GROUP BY source UNION ALL SELECT 'none', 0, 0, 0")
def collection_stats(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id"), F.col("n_chars").alias("byte_size"), F.ceil(F.col("n_chars") / 1800).alias("total_shards"))
    ids = docs.select(F.col("collection_id").alias("id")).distinct().unionByName(spark.sql("select 'none' as id"))
    return metrics.collection_stats(ids, docs)


@query("""WITH t AS (SELECT user_id AS id, count(*) AS true_total, count(*) FILTER (WHERE event_type <> 'error') AS true_done, count(*) FILTER (WHERE event_type = 'error') AS true_failed FROM events GROUP BY user_id),
    d AS (SELECT id, true_total AS total_shards, true_done - CAST(id % 3 = 0 AS INTEGER) AS shards_done, true_failed AS shards_failed FROM t)
    SELECT d.id, shards_done, CAST(true_done AS INTEGER) AS true_done FROM d JOIN t USING (id) WHERE shards_done <> true_done""")
def drift_docs(spark, sf_dir):
    s = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"))
    d = s.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("total_shards"), (F.count_if(F.col("state") == "done") - F.max((F.col("doc_id") % 3 == 0).cast("int"))).alias("shards_done"), F.count_if(F.col("state") == "failed").alias("shards_failed"))
    return metrics.drifted(d.withColumn("created_at", F.lit(0)), s).select("id", "shards_done", "true_done")


@query("""SELECT user_id, CAST(round(least(1, greatest(0, (count(*) - 3 * count(*) FILTER (WHERE event_type = 'error')) / CAST(count(*) AS DOUBLE))), 4) AS DOUBLE) AS completeness,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'partial' ELSE 'ready' END AS state FROM events GROUP BY user_id""")
def completeness(spark, sf_dir):
    g = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return g.select("user_id", metrics.completeness(F.col("total"), F.col("failed") * 3).cast("double").alias("completeness"), metrics.final_state(F.col("failed")).alias("state"))


# ---------------------------------------------------------------- queues


@query("""SELECT e.user_id AS doc_id, e.event_id AS idx FROM events e WHERE e.event_type = 'click' AND e.ts < TIMESTAMP '2024-01-20' - INTERVAL 2 MINUTE AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)
    AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_id = e.event_id AND q.value > 50)""")
def rescue_antijoin(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("state"), F.lit(0).alias("attempts"), F.col("ts").alias("created_at"))
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("parsing").alias("state"))
    queued = e.where("value > 50").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"))
    return jobs.rescued(s, docs, queued, F.lit("2024-01-20").cast("timestamp_ntz")).select("doc_id", "idx")


@query("SELECT user_id AS id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 60 MINUTE")
def stuck_docs(spark, sf_dir):
    d = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at")).withColumn("state", F.lit("parsing"))
    return jobs.stuck(d, F.lit("2024-01-30").cast("timestamp_ntz")).select("id", "updated_at")


@query("""WITH r AS (SELECT event_type AS stream, event_id AS entry_id, user_id * 30 AS idle, CAST(event_id % 8 AS INTEGER) AS delivered FROM events),
    t AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY idle DESC, entry_id) AS n FROM r WHERE idle >= 1200)
    SELECT stream, entry_id, CASE WHEN delivered >= 5 THEN 'quarantine' ELSE 'requeue' END AS action FROM t WHERE n <= 50""")
def dlq_cap(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"), (F.col("user_id") * 30).alias("idle_seconds"), (F.col("event_id") % 8).cast("int").alias("delivered_count"))
    return jobs.reclaimed(e).select("stream", "entry_id", "action")


@query("SELECT event_type AS stream, count(*) FILTER (WHERE event_id % 8 = 0) AS undelivered, count(*) FILTER (WHERE event_id % 8 > 0) AS pending, count(*) AS depth FROM events GROUP BY event_type")
def queue_depth(spark, sf_dir):
    return jobs.queue_depth(_table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), (F.col("event_id") % 8).alias("delivered_count")))


# ---------------------------------------------------------------- evaluation

_NORM = "trim(regexp_replace(lower(translate(replace(replace({0}, '+', 'plus'), '#', 'sharp'), '._-', '   ')), '[^a-z0-9]+', ' ', 'g'))"
_CASES = f"""cs AS (SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS brand FROM part),
    rs AS (SELECT c.id, o.p_name AS doc_title, CASE WHEN o.p_partkey % 11 = 0 THEN 'Index' ELSE o.p_brand END AS head, row_number() OVER (PARTITION BY c.id ORDER BY (o.p_partkey * 31 + c.id * 17) % 101, o.p_partkey) AS rank FROM cs c JOIN part o ON o.p_partkey BETWEEN c.id - 9 AND c.id + 2),
    nm AS (SELECT rs.id, rank, {_NORM.format("doc_title")} AS x, {_NORM.format("cs.title")} AS y, category, contains(lower('Part › ' || head), lower(brand)) AS in_heading, head = 'Index' AS junk FROM rs JOIN cs USING (id) WHERE rank <= 8),
    ok AS (SELECT *, x = y OR (length(replace(x, ' ', '')) >= 8 AND length(replace(y, ' ', '')) >= 8 AND (contains(replace(x, ' ', ''), replace(y, ' ', '')) OR contains(replace(y, ' ', ''), replace(x, ' ', '')))) AS match FROM nm),
    hit AS (SELECT id, min(rank) FILTER (WHERE match) AS rank, coalesce(arg_min(in_heading, rank) FILTER (WHERE match), FALSE) AS heading, count(*) AS results, count(*) FILTER (WHERE junk) AS junk FROM ok GROUP BY id)"""


def _evaluated(spark, sf_dir) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    cases = part.select(F.col("p_partkey").alias("id"), F.array("p_name").alias("expected_doc_titles"), F.array("p_brand").alias("expected_headings"), F.col("p_type").alias("category"))
    # each part goes to the cases that it is near to, so parts meet nothing but cases
    near = part.select("p_partkey", "p_name", "p_brand", F.explode(F.sequence(F.col("p_partkey") - 2, F.col("p_partkey") + 9)).alias("id"))
    order = Window.partitionBy("id").orderBy((F.col("p_partkey") * 31 + F.col("id") * 17) % 101, "p_partkey")
    path = F.array(F.lit("Part"), F.when(F.col("p_partkey") % 11 == 0, "Index").otherwise(F.col("p_brand")))
    results = near.select("id", F.row_number().over(order).alias("rank"), F.col("p_name").alias("doc_title"), path.alias("heading_path"))
    return evaluation.ranked_hits(cases, results, 8)


@query(f"WITH {_CASES} SELECT id, CAST(rank AS INTEGER) AS rank FROM hit")
def title_match_rank(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "rank")


@query(f"""WITH {_CASES}, j AS (SELECT hit.*, category FROM hit JOIN cs USING (id)), g AS (SELECT category, rank, heading, junk, results FROM j UNION ALL SELECT NULL, rank, heading, junk, results FROM j)
    SELECT category, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 9) AS hit_3, round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0 END), 9) AS hit_8, round(avg(1.0 / rank), 9) AS mrr,
    count(*) FILTER (WHERE heading) AS heading_hits, CAST(sum(junk) AS BIGINT) AS junk, CAST(sum(results) AS BIGINT) AS results FROM g GROUP BY category""")
def hit_mrr_summary(spark, sf_dir):
    s = evaluation.summary(_evaluated(spark, sf_dir), 8)
    return s.select("category", "n", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_3", "hit_8", "mrr")], "heading_hits", "junk", "results")


@query(f"""WITH {_CASES}, b AS (SELECT id, rank FROM hit WHERE id % 5 <> 0), c AS (SELECT id, CASE WHEN id % 2 = 0 THEN rank ELSE 2 END AS rank FROM hit WHERE id % 3 <> 0 OR id % 5 = 0)
    SELECT coalesce(b.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'base_only' WHEN b.id IS NULL THEN 'candidate_only' WHEN coalesce(c.rank, 9) < coalesce(b.rank, 9) THEN 'improved' WHEN coalesce(c.rank, 9) > coalesce(b.rank, 9) THEN 'regressed' ELSE 'unchanged' END AS verdict FROM b FULL JOIN c ON b.id = c.id""")
def run_compare(spark, sf_dir):
    hits = _evaluated(spark, sf_dir).select("id", "rank")
    base, candidate = hits.where("id % 5 <> 0"), hits.where("id % 3 <> 0 or id % 5 = 0").withColumn("rank", F.when(F.col("id") % 2 == 0, F.col("rank")).otherwise(2))
    return evaluation.compared(base, candidate, 8).select("id", "verdict")


@query("""SELECT page_id, contains(lower(url), 'table of contents') OR regexp_matches(url, '(?i)(^[0-9]+-FM-|\\.(?:indd|dvi|pdf)$)') OR regexp_extract(lower(url), '/([^/]*)$', 1) IN ('index', 'see also', 'problem', 'solution') AS junk FROM pages""")
def junk_filter(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", T.is_junk(F.array(F.lit("x"), F.regexp_extract("url", "/([^/]*)$", 1)), F.col("url")).alias("junk"))


# ---------------------------------------------------------------- chunking: Python state machines, tested by their invariants


@query()
def chunk_documents(spark, sf_dir):
    from .operators.chunks import chunked

    return chunked(_table(spark, sf_dir, "documents")).select("id", "doc_id", "parent_id", "is_parent", "seq", "start", "end", "token_count", "chunk_hash")


@query()
def chunk_pages_markdown(spark, sf_dir):
    from .plans.ingest import from_html

    return from_html(_table(spark, sf_dir, "pages")).select("id", "doc_id", "is_parent", "seq", "heading_path", "header_breadcrumb", "text")


_WS = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Lines of d (doc_id, text) with their places, whether they bound code or are inside it, and their level as a heading.
_LINES = rf"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
    l1 AS (SELECT *, regexp_matches(line, '^{_WS}*```') AS fence, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM l0),
    l2 AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k) % 2 = 1 AS inside FROM l1),
    l AS (SELECT *, NOT fence AND NOT inside AS plain, CASE WHEN fence OR inside OR NOT regexp_matches(line, '^#{{1,6}}[ \t\f\r]+') OR regexp_matches(line, '^#{{1,6}}[ \t\f\r]+{_WS}*#*{_WS}*$') THEN 0 ELSE length(regexp_extract(line, '^#+')) END AS level FROM l2)"""
#: The script label of the first 4096 bytes of each text of d.
_OWN = """x AS (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, 4096), '(?s).')) AS ch, generate_subscripts(regexp_extract_all(substr(text, 1, 4096), '(?s).'), 1) AS i FROM d WHERE octet_length(encode(text)) > 4096),
    y AS (SELECT *, sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM x), z AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS head FROM y WHERE upto <= 4096 GROUP BY doc_id),
    e AS (SELECT d.doc_id, coalesce(z.head, text) AS head FROM d LEFT JOIN z USING (doc_id)),
    s AS (SELECT doc_id, len(regexp_extract_all(head, '[\\p{Han}\\p{Hangul}\\p{Hiragana}\\p{Katakana}]')) AS cjk, len(regexp_extract_all(head, '[äöüÄÖÜß]')) AS um, len(regexp_extract_all(head, '[a-zA-Z]')) + um AS latin,
        lower(substr(head, 1, coalesce(list_max(list_filter(range(1, 513), lambda n: octet_length(encode(substr(head, 1, n))) <= 512)), 0))) AS h FROM e),
    o AS (SELECT doc_id, CASE WHEN cjk + latin = 0 OR (cjk / (cjk + latin) >= 0.15 AND latin / (cjk + latin) >= 0.15) THEN 'mixed' WHEN cjk / (cjk + latin) > 0.3 THEN 'zh' WHEN um > 0 OR %s THEN 'de' ELSE 'en' END AS own FROM s)""" % " OR ".join(f"contains(h, '{w}')" for w in T.GERMAN_WORDS)
_TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _lines_like(pattern: str) -> str:
    return f"CAST(count(*) FILTER (plain AND level = 0 AND regexp_matches(line, '{pattern}')) AS INTEGER)"


@query(rf"""WITH {_TEXTS}, {_LINES}, {_OWN},
    n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS lines, CAST(count(*) FILTER (level > 0) AS INTEGER) AS headings, {", ".join(f"count(*) FILTER (level = {k}) AS h{k}" for k in range(1, 7))},
        {_lines_like(structure.NUMBERED)} AS numbered, {" + ".join(_lines_like(p) for p in structure.CHAPTERS.values())} AS chapters, {_lines_like(structure.ALL_CAPS)} AS all_caps, {_lines_like(structure.SEPARATOR_LINE)} AS separators,
        {_lines_like(structure.FOOTER)} AS footers, bool_or(fence) AS has_code, count(*) FILTER (plain AND level = 0 AND regexp_matches(line, '^{_WS}*\|(.*\|)?{_WS}*$')) > 0 AS has_tables,
        coalesce(sum(length(line)) FILTER (inside AND NOT fence), 0) AS code, coalesce(avg(length(line)) FILTER (plain), 0) AS mean, coalesce(stddev_pop(length(line)) FILTER (plain), 0) AS sd FROM l GROUP BY doc_id),
    p AS (SELECT *, CAST(length(text) AS INTEGER) AS total_chars, CAST(length(text) - length(replace(text, chr(12), '')) AS INTEGER) AS form_feeds, CAST((length(text) - length(replace(text, repeat(chr(10), 3), ''))) / 3 AS INTEGER) AS blank_breaks,
        CASE {" ".join(f"WHEN h{k} >= 3 THEN {k}" for k in range(1, 7))} {" ".join(f"WHEN h{k} > 0 THEN {k}" for k in range(6, 0, -1))} ELSE 0 END AS dominant_level FROM n JOIN d USING (doc_id) JOIN o USING (doc_id))
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, total_chars, CASE WHEN total_chars > 0 THEN lines ELSE 0 END AS total_lines, headings, concat_ws(',', {", ".join(f"CASE WHEN h{k} > 0 THEN '{k}:' || h{k} END" for k in range(1, 7))}) AS levels, dominant_level,
    numbered, chapters, all_caps, separators, footers, form_feeds, blank_breaks, has_code, has_tables, round(CASE WHEN total_chars > 0 THEN code / total_chars ELSE 0 END, 9) AS code_ratio, round(mean, 9) AS mean_line, round(sd, 6) AS sd_line,
    CASE WHEN total_chars = 0 THEN '' WHEN own = 'mixed' THEN 'en,de,zh' ELSE own END AS languages,
    concat_ws(',', CASE WHEN headings >= 3 AND headings / lines > 0.005 THEN 'heading' END, CASE WHEN numbered + chapters + all_caps + separators + footers + form_feeds >= 5 OR form_feeds > 0 OR chapters > 0 THEN 'heuristic' END, 'legacy') AS tiers FROM p""")
def document_profiles(spark, sf_dir):
    """All signals of each text, and the tiers they call for."""
    found = structure.profiles(_table(spark, sf_dir, "documents"))
    levels = F.array_join(F.transform(F.array_sort(F.map_entries("heading_counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    shown = {"levels": levels, "code_ratio": F.round("code_ratio", 9), "mean_line": F.round("mean_line", 9), "sd_line": F.round("sd_line", 6), "languages": F.array_join("languages", ","), "tiers": F.array_join("tiers", ",")}
    return found.withColumns(shown).drop("heading_counts")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS total_chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(12), '')) AS INTEGER) AS form_feeds FROM documents")
def profile_counts(spark, sf_dir):
    return structure.profiles(_table(spark, sf_dir, "documents")).select("doc_id", "total_chars", "form_feeds")


def _turns_sql(title: str, turn: str, between: str) -> str:
    """SQL for d, one text of each conversation: a title, then its turns."""
    return f"""d AS (SELECT conv_id AS doc_id, {title} || string_agg({turn}, {between} ORDER BY turn, role, text) AS text
    FROM (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id)"""


def _turns(spark: SparkSession, sf_dir: str, title: Column, turn: Callable[[Column], Column], between: str) -> DataFrame:
    """The same as a DataFrame."""
    c = _table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), turn)
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(title, F.array_join(turns, between)).alias("text"))


_OUTLINED = _turns_sql("'# Conversation ' || conv_id || chr(10)", "repeat('#', CAST(2 + turn % 3 AS INTEGER)) || ' ' || role || chr(10) || text", "chr(10)")
#: Turns by pages, numbered lines, chapters and rules, with blank lines between.
_MARKED = _turns_sql("''", "CASE turn % 4 WHEN 0 THEN '1.' || (turn + 1) || ' ' || role WHEN 1 THEN chr(12) || upper(role) WHEN 2 THEN 'Chapter ' || turn || ': ' || role ELSE '---' END || chr(10) || text", "repeat(chr(10), 3)")


@query(rf"""WITH {_OUTLINED}, {_LINES},
    h AS (SELECT doc_id, k - 1 AS line_no, "at", level, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^#+[ \t\f\r]+', ''), '^{_WS}+|{_WS}+$', '', 'g'), '#+$', ''), '{_WS}+$', '') AS title FROM l WHERE level > 0)
    SELECT a.doc_id, CAST(a.line_no AS INTEGER) AS line_no, CAST(a."at" AS BIGINT) AS "at", CAST(a.level AS INTEGER) AS level, a.title, string_agg(repeat('#', CAST(g.level AS INTEGER)) || ' ' || g.title, chr(10) ORDER BY g.line_no) AS breadcrumb
    FROM h a JOIN h g ON g.doc_id = a.doc_id AND (g.line_no = a.line_no OR (g.line_no < a.line_no AND g.level < a.level))
    WHERE NOT EXISTS (SELECT 1 FROM h m WHERE m.doc_id = a.doc_id AND m.line_no > g.line_no AND m.line_no <= a.line_no AND m.level <= g.level) GROUP BY ALL""")
def conversation_outline(spark, sf_dir):
    """The headings of conversations as texts, a heading a turn, with those in force above them."""
    turn = lambda t: F.concat(F.repeat(F.lit("#"), (t["turn"] % 3 + 2).cast("int")), F.lit(" "), t["role"], F.lit("\n"), t["text"])
    return structure.headings(_turns(spark, sf_dir, F.concat(F.lit("# Conversation "), F.col("conv_id"), F.lit("\n")), turn, "\n"))


def _kind_of_line() -> str:
    chapters = " OR ".join(f"(own IN ('{k}', 'mixed') AND regexp_matches(line, '{p}'))" for k, p in structure.CHAPTERS.items())
    rest = (("numbered", structure.NUMBERED), ("capitals", structure.ALL_CAPS), ("separator", structure.SEPARATOR_LINE), ("footer", structure.FOOTER))
    return f"CASE WHEN {chapters} THEN 'chapter' " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in rest) + " END"


@query(rf"""WITH {_MARKED}, {_LINES}, {_OWN},
    f AS (SELECT doc_id, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS "at" FROM (SELECT doc_id, unnest(string_split(text, chr(12))) AS p, generate_subscripts(string_split(text, chr(12)), 1) AS k FROM d)),
    g AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n{{3,}}')) AS p, generate_subscripts(regexp_split_to_array(text, '\n{{3,}}'), 1) AS k FROM d),
    m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\n{{3,}}')) AS q, generate_subscripts(regexp_extract_all(text, '\n{{3,}}'), 1) AS k FROM d),
    b AS (SELECT doc_id, q, sum(length(p) + coalesce(length(q), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS "at" FROM g LEFT JOIN m USING (doc_id, k)),
    a AS (SELECT doc_id, "at", {_kind_of_line()} AS kind FROM l JOIN o USING (doc_id) WHERE plain UNION ALL SELECT doc_id, "at", 'form feed' FROM f UNION ALL SELECT doc_id, "at", 'blank' FROM b WHERE q IS NOT NULL),
    r AS (SELECT a.*, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in structure.PRIORITIES.items())} END AS priority FROM a JOIN d USING (doc_id) WHERE kind IS NOT NULL AND "at" > 0 AND "at" < length(text))
    SELECT doc_id, CAST("at" AS BIGINT) AS "at", arg_max(kind, priority) AS kind, CAST(max(priority) AS INTEGER) AS priority FROM r GROUP BY ALL""")
def conversation_boundaries(spark, sf_dir):
    """Where conversations as texts may be cut, with the strongest kind of each place."""
    kind = lambda t: t["turn"] % 4
    head = lambda t: F.when(kind(t) == 0, F.concat(F.lit("1."), t["turn"] + 1, F.lit(" "), t["role"])).when(kind(t) == 1, F.concat(F.lit("\f"), F.upper(t["role"]))).when(kind(t) == 2, F.concat(F.lit("Chapter "), t["turn"], F.lit(": "), t["role"])).otherwise("---")
    return structure.boundaries(_turns(spark, sf_dir, F.lit(""), lambda t: F.concat(head(t), F.lit("\n"), t["text"]), "\n\n\n"))


#: Size that conversations are checked for as if their turns were chunks.
CHECKED_SIZE = 150


@query(f"""WITH r AS (SELECT conv_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0) DESC, length(coalesce(text, '')) DESC) AS back FROM conversations WHERE conv_id IS NOT NULL),
    g AS (SELECT conv_id, count(*) AS n, sum(n) AS total, max(n) AS most, count(*) FILTER (n < 50 AND back > 1) AS tiny FROM r GROUP BY conv_id)
    SELECT conv_id AS doc_id, n, CASE WHEN n = 1 AND total > {2 * CHECKED_SIZE} THEN 'one chunk for a long text' WHEN tiny > n // 4 AND tiny > 2 THEN 'too many tiny chunks' WHEN most < {CHECKED_SIZE // 4} AND total > {CHECKED_SIZE} THEN 'all far below size'
    WHEN most > {2 * CHECKED_SIZE} THEN 'a chunk over twice the size' END AS fault FROM g""")
def chunk_checks(spark, sf_dir):
    """Whether the turns of each conversation would do as its chunks, and why not."""
    turns = _table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("doc_id"), F.coalesce("turn", F.lit(0)).alias("start"), F.coalesce("text", F.lit("")).alias("text"))
    return structure.chunk_faults(turns, turns.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total")), CHECKED_SIZE)


def _shard_rows(spark, sf_dir) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    body = F.concat(F.when(F.col("turn") == 0, F.concat(F.lit("# Conversation "), F.col("conv_id"), F.lit("\n\n"))).otherwise(""), F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), (F.col("turn") * 2 + 1).cast("int").alias("page_start"), (F.col("turn") * 2 + 2).cast("int").alias("page_end"), body.alias("payload"))


@query()
def stitch_conversations(spark, sf_dir):
    from .operators.stitch import stitch

    return stitch(_shard_rows(spark, sf_dir))


@query()
def ingest_conversations(spark, sf_dir):
    from .plans.ingest import from_shards

    return from_shards(_shard_rows(spark, sf_dir)).select("id", "doc_id", "parent_id", "is_parent", "seq", "page_start", "page_end", "heading_path", "text")


@query()
def embed_documents(spark, sf_dir):
    from .operators.chunks import raw_chunks
    from .operators.embedding import HashEmbedder, embedded

    docs = _table(spark, sf_dir, "documents")
    first = raw_chunks(docs).where("not is_parent and first").select("doc_id", "chunk_hash", "ord", "breadcrumb", "text")  # children that repeat a parent too: parents have no vectors
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # only where ids repeat do chunks of several rows have to meet
        first = first.groupBy("doc_id", "chunk_hash").agg(F.min_by(F.struct("breadcrumb", "text"), "ord").alias("c")).select("doc_id", "chunk_hash", "c.*")
    return embedded(first.select(T.chunk_id(F.col("doc_id"), F.col("chunk_hash")).alias("id"), F.col("breadcrumb").alias("header_breadcrumb"), "text"), HashEmbedder)


@query()
def html_markdown(spark, sf_dir):
    from .sources.html import markdown

    return _table(spark, sf_dir, "pages").select("page_id", markdown(F.col("html")).alias("markdown"))


@query("""WITH k AS (SELECT c_custkey AS id FROM customer), u AS (SELECT user_id AS id, max(ts) AS last_used_at FROM events GROUP BY user_id)
    SELECT k.id, last_used_at, CASE WHEN k.id % 3 = 0 THEN TIMESTAMP '2024-01-01' WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = k.id AND e.event_type = 'error') THEN TIMESTAMP '2024-02-01' END AS revoked_at FROM k LEFT JOIN u USING (id)""")
def keys_revoked_and_touched(spark, sf_dir):
    from .operators import tables

    e, at = _table(spark, sf_dir, "events"), lambda day: F.lit(day).cast("timestamp_ntz")
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(None).alias("last_used_at"), F.when(F.col("c_custkey") % 3 == 0, at("2024-01-01")).alias("revoked_at"))
    out = tables.revoked(keys, e.where("event_type = 'error'").select(F.col("user_id").alias("id")), at("2024-02-01"))
    return tables.touched(out, e.select(F.col("user_id").alias("api_key_id"), F.col("ts").alias("created_at")))


@query("SELECT c_custkey AS id, CAST(c_custkey % 5 + (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS INTEGER) AS shards_failed FROM customer")
def failures_added(spark, sf_dir):
    from .operators import tables

    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).cast("int").alias("shards_failed"))
    return tables.added(docs, _table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.lit(1).alias("shards_failed")), ["id"])


@query("SELECT user_id AS doc_id, event_id AS idx FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-10'")
def expired_leases(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("state"), F.col("ts").alias("lease_until"))
    return jobs.expired(e, F.lit("2024-01-10").cast("timestamp_ntz")).select("doc_id", "idx")


@query("SELECT user_id AS doc_id, count(*) AS newly_failed FROM events WHERE event_type = 'error' AND event_id % 8 >= 4 GROUP BY user_id")
def escalated_shards(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("state"), (F.col("event_id") % 8).alias("attempts"))
    return jobs.escalated(e)[1]


@query("""WITH t AS (SELECT event_type AS k, min(event_id) AS first_id FROM events WHERE event_id < 500 GROUP BY event_type)
    SELECT e.event_type AS k, coalesce(t.first_id, -1) AS first_id, max(e.value) AS top FROM events e LEFT JOIN t ON t.k = e.event_type GROUP BY ALL""")
def upsert_rollup(spark, sf_dir):
    from .operators import tables

    e = _table(spark, sf_dir, "events")
    old = e.where("event_id < 500").groupBy(F.col("event_type").alias("k")).agg(F.min("event_id").alias("first_id"), F.lit(-1.0).alias("top"))
    new = e.groupBy(F.col("event_type").alias("k")).agg(F.max("value").alias("top"))
    rows = new.join(old.select("k", "first_id"), "k", "left").select("k", F.coalesce("first_id", F.lit(-1)).alias("first_id"), "top")
    return tables.upsert(old, rows, ["k"])


@query("SELECT doc_id, source FROM documents WHERE doc_id < 100 UNION ALL (SELECT doc_id, source FROM documents WHERE doc_id >= 100 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY source) = 1)")
def insert_ignore(spark, sf_dir):
    from .operators import tables

    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return tables.insert_ignore(d.where("doc_id < 100"), d, ["doc_id"], ["source"])
