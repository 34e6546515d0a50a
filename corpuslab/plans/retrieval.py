"""Registered queries of ranking and its evaluation.

The fixed evaluation passages play the questions: those whose start stands in a document are answerable.
Every passage is asked whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import STOP_RANK, tokens
from corpuslab.operators import evaluation as ev
from corpuslab.operators import ranking as rk
from corpuslab.sources.tables import table

K = 5


def docs_of(spark: SparkSession, root: str) -> DataFrame:
    """Documents as they are ranked, counted and shown: title and text as one; null only if both are."""
    whole = F.when(F.coalesce("title", "text").isNotNull(), F.concat_ws(" ", "title", "text"))
    return table(spark, root, "documents").select("doc_id", whole.alias("text"), F.lower(F.trim("source")).alias("source"))


def questions_of(spark: SparkSession, root: str) -> DataFrame:
    return ev.planted_questions(table(spark, root, "eval_items"), docs_of(spark, root))


def _plain(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def index_of(spark: SparkSession, root: str) -> rk.TermIndex:
    return rk.TermIndex(docs_of(spark, root), _plain(spark, root))


def _bm25(spark: SparkSession, root: str, k: int = K) -> DataFrame:
    return index_of(spark, root).top(k)


def tokens_rank(spark: SparkSession, root: str) -> DataFrame:
    """Ranking tokens of every document, counted and listed."""
    t = tokens(F.col("text"), "rank")
    return docs_of(spark, root).select("doc_id", F.size(t).cast("long").alias("n"), F.concat_ws(" ", t).alias("terms")).filter("n >= 0")


def doc_len(spark: SparkSession, root: str) -> DataFrame:
    """Length of every document in ranking tokens."""
    return rk.doc_lengths(docs_of(spark, root), "doc_id", "text")


def term_df(spark: SparkSession, root: str) -> DataFrame:
    """Document and collection frequency of every term."""
    tf = rk.term_frequencies(docs_of(spark, root), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf"))


def bm25_top5(spark: SparkSession, root: str) -> DataFrame:
    """The five best documents of every question by BM25."""
    return _bm25(spark, root).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def tfidf_saturated_top3(spark: SparkSession, root: str) -> DataFrame:
    """The three best documents by saturated TF-IDF; no score, no place; ties to the higher key."""
    top = _tfidf_ranked(spark, root, 3)
    return top.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def scoped_bm25(spark: SparkSession, root: str, k: int) -> DataFrame:
    """The k best documents of every question by BM25 among those of the source it names."""
    docs = docs_of(spark, root).withColumnRenamed("source", "scope")
    return index_of(spark, root).top(k, zeros=False, scope=(docs, questions_of(spark, root).select("qid", F.col("document").alias("scope"))))


def bm25_scoped_by_source(spark: SparkSession, root: str) -> DataFrame:
    """BM25 inside the source a question names, statistics of the whole corpus."""
    top = scoped_bm25(spark, root, K)
    return top.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def planted(spark: SparkSession, root: str) -> DataFrame:
    """Which documents contain the start of which passage."""
    return ev.planted_pairs(questions_of(spark, root), docs_of(spark, root)).select("qid", "doc_id")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return ev.evaluation_rows(questions_of(spark, root), _bm25(spark, root), docs_of(spark, root))


def eval_rows(spark: SparkSession, root: str) -> DataFrame:
    """One evaluation row per question for BM25."""
    return _rows(spark, root)


def eval_summary(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the evaluation."""
    return ev.evaluation_summary(_rows(spark, root))


def eval_separability(spark: SparkSession, root: str) -> DataFrame:
    """Whether a score threshold could separate questions to refuse."""
    return ev.separability(_rows(spark, root))


def eval_by_source(spark: SparkSession, root: str) -> DataFrame:
    """Hits per source."""
    return ev.summary_by_source(_rows(spark, root))


def _tfidf_ranked(spark: SparkSession, root: str, k: int) -> DataFrame:
    return index_of(spark, root).top(k, "tfidf", zeros=False, lower_first=False)


def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Reciprocal rank fusion of the ten best of BM25 and of saturated TF-IDF, the five best."""
    fused = rk.reciprocal_rank_fusion(_bm25(spark, root, 2 * K), _tfidf_ranked(spark, root, 2 * K))
    return rk.fused_top_k(fused, K).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def ranker_disagreement(spark: SparkSession, root: str) -> DataFrame:
    """Questions that BM25 and the fused ranking do not both hit or miss."""
    docs, questions = docs_of(spark, root), questions_of(spark, root)
    fused = rk.fused_top_k(rk.reciprocal_rank_fusion(_bm25(spark, root, 2 * K), _tfidf_ranked(spark, root, 2 * K)), K)
    rows = [ev.evaluation_rows(questions, r, docs).filter("hit is not null") for r in (_bm25(spark, root, 1), fused)]
    return ev.ranker_disagreement(*rows).select("qid", "hit_a", "hit_b", "change")


def unit_norm(spark: SparkSession, root: str) -> DataFrame:
    """Length of every vector before and after normalisation."""
    u = rk.unit(F.col("embedding"))
    return table(spark, root, "embeddings").select("vec_id", F.round(F.sqrt(rk.dot(F.col("embedding"), F.col("embedding"))), 5).alias("before"), F.round(F.sqrt(rk.dot(u, u)), 5).alias("after"))


def knn_top5(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, root, "embeddings")
    near = rk.knn(vectors, vectors.filter("vec_id % 100 = 0"), K)
    return near.select("qid", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def embed_stub(spark: SparkSession, root: str) -> DataFrame:
    """Hashed bag-of-terms vectors of all documents (a stand-in for an embedding model)."""
    made = rk.hashed_embedding(docs_of(spark, root), "doc_id", "text")
    return made.select("doc_id", F.posexplode("embedding").alias("slot", "x")).filter("x <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


def _hybrid(spark: SparkSession, root: str) -> DataFrame:
    docs = docs_of(spark, root)
    queries = _plain(spark, root).select((-F.col("qid")).alias("doc_id"), F.col("query").alias("text"))
    vectors = rk.hashed_embedding(docs.select("doc_id", "text"), "doc_id", "text")
    asked = rk.hashed_embedding(queries, "doc_id", "text")
    sizes = (table(spark, root, "documents").count(), table(spark, root, "eval_items").count())
    near = rk.knn(vectors, asked, 2 * K, key="doc_id", sizes=sizes).select((-F.col("qid")).alias("qid"), "doc_id", "score", "rank")
    return rk.fused_top_k(rk.reciprocal_rank_fusion(_bm25(spark, root, 2 * K), near), K)


def hybrid_top5(spark: SparkSession, root: str) -> DataFrame:
    """BM25 fused with the vector ranking of the stand-in embedding."""
    return _hybrid(spark, root).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def rescued_dropped(spark: SparkSession, root: str) -> DataFrame:
    """Questions that the hybrid ranking rescues or drops against BM25."""
    docs, questions = docs_of(spark, root), questions_of(spark, root)
    rows = [ev.evaluation_rows(questions, r, docs).filter("hit is not null") for r in (_bm25(spark, root), _hybrid(spark, root))]
    return ev.ranker_disagreement(*rows).groupBy("change").agg(F.count("*").alias("n"))


def context_assembly(spark: SparkSession, root: str) -> DataFrame:
    """The context that the three best documents make for every question."""
    made = ev.contexts(_bm25(spark, root, 3), docs_of(spark, root))
    return made.select("qid", F.md5("context").alias("digest"), F.length("context").cast("long").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_rank, doc_len, term_df, bm25_top5, tfidf_saturated_top3, bm25_scoped_by_source, planted, eval_rows, eval_summary,
        eval_separability, eval_by_source, rrf_fusion, ranker_disagreement, unit_norm, knn_top5, embed_stub, hybrid_top5,
        rescued_dropped, context_assembly,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOP_RANK)
RANK_SQL = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9$£€.\\-/]+'), lambda t: t NOT IN ({_STOP}))"
_BASE = f"""
WITH docs AS (SELECT doc_id, CASE WHEN coalesce(title, text) IS NOT NULL THEN concat_ws(' ', title, text) END AS text, lower(trim(source)) AS source FROM documents WHERE doc_id IS NOT NULL),
toks AS (SELECT doc_id, {RANK_SQL.format('text')} AS t FROM docs),
lens AS (SELECT doc_id, coalesce(len(t), 0) AS dl FROM toks),
tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL)
"""
_QUERY = f"""
, qs AS (SELECT item_id AS qid, category, text AS query, substr(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 1, 60) AS key FROM eval_items),
qt AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({RANK_SQL.format('query')}) AS term FROM qs) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
bm AS (SELECT qid, doc_id, sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL),
sat AS (SELECT qid, doc_id, sum(qf * idf * least(f, 3)) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL),
pad AS (SELECT qid, doc_id, max(score) AS score FROM (SELECT * FROM bm UNION ALL
  SELECT DISTINCT qid, d.doc_id, 0.0::DOUBLE FROM qt CROSS JOIN (SELECT DISTINCT doc_id FROM docs ORDER BY doc_id LIMIT 40) d) GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(score, 6) AS score FROM pad)),
satr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT qid, doc_id, round(score, 6) AS score FROM sat)),
hay AS (SELECT doc_id, source, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') AS h FROM docs),
plant AS (SELECT qid, doc_id, source FROM qs JOIN hay ON contains(h, key)),
quest AS (SELECT qs.*, coalesce(n_planted, 0) AS n_planted, document, CASE WHEN n_planted > 0 THEN 'answerable' ELSE 'refuse' END AS expect
  FROM qs LEFT JOIN (SELECT qid, count(*) AS n_planted, arg_min(source, doc_id) AS document FROM plant GROUP BY qid) USING (qid))
"""


def _fuse(other: str) -> str:
    return f""", pool AS (SELECT qid, doc_id, rank, 0 AS list FROM bmr WHERE rank <= 10 UNION ALL SELECT qid, doc_id, rank, 1 FROM {other} WHERE rank <= 10),
fus AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((list, rank)) AS first FROM pool GROUP BY ALL),
fusr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM fus)"""


def _scored(name: str, ranked: str, k: int) -> str:
    return f""", {name} AS (
SELECT q.qid, category, expect, document, (expect = 'answerable')::BIGINT AS answerable,
  CASE WHEN expect = 'answerable' THEN coalesce(hit, 0) END::BIGINT AS hit, CASE WHEN expect = 'answerable' THEN coalesce(u, 0) END::BIGINT AS "union",
  CASE WHEN expect <> 'answerable' THEN coalesce(top, 0) < 2.0 END::BIGINT AS refused, coalesce(top, 0)::DOUBLE AS top_score, CASE WHEN hit = 1 THEN win END AS winner,
  CASE WHEN expect <> 'answerable' THEN 'GONE' WHEN coalesce(hit, 0) = 1 THEN 'hit' ELSE 'MISS' END AS status
FROM quest q LEFT JOIN (SELECT r.qid, max(contains(h, key)::INT) AS hit, contains(string_agg(h, '' ORDER BY rank), any_value(key))::INT AS u, max(score) AS top,
  arg_min(source, rank) FILTER (contains(h, key)) AS win FROM {ranked} r JOIN hay USING (doc_id) JOIN qs ON qs.qid = r.qid WHERE rank <= {k} GROUP BY r.qid) p ON p.qid = q.qid)"""


_ROWS = _BASE + _QUERY + _scored("rows", "bmr", 5)
_VEC = """, slots AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS slot, sum(f)::DOUBLE AS c FROM tf GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM slots GROUP BY doc_id)"""
_QVEC = """, qslots AS (SELECT qid, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS slot, sum(qf)::DOUBLE AS c FROM qt GROUP BY ALL),
qnorms AS (SELECT qid, sqrt(sum(c * c)) AS norm FROM qslots GROUP BY qid),
near AS (SELECT q.qid, d.doc_id, round(coalesce(s, 0), 5) + 0.0 AS score FROM (SELECT DISTINCT qid FROM qs) q CROSS JOIN (SELECT doc_id FROM docs) d LEFT JOIN
  (SELECT qid, doc_id, sum(a.c / n.norm * (b.c / m.norm)) AS s FROM qslots a JOIN qnorms n USING (qid) JOIN slots b USING (slot) JOIN norms m USING (doc_id) GROUP BY ALL) x ON x.qid = q.qid AND x.doc_id = d.doc_id),
nearr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM near)"""

SCOPED_HYBRID_SQL = (
    _BASE
    + _QUERY.replace("bmr AS", "bmr0 AS")
    + _VEC
    + _QVEC.replace("nearr AS", "nearr0 AS")
    + """, bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(score, 6) AS score FROM bm JOIN docs USING (doc_id) JOIN quest USING (qid)
  WHERE document IS NULL OR document = source)),
nearr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT qid, doc_id, score FROM near JOIN docs USING (doc_id) JOIN quest USING (qid) WHERE document IS NULL OR document = source))"""
    + _fuse("nearr")
    + "SELECT qid, doc_id, score, rank FROM fusr WHERE rank <= 5"
)

ORACLES: dict[str, str] = {
    "tokens_rank": _BASE + "SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS terms FROM toks WHERE t IS NOT NULL",
    "doc_len": _BASE + "SELECT doc_id, dl FROM lens",
    "term_df": _BASE + "SELECT term, count(*) AS df, sum(f)::BIGINT AS cf FROM tf GROUP BY term",
    "bm25_top5": _BASE + _QUERY + "SELECT qid, doc_id, score, rank FROM bmr WHERE rank <= 5",
    "tfidf_saturated_top3": _BASE + _QUERY + "SELECT qid, doc_id, score, rank FROM satr WHERE rank <= 3",
    "bm25_scoped_by_source": _BASE
    + _QUERY
    + """SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
FROM bm JOIN docs USING (doc_id) JOIN quest USING (qid) WHERE document IS NULL OR document = source) WHERE rank <= 5""",
    "planted": _BASE + _QUERY + "SELECT qid, doc_id FROM plant",
    "eval_rows": _ROWS + "SELECT * FROM rows",
    "eval_summary": _ROWS
    + """SELECT count(*) AS questions, count_if(expect = 'answerable')::BIGINT AS answerable, coalesce(sum(hit), 0)::BIGINT AS hits, coalesce(sum("union"), 0)::BIGINT AS unions,
  count_if(expect <> 'answerable')::BIGINT AS must_refuse, coalesce(sum(refused), 0)::BIGINT AS refused,
  floor(coalesce(sum(hit), 0) * 100 / greatest(count_if(expect = 'answerable'), 1))::BIGINT AS hit_percent,
  (count_if(expect = 'answerable') - coalesce(sum(hit), 0))::BIGINT AS lost_in_ranking, count_if(expect <> 'answerable')::BIGINT AS lost_in_corpus FROM rows""",
    "eval_separability": _ROWS
    + """SELECT worst_leak, weakest_hit, coalesce(worst_leak < weakest_hit, false) AS separates
FROM (SELECT max(top_score) FILTER (expect = 'refuse') AS worst_leak, min(top_score) FILTER (hit = 1) AS weakest_hit FROM rows)""",
    "eval_by_source": _ROWS + "SELECT coalesce(winner, document) AS source, count(*) AS questions, sum(hit)::BIGINT AS hits FROM rows WHERE expect = 'answerable' GROUP BY 1",
    "rrf_fusion": _BASE + _QUERY + _fuse("satr") + "SELECT qid, doc_id, score, rank FROM fusr WHERE rank <= 5",
    "ranker_disagreement": _BASE
    + _QUERY
    + _fuse("satr")
    + _scored("ra", "bmr", 1)
    + _scored("rb", "fusr", 5)
    + "SELECT qid, ra.hit AS hit_a, rb.hit AS hit_b, CASE WHEN rb.hit = 1 THEN 'rescued' ELSE 'dropped' END AS change FROM ra JOIN rb USING (qid) WHERE ra.hit <> rb.hit",
    "unit_norm": """SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS before, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS after
FROM (SELECT vec_id, v, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""",
    "knn_top5": """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings)
SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id DESC) AS rank FROM
  (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.u, v.u), 5) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5""",
    "embed_stub": _BASE + _VEC + "SELECT doc_id, slot, round(c / norm, 6) AS x FROM slots JOIN norms USING (doc_id)",
    "hybrid_top5": _BASE + _QUERY + _VEC + _QVEC + _fuse("nearr") + "SELECT qid, doc_id, score, rank FROM fusr WHERE rank <= 5",
    "rescued_dropped": _BASE
    + _QUERY
    + _VEC
    + _QVEC
    + _fuse("nearr")
    + _scored("ra", "bmr", 5)
    + _scored("rb", "fusr", 5)
    + "SELECT CASE WHEN rb.hit = 1 THEN 'rescued' ELSE 'dropped' END AS change, count(*) AS n FROM ra JOIN rb USING (qid) WHERE ra.hit <> rb.hit GROUP BY 1",
    "context_assembly": _BASE
    + _QUERY
    + """SELECT qid, md5(c) AS digest, length(c) AS chars FROM (SELECT qid, string_agg('[' || doc_id || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS c
FROM bmr JOIN docs USING (doc_id) WHERE rank <= 3 GROUP BY qid)""",
}
