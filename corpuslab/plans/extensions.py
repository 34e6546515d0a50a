"""Registered queries without an SQL equivalent: streams, proposed keys, fuzzy similarity, caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import keys, models, ranking, runs
from corpuslab.plans.retrieval import RANK_SQL
from corpuslab.session import cut_lineage, ensure_checkpoint_dir, remove_folder
from corpuslab.sources.tables import table
from corpuslab.streaming import questions as st


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_questions_stream(spark: SparkSession, root: str) -> DataFrame:
    """Questions through the stream that lets each id pass once."""
    out, state = _folder(spark, "questions"), _folder(spark, "state")
    st.run_to_end(st.new_questions(st.stream_table(spark, root, "questions_public")), out, state)
    remove_folder(spark, state)
    return spark.read.parquet(out).select("qid", "category", "expect")


def event_window_stream(spark: SparkSession, root: str) -> DataFrame:
    """Events per type and five minutes through the windowed stream, the last open windows included."""
    out, state = _folder(spark, "windows"), _folder(spark, "state")
    stream = st.stream_table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    st.run_updates(st.event_windows(stream, "ts", "event_type", "value"), out, state)
    remove_folder(spark, state)
    last = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select("window.start", "event_type", "last.n", F.round("last.total", 6).alias("total"))


def proposed_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys proposed for the passages of the fixed evaluation set, asked whole, from the current documents."""
    asked = table(spark, root, "eval_items").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return keys.proposed_keys(asked, table(spark, root, "documents").select("doc_id", "text"))


def similarity_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Fuzzy similarity of question and answer of every distinct pair."""

    @F.pandas_udf("double")
    def ratio(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([runs.similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])

    pairs = table(spark, root, "faq_export").select("faq_id", "question", "answer").distinct()
    return pairs.select("faq_id", F.round(ratio("question", "answer"), 6).alias("ratio"))


def embedding_cache(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of all distinct texts, those of half of them from a cache."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    cache = cut_lineage(ranking.cached_embeddings(docs.filter("doc_id % 2 = 0"), "doc_id", "text", None, "stub"))
    made = ranking.cached_embeddings(docs, "doc_id", "text", cache, "stub")
    return made.select("text_hash", F.array_join(F.transform("embedding", lambda x: F.round(x, 5).cast("decimal(7,5)").cast("string")), ",").alias("vector"))


def model_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Two stand-in models on the fixed evaluation passages."""
    prompts = table(spark, root, "eval_items").select("item_id", "text")
    return models.compare_models(prompts, "item_id", "text", models.StubClient(), ("a", "b")).select("item_id", "same")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (append_questions_stream, event_window_stream, proposed_keys, similarity_ratio, embedding_cache, model_comparison)
}

ORACLES: dict[str, str] = {
    "embedding_cache": f"""WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), w AS (SELECT text, unnest({RANK_SQL.format('text')}) AS term FROM t),
s AS (SELECT text, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM w GROUP BY ALL), n AS (SELECT text, sqrt(sum(c * c)) AS norm FROM s GROUP BY text),
v AS (SELECT t.text, i, coalesce(c / norm, 0) AS x FROM t CROSS JOIN range(0, 64) r(i) LEFT JOIN s ON s.text = t.text AND slot = i LEFT JOIN n ON n.text = t.text)
SELECT sha256(text) AS text_hash, string_agg(round(x, 5)::DECIMAL(7, 5)::VARCHAR, ',' ORDER BY i) AS vector FROM v GROUP BY text""",
    "event_window_stream": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "append_questions_stream": "SELECT qid, any_value(category) AS category, any_value(expect) AS expect FROM questions_public GROUP BY qid",
}
