"""Registered queries of records, costs and the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.keys import norm_key
from corpuslab.operators import costs, records
from corpuslab.sources.tables import table


def faq_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of the question and answer export."""
    return records.faq_records(table(spark, root, "faq_export"))


def announcement_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of the typed announcement exports."""
    return records.announcement_records(table(spark, root, "announcements"))


def _checked(spark: SparkSession, root: str) -> DataFrame:
    cols = ["doc_id", "source_file", "source_type", "title", "text", "updated", "loaded_at"]
    return records.checked(table(spark, root, "records").select(*cols), "loaded_at")


def validate_good(spark: SparkSession, root: str) -> DataFrame:
    """Records without a problem."""
    return _checked(spark, root).filter(F.size("problems") == 0).select("doc_id", "title", F.length("text").cast("long").alias("chars"))


def validate_reasons(spark: SparkSession, root: str) -> DataFrame:
    """How many records have each combination of problems."""
    joined = F.array_join("problems", "; ").alias("reasons")
    return _checked(spark, root).filter(F.size("problems") > 0).groupBy(joined).agg(F.count("*").alias("n"))


def type_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per source type in its normal form."""
    return table(spark, root, "records").groupBy(norm_key(F.col("source_type")).alias("source_type")).agg(F.count("*").alias("n"))


def union_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of both exports together, per type."""
    both = faq_records(spark, root).unionByName(announcement_records(spark, root))
    return both.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def dedupe_exact(spark: SparkSession, root: str) -> DataFrame:
    """Distinct texts of documents with the lowest id and the number of copies."""
    docs = table(spark, root, "documents").filter("text is not null")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def public_projection(spark: SparkSession, root: str) -> DataFrame:
    """Questions as they may be published."""
    return records.public_questions(table(spark, root, "questions_public"))


def json_props_extract(spark: SparkSession, root: str) -> DataFrame:
    """A field of a JSON text next to whether the text has exactly the keys it should have."""
    return table(spark, root, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), tx.json_complies(F.col("props"), ("k",)).alias("complies"))


def fee_rows(spark: SparkSession, root: str) -> DataFrame:
    """Fee tables in texts (made of customer rows here) as records of their own."""
    key = F.col("c_custkey").cast("string")
    fee = F.concat(F.lit("Fees. Age group Season fee Instalment Kit included U"), (F.col("c_custkey") % 7 + 8).cast("string"), F.lit(" – U"), (F.col("c_custkey") % 7 + 9).cast("string"), F.lit(" £"), key, F.lit(".50 £12.25 x 4 "), F.when(F.col("c_custkey") % 3 == 0, "Yes").otherwise("Training top only"), F.lit(" Pay early."))
    made = table(spark, root, "customer").select(key.alias("doc_id"), F.lit("f").alias("source_file"), F.lit("policy").alias("source_type"), F.lit("Fees").alias("title"), fee.alias("text"), F.lit("").alias("updated"))
    return records.split_fee_tables(made).select("doc_id", "title", "text")


def count_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Bytes, words and characters of every document."""
    return costs.count_tokens(table(spark, root, "documents"), "doc_id", "text")


def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    """Rough token counts of every document."""
    made = tx.token_estimates(F.coalesce("text", F.lit("")))
    return table(spark, root, "documents").select("doc_id", *[c.alias(n) for n, c in made.items()])


def cost_by_source_type(spark: SparkSession, root: str) -> DataFrame:
    """Documents, tokens, mean and share per source type."""
    counts, meta = table(spark, root, "token_counts"), table(spark, root, "metadata")
    return costs.cost_by_source(counts, meta, counts.count())


def corpus_stats_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Documents and tokens per source file with the total."""
    return costs.corpus_stats(table(spark, root, "records"), "source_file", "source_type", "text")


def retrieval_saving(spark: SparkSession, root: str) -> DataFrame:
    """Whole corpus against four records as context."""
    return costs.retrieval_saving(table(spark, root, "records"), "text")


def most_expensive(spark: SparkSession, root: str) -> DataFrame:
    """The largest document by words."""
    return costs.largest(count_tokens(spark, root), "doc_id", "word")


def record_profile(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of records per topic."""
    return costs.length_profile(table(spark, root, "records"), "topic", "text")


def tokenizer_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals per kind of token."""
    return costs.tokenizer_totals(count_tokens(spark, root), ("bytes", "word", "chars"))


def length_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Documents per 100 characters of length."""
    return costs.histogram(table(spark, root, "documents").select(F.length("text").alias("n")), "n", 100)


def unmatched_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata rows whose document has no token count."""
    meta = table(spark, root, "metadata").select("row_id", norm_key(F.col("doc_id")).alias("key")).filter("key is not null")
    counts = table(spark, root, "token_counts").select(norm_key(F.col("doc_id")).alias("key")).filter("key is not null")
    return costs.unmatched(meta, counts, "key")


def customers_without_orders(spark: SparkSession, root: str) -> DataFrame:
    """Customers without any urgent order."""
    orders = table(spark, root, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return costs.unmatched(table(spark, root, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def order_join_check(spark: SparkSession, root: str) -> DataFrame:
    """Whether joining orders to customers loses rows."""
    return costs.join_report(table(spark, root, "orders"), table(spark, root, "customer"), "o_custkey", "c_custkey")


def region_revenue_share(spark: SparkSession, root: str) -> DataFrame:
    """Share of each region in the value of all orders."""
    orders = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("value"))
    customers = table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, root, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, root, "region").select("r_regionkey", "r_name")
    placed = F.broadcast(nations.join(F.broadcast(regions), "r_regionkey"))
    per = orders.join(customers, "c_custkey").join(placed, "n_nationkey").groupBy("r_name").agg(F.sum("value").alias("value"))
    total = per.agg(F.sum("value")).scalar()
    return per.select("r_name", F.round("value", 0).alias("value"), F.round(F.col("value") * 100 / total, 1).alias("share"))


def expect_rates(spark: SparkSession, root: str) -> DataFrame:
    """Questions per document and the floored percentage that must be refused."""
    q = table(spark, root, "questions_public").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("expect") == "refuse").alias("refuse"))
    return q.withColumn("percent", F.floor(F.col("refuse") * 100 / F.greatest("n", F.lit(1))).cast("long"))


def review_age(spark: SparkSession, root: str) -> DataFrame:
    """Days between review and loading of the metadata of each document, the least per source type."""
    days = F.date_diff(F.col("loaded_at").cast("date"), F.col("last_reviewed"))
    return table(spark, root, "metadata").groupBy(norm_key(F.col("source_type")).alias("source_type")).agg(F.coalesce(F.min(days), F.lit(0)).cast("long").alias("least_days"), F.max(days).cast("long").alias("most_days"))


def handbook_texts(spark: SparkSession, root: str) -> DataFrame:
    """Squashed length and digest of the normal form of every document."""
    s = tx.squash(F.col("text"))
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.length(s).cast("long").alias("squashed"), F.md5(tx.squash_alnum(F.col("text"))).alias("digest"), F.md5(tx.collapse(F.col("text"))).alias("flat"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        faq_records, announcement_records, validate_good, validate_reasons, type_counts, union_records, dedupe_exact, public_projection,
        json_props_extract, fee_rows, count_tokens, token_estimates, cost_by_source_type, corpus_stats_rollup, retrieval_saving,
        most_expensive, record_profile, tokenizer_totals, length_histogram, unmatched_metadata, customers_without_orders,
        order_join_check, region_revenue_share, expect_rates, review_age, handbook_texts,
    )
}

_WS = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"


def _norm(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '')"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"


_WORDS = f"len(list_filter(string_split({_flat('coalesce(text, chr(32))')}, ' '), lambda w: w <> ''))"
_FAQ = f"""SELECT 'faq-' || faq_id AS doc_id, 'faq_export.csv' AS source_file, 'faq' AS source_type, coalesce({_flat('question')}, '') AS title,
  CASE WHEN regexp_matches(answer, '[^{_WS}]') THEN {_flat("concat_ws(' ', question, answer)")} ELSE '' END AS text, coalesce(updated, '') AS updated FROM faq_export"""
_ANN = f"""SELECT 'ann-' || trim(a.id) AS doc_id, 'announcements.json' AS source_file, 'announcement' AS source_type, coalesce({_flat('a.title')}, '') AS title,
  coalesce({_flat("concat_ws(' ', a.title, a.content.body)")}, '') AS text, coalesce(a.meta.posted, '') AS updated FROM (SELECT unnest(announcements) AS a FROM announcements)
  WHERE regexp_matches(a.id, '[^{_WS}]')"""
_CHECKED = """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at) AS nth, trim(coalesce(text, '')) AS t, trim(coalesce(title, '')) AS h FROM records),
checked AS (SELECT *, list_filter([CASE WHEN t = '' THEN 'empty text' END, CASE WHEN h = '' THEN 'empty title' END, CASE WHEN nth > 1 THEN 'duplicate doc_id' END,
  CASE WHEN t <> '' AND t = h THEN 'text adds nothing beyond the title' END], lambda p: p IS NOT NULL) AS problems FROM placed)
"""
_COUNTS = f"""SELECT doc_id, strlen(coalesce(text, '')) AS bytes, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{_WS}]')) AS word, length(coalesce(text, '')) AS chars FROM documents"""

ORACLES: dict[str, str] = {
    "faq_records": _FAQ,
    "announcement_records": _ANN,
    "validate_good": _CHECKED + "SELECT doc_id, title, length(text) AS chars FROM checked WHERE len(problems) = 0",
    "validate_reasons": _CHECKED + "SELECT array_to_string(problems, '; ') AS reasons, count(*) AS n FROM checked WHERE len(problems) > 0 GROUP BY 1",
    "type_counts": f"SELECT {_norm('source_type')} AS source_type, count(*) AS n FROM records GROUP BY 1",
    "union_records": f"SELECT source_type, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({_FAQ} UNION ALL {_ANN}) GROUP BY 1",
    "dedupe_exact": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "public_projection": "SELECT DISTINCT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("qid", "category", "question", "expect", "document", "note")) + " FROM questions_public",
    "json_props_extract": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_keys(props) = ['k'] AS complies FROM events",
    "fee_rows": """WITH c AS (SELECT c_custkey AS k, c_custkey % 7 + 8 AS a, c_custkey % 7 + 9 AS b, CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'Training top only' END AS kit FROM customer)
SELECT k::VARCHAR AS doc_id, 'Fees' AS title, 'Fees. Pay early.' AS text FROM c UNION ALL
SELECT k || '-u' || a || '-u' || b, 'U' || a || ' – U' || b || ' season fee', 'U' || a || ' – U' || b || ': season fee £' || k || '.50, or 4 instalments of £12.25. Kit included: ' || kit || '.' FROM c""",
    "count_tokens": _COUNTS,
    "token_estimates": f"SELECT doc_id, round_even({_WORDS} * 1.17::DOUBLE, 0)::BIGINT AS by_words, round_even({_WORDS} * 1.33::DOUBLE, 0)::BIGINT AS by_cost_factor, (length(coalesce(text, '')) // 4)::BIGINT AS by_chars FROM documents",
    "cost_by_source_type": f"""WITH now AS (SELECT * FROM (SELECT *, {_norm('doc_id')} AS key, row_number() OVER (PARTITION BY {_norm('doc_id')} ORDER BY loaded_at DESC NULLS LAST, subword DESC NULLS LAST, word DESC NULLS LAST) AS nth FROM token_counts) WHERE nth = 1 AND key IS NOT NULL),
meta AS (SELECT key, {_norm('source_type')} AS source_type FROM (SELECT *, {_norm('doc_id')} AS key, row_number() OVER (PARTITION BY {_norm('doc_id')} ORDER BY loaded_at DESC NULLS LAST, source_type DESC NULLS LAST) AS nth FROM metadata) WHERE nth = 1 AND key IS NOT NULL),
used AS (SELECT source_type, CASE WHEN subword > 0 THEN subword ELSE round_even(word * 1.33::DOUBLE, 0)::BIGINT END AS tokens FROM now LEFT JOIN meta USING (key))
SELECT source_type, count(*) AS docs, sum(tokens)::BIGINT AS tokens, round_even(avg(tokens), 0)::BIGINT AS mean_tokens, round(sum(tokens) * 100.0::DOUBLE / sum(sum(tokens)) OVER (), 1) AS share FROM used GROUP BY source_type""",
    "corpus_stats_rollup": f"""WITH s AS (SELECT coalesce(source_file, '') AS source_file, source_type, round_even({_WORDS} * 1.17::DOUBLE, 0)::BIGINT AS n FROM records)
SELECT source_file, count(*) AS docs, sum(n)::BIGINT AS tokens, array_to_string(list_sort(list(DISTINCT source_type) FILTER (source_type IS NOT NULL)), ',') AS kinds, round_even(sum(n)::DOUBLE / count(*), 1) AS mean_tokens FROM s GROUP BY ROLLUP (source_file)""",
    "retrieval_saving": f"""WITH s AS (SELECT sum(round_even({_WORDS} * 1.17::DOUBLE, 0)::BIGINT)::BIGINT AS full_tokens, count(*) AS n FROM records)
SELECT full_tokens, few AS few_tokens, 1200::BIGINT AS budget_tokens, round(full_tokens::DOUBLE / few, 1) AS ratio FROM (SELECT *, round_even(full_tokens::DOUBLE / n * 4, 0)::BIGINT AS few FROM s)""",
    "most_expensive": f"SELECT doc_id, word FROM ({_COUNTS}) ORDER BY word DESC, doc_id LIMIT 1",
    "record_profile": """SELECT coalesce(topic, '') AS topic, count(*) AS docs, floor(median(n))::BIGINT AS median, min(n) AS least, max(n) AS most, count_if(n < 100)::BIGINT AS short, count_if(n > 2000)::BIGINT AS long
FROM (SELECT topic, length(coalesce(text, '')) AS n FROM records) GROUP BY 1""",
    "tokenizer_totals": f"""WITH c AS ({_COUNTS}), u AS (SELECT 'bytes' AS kind, bytes AS n FROM c UNION ALL SELECT 'word', word FROM c UNION ALL SELECT 'chars', chars FROM c)
SELECT kind, sum(n)::BIGINT AS total, round(avg(n), 2) AS mean, min(n) AS least, max(n) AS most, round(sum(n)::DOUBLE / (SELECT sum(word) FROM c), 3) AS to_words FROM u GROUP BY kind""",
    "length_histogram": "SELECT (length(text) // 100 * 100)::BIGINT AS bin, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "unmatched_metadata": f"SELECT {_norm('doc_id')} AS key, row_id FROM metadata m WHERE {_norm('doc_id')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM token_counts t WHERE {_norm('t.doc_id')} = {_norm('m.doc_id')})",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "order_join_check": "SELECT count(*) AS rows_after, (SELECT count(*) FROM orders) AS rows_before, count(*) = (SELECT count(*) FROM orders) AS rows_match FROM orders JOIN customer ON o_custkey = c_custkey",
    "region_revenue_share": """WITH p AS (SELECT r_name, sum(o_totalprice::DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
SELECT r_name, round(v, 0) AS value, round(v * 100 / (SELECT sum(v) FROM p), 1) AS share FROM p""",
    "expect_rates": "SELECT category, count(*) AS n, count_if(expect = 'refuse')::BIGINT AS refuse, floor(count_if(expect = 'refuse') * 100 / greatest(count(*), 1))::BIGINT AS percent FROM questions_public GROUP BY 1",
    "review_age": f"SELECT {_norm('source_type')} AS source_type, coalesce(min(loaded_at::DATE - last_reviewed), 0)::BIGINT AS least_days, max(loaded_at::DATE - last_reviewed)::BIGINT AS most_days FROM metadata GROUP BY 1",
    "handbook_texts": f"SELECT doc_id, length(regexp_replace(text, '[{_WS}]+', '', 'g')) AS squashed, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS digest, md5({_flat('text')}) AS flat FROM documents WHERE text IS NOT NULL",
}
