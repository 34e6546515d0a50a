"""Registered queries of readers, text helpers, question upkeep, scoped hybrid ranking and model runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import auditing, models, ranking, records, runs
from corpuslab.operators import segments as sg
from corpuslab.plans import audits, retrieval, sections, training
from corpuslab.sources import readers
from corpuslab.sources.tables import table


def squash_places(spark: SparkSession, root: str) -> DataFrame:
    """Where the characters of every document stand that are no white space."""
    places = tx.squash_offsets(F.col("text"))
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.size(places).cast("long").alias("n"), F.md5(F.array_join(places.cast("array<string>"), ",")).alias("places"))


def source_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """Records per identifier without its last part."""
    return table(spark, root, "records").groupBy(tx.id_prefix(F.col("doc_id")).alias("prefix")).agg(F.count("*").alias("n"))


def elided_texts(spark: SparkSession, root: str) -> DataFrame:
    """The ends of every document that is longer than 200 characters."""
    return table(spark, root, "documents").select("doc_id", tx.elide(F.col("text"), 200).alias("shown"))


def candidate_terms(spark: SparkSession, root: str) -> DataFrame:
    """Terms of candidate questions in lines of the form `question | extra`; refused questions are comments."""
    line = F.concat(F.when(F.col("expect") == "refuse", "# ").otherwise(" "), "question", F.lit(" | "), F.coalesce("category", F.lit("")), F.lit(", "))
    made = auditing.parse_candidates(table(spark, root, "questions_public").select(line.alias("value")))
    return made.select("question", F.array_join(F.array_sort("terms"), ",").alias("terms"))


def audited_questions(spark: SparkSession, root: str) -> DataFrame:
    """Questions after decisions, here made by the length of the question: delete, fix or keep."""
    questions = table(spark, root, "questions_public").select("row_id", "qid", "question", "category", "note", F.col("document").alias("key"))
    action = F.element_at(F.array(F.lit("delete"), F.lit("fix"), F.lit("keep")), (F.length("question") % 3 + 1).cast("int"))
    decisions = questions.select("qid", action.alias("action"), F.col("category").alias("new_key"), F.col("note").alias("reason"))
    return records.apply_decisions(questions.select("row_id", "qid", "question", "key"), decisions).select("row_id", "qid", "key")


def renumbered_questions(spark: SparkSession, root: str) -> DataFrame:
    """Distinct questions with new sequential ids."""
    old = table(spark, root, "questions_public").filter("qid is not null").select(F.col("qid").alias("old")).distinct()
    return auditing.renumbered(old, "old")


def questions_without_last(spark: SparkSession, root: str) -> DataFrame:
    """Rows of questions without the last twenty."""
    return records.without_last(table(spark, root, "questions_public").select("row_id", "qid"), "row_id", 20)


def grounding_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Prompt tokens that the contexts of all questions add."""
    asked = audits.answers(spark, root, 0).select(F.coalesce("question", F.lit("")).alias("q"), F.coalesce("context", F.lit("")).alias("c"))
    plain, grounded = (tx.token_estimates(x)["by_words"] for x in (F.col("q"), F.concat("c", F.lit(" "), "q")))
    return runs.grounding_cost(asked.select(plain.alias("plain"), grounded.alias("grounded")), "grounded", "plain")


def _numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    marked = F.regexp_replace("text", r"(?m)^# *", "7. ")
    return sg.lines_of(table(spark, root, "documents").select("doc_id", marked.alias("text")), "doc_id", "text")


def numbered_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections of documents by numbered headings (marked headings get a number here), page furniture left out."""
    made = sg.numbered_sections(_numbered_lines(spark, root), "doc_id")
    return made.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "number", "title", F.md5("body").alias("body"))


def handbook_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections by font evidence, and by the text alone for documents where that gives none, as records."""
    lines = sections.font_lines_of_documents(spark, root)
    joined = lines.join(sg.body_size(lines, "doc_id", "size"), "doc_id")
    boost = sg.font_boost(F.col("size"), F.col("body_size"), F.col("bold"), F.col("line"))
    both = sg.with_fallback(sg.sections(joined, "doc_id", boost=boost, font=True), sg.sections(sections.document_lines(spark, root), "doc_id"), "doc_id")
    made = readers.section_records(both.select("doc_id", "section_no", "title", "body"), "doc_id", "handbook.pdf")
    return made.select("doc_id", "title", F.md5("text").alias("text"))


def json_announcement_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of JSON announcement exports whose shape varies."""
    return readers.announcement_payload_records(table(spark, root, "announcements_raw").select("export_id", "payload")).select("doc_id", "title", "text", "updated")


def hybrid_scoped_top5(spark: SparkSession, root: str) -> DataFrame:
    """BM25 and the vector ranking inside the source a question names, fused."""
    docs, questions = retrieval.docs_of(spark, root), retrieval.questions_of(spark, root)
    k = retrieval.K
    lexical = retrieval.scoped_bm25(spark, root, 2 * k)
    vectors = ranking.hashed_embedding(docs.select("doc_id", "text"), "doc_id", "text").join(docs.select("doc_id", F.col("source").alias("scope")), "doc_id")
    named = questions.select((-F.col("qid")).alias("doc_id"), F.col("document").alias("scope"))
    asked = ranking.hashed_embedding(questions.select((-F.col("qid")).alias("doc_id"), F.col("query").alias("text")), "doc_id", "text").join(F.broadcast(named), "doc_id")
    sizes = (table(spark, root, "documents").count(), table(spark, root, "eval_items").count())
    near = ranking.knn(vectors, asked, 2 * k, key="doc_id", sizes=sizes, scope="scope").select((-F.col("qid")).alias("qid"), "doc_id", "score", "rank")
    top = ranking.fused_top_k(ranking.reciprocal_rank_fusion(lexical, near), k)
    return top.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _prompts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").select(F.col("item_id").alias("id"), "text")


def case_scorecard(spark: SparkSession, root: str) -> DataFrame:
    """Scorecard of two stand-in models over cases with a fact and cases that must be refused."""
    items = table(spark, root, "eval_items")
    fact = F.when(F.col("item_id") % 3 != 0, F.element_at(F.split("text", " "), -1))
    cases = items.select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.lit("").alias("context"), fact.alias("fact"))
    return runs.scorecard(models.run_cases(cases, models.StubClient(), ("a", "b")))


def task_latency(spark: SparkSession, root: str) -> DataFrame:
    """Latency and cost of the three tasks with the stand-in model."""
    one = _prompts(spark, root)
    calls = models.run_tasks({"sentiment": one, "summarize": one, "extract": one}, models.StubClient(), "stub")
    return runs.latency_summary(calls, "task", "seconds", F.col("tokens_in"), F.col("tokens_out"), F.col("ok"))


def noise_floor(spark: SparkSession, root: str) -> DataFrame:
    """What differs between ten identical calls of the stand-in model."""
    return models.noise_floor(_prompts(spark, root), "text", models.StubClient(), "stub").drop("text")


def temperature_identity(spark: SparkSession, root: str) -> DataFrame:
    """Whether the stand-in model says the same twice at temperature 0."""
    return models.temperature_identity(_prompts(spark, root), "id", "text", models.StubClient(), "stub")


def grounded_vs_plain(spark: SparkSession, root: str) -> DataFrame:
    """Every question asked with and without its context, with what the context costs."""
    return models.grounded_and_plain(audits.answers(spark, root, 0).select("qid", F.coalesce("question", F.lit("")).alias("question"), "context").dropDuplicates(["qid"]), models.StubClient(), "stub")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        squash_places, source_prefixes, elided_texts, candidate_terms, audited_questions, renumbered_questions, questions_without_last,
        grounding_tokens, numbered_sections, handbook_sections, json_announcement_records, hybrid_scoped_top5, case_scorecard,
        task_latency, noise_floor, temperature_identity, grounded_vs_plain,
    )
}

_WS = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"round_even(len(list_filter(string_split({_flat(c)}, ' '), lambda w: w <> '')) * 1.17::DOUBLE, 0)::BIGINT"


_SWEEP = "list_filter(regexp_extract_all(lower(q), '[a-z0-9][a-z0-9''-]*'), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_SWEEP) + "))"
_PARTS = "[" + ", ".join(f"'{x}'" for x in sg.FURNITURE_PARTS) + "]"

ORACLES: dict[str, str] = {
    "squash_places": f"""WITH p AS (SELECT doc_id, list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(text[i:i], '[{_WS}]')) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(p) AS n, md5(array_to_string(p, ',')) AS places FROM p""",
    "source_prefixes": "SELECT regexp_replace(doc_id, '-[^-]*$', '') AS prefix, count(*) AS n FROM records GROUP BY 1",
    "elided_texts": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 100) || ' … [' || (length(text) - 200) || ' more] … ' || right(text, 100) ELSE text END AS shown FROM documents",
    "candidate_terms": f"""WITH l AS (SELECT trim(question) AS q, coalesce(category, '') AS c FROM questions_public WHERE expect IS DISTINCT FROM 'refuse' AND question IS NOT NULL),
t AS (SELECT q, list_filter([lower(trim(c))], lambda x: x <> '') AS given, {_SWEEP} AS own FROM l)
SELECT q AS question, array_to_string(list_sort(list_distinct(list_concat(given, own, list_transform(list_filter(own, lambda w: length(w) > 4 AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]s$')), lambda w: regexp_replace(w, 's$', ''))))), ',') AS terms FROM t""",
    "audited_questions": """WITH d AS (SELECT qid, action, category FROM (SELECT qid, category, ['delete', 'fix', 'keep'][length(question) % 3 + 1] AS action,
  row_number() OVER (PARTITION BY qid ORDER BY ['delete', 'fix', 'keep'][length(question) % 3 + 1] DESC NULLS LAST, category DESC NULLS LAST, note DESC NULLS LAST) AS nth FROM questions_public) WHERE nth = 1)
SELECT row_id, q.qid, CASE WHEN action = 'fix' THEN d.category ELSE document END AS key FROM questions_public q LEFT JOIN d ON d.qid = q.qid WHERE action IS NULL OR action <> 'delete'""",
    "renumbered_questions": """SELECT qid AS old, 'q' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') AS qid FROM (SELECT qid, row_number() OVER (ORDER BY qid) AS n FROM (SELECT DISTINCT qid FROM questions_public WHERE qid IS NOT NULL))""",
    "questions_without_last": "SELECT row_id, qid FROM (SELECT row_id, qid, row_number() OVER (ORDER BY row_id DESC) AS n FROM questions_public) WHERE n > 20",
    "grounding_tokens": f"""WITH cur AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, text DESC) AS nth FROM records) WHERE nth = 1),
a AS (SELECT coalesce(question, '') AS q, coalesce(text, '') AS c FROM (SELECT DISTINCT faq_id, question, answer FROM faq_export) f LEFT JOIN cur ON doc_id = 'faq-F' || lpad((substr(faq_id, 2)::BIGINT)::VARCHAR, 7, '0'))
SELECT sum({_words("c || ' ' || q")} - {_words('q')})::BIGINT AS extra_tokens, count(*) AS questions FROM a""",
    "numbered_sections": f"""WITH docs AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^# *', '7. ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no, regexp_replace(l[line_no], '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS line_no FROM docs)),
kept AS (SELECT *, regexp_matches(line, '^(\\d+)\\.\\s+(.+)$') AS head FROM lines WHERE line <> '' AND len(list_filter({_PARTS}, lambda x: contains(line, x))) = 0),
placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM kept),
secs AS (SELECT doc_id, s, max(line) FILTER (head) AS h, coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT head), '') AS body FROM placed WHERE s > 0 GROUP BY doc_id, s)
SELECT doc_id, s::BIGINT AS section_no, regexp_extract(h, '^(\\d+)\\.\\s+(.+)$', 1) AS number, regexp_extract(h, '^(\\d+)\\.\\s+(.+)$', 2) AS title, md5(body) AS body FROM secs""",
    "json_announcement_records": training.P1_SQL
    + f"""SELECT 'ann-' || ann_id AS doc_id, coalesce({_flat('title')}, '') AS title, coalesce({_flat("concat_ws(' ', title, ps)")}, '') AS text, coalesce(posted, '') AS updated
FROM anns LEFT JOIN (SELECT export_id, source, base, ann_no, string_agg(paragraph, ' ' ORDER BY par_no) AS ps FROM paras GROUP BY ALL) p USING (export_id, source, base, ann_no) WHERE source = 'raw' AND ann_id IS NOT NULL""",
    "hybrid_scoped_top5": retrieval.SCOPED_HYBRID_SQL,
}
