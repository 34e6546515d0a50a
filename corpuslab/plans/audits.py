"""Registered queries of guards, audits, verbatim checks, chats and runs.

Answers of the question and answer export stand for a model's answers: each is judged against the record of its own pair
(run a) and against that of the next pair (run b), by the guards and a rule instead of a judging model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.keys import is_blank
from corpuslab.operators import auditing, guards, models, runs, verbatim
from corpuslab.operators.records import seeded_sample
from corpuslab.operators.skew import current_rows
from corpuslab.sources.tables import table

CANDIDATES = (
    ("Can my brother and sister share a locker?", ["locker", "sibling"]),
    ("Is there a defibrillator in the sports hall?", ["defibrillator"]),
    ("Do you sell season tickets?", ["season ticket", "ticket"]),
    ("Who keeps the orange flag?", ["orange flag"]),
    ("Are dogs allowed near the slipway?", ["dog", "slipway"]),
)
KEYS = ["orange flag", "the", "£38", "two spare oars", "no such phrase", "ab", "medical card", "quiet-room host"]
RULES = {"environment": r"(^|/)\.env$", "handbook": r"^club-\d+", "notes": r"notes_\d+\.txt$"}


def answers(spark: SparkSession, root: str, step: int) -> DataFrame:
    """`(qid, question, answer, context, expect, retrieved)` of every pair, judged against its record or that of the step-th next, if any."""
    faq = table(spark, root, "faq_export").select("faq_id", "question", "answer").distinct()
    other = F.concat(F.lit("faq-F"), F.lpad((F.substring("faq_id", 2, 20).cast("long") + step).cast("string"), 7, "0"))
    texts = current_rows(table(spark, root, "records"), F.col("doc_id"), ["text"]).select(F.col("key").alias("_d"), F.col("text").alias("context"))
    expect = F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) >= 20, "answerable").otherwise("refuse")
    joined = faq.withColumn("_d", other).join(texts, "_d", "left").drop("_d")
    retrieved = F.contains(tx.squash(F.coalesce("context", F.lit(""))), tx.squash(F.coalesce("answer", F.lit("")))).cast("int")
    return joined.select(F.col("faq_id").alias("qid"), "question", "answer", "context", expect.alias("expect"), retrieved.alias("retrieved"))


def _idf(spark: SparkSession, root: str) -> DataFrame:
    """Rarity of guard tokens over distinct questions."""
    q = table(spark, root, "faq_export").select("question").distinct()
    n = q.agg(F.count("*")).scalar()
    each = q.select(F.explode(F.array_distinct(tx.tokens(F.coalesce("question", F.lit("")), "guard"))).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def grounding(spark: SparkSession, root: str) -> DataFrame:
    """Grounding of every answer in the record of the next pair."""
    return answers(spark, root, 1).select("qid", F.round(guards.grounding(F.col("answer"), F.col("context")), 6).alias("grounding"))


def bad_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of answers that the context lacks."""
    return answers(spark, root, 1).select("qid", F.array_join(guards.bad_numbers(F.col("answer"), F.col("context")), ",").alias("numbers"))


def best_sentence(spark: SparkSession, root: str) -> DataFrame:
    """The sentence of the context an answer leans on."""
    return answers(spark, root, 1).select("qid", guards.best_sentence(F.col("answer"), F.col("context")).alias("quote"))


def _guarded(spark: SparkSession, root: str, step: int) -> DataFrame:
    total = table(spark, root, "faq_export").count() * 6
    return guards.guarded(answers(spark, root, step), _idf(spark, root), "qid", total)


def relevance(spark: SparkSession, root: str) -> DataFrame:
    """Relevance of the quote to the question, weighted by rarity."""
    return _guarded(spark, root, 1).select("qid", F.round("relevance", 6).alias("relevance"), F.round("support", 6).alias("support"))


def guard_reason(spark: SparkSession, root: str) -> DataFrame:
    """The first guard that holds an answer back."""
    return _guarded(spark, root, 1).select("qid", "reason")


def guard_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Answers held back per guard."""
    return guard_reason(spark, root).filter("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, root: str, step: int) -> DataFrame:
    """Judged rows: a rule takes the place of the judging model and of the gate."""
    g = _guarded(spark, root, step)
    said = F.when(F.col("grounding") >= 0.5, F.lit("The answer is SUPPORTED.")).otherwise("The answer is UNSUPPORTED.")
    gate = F.when(is_blank(F.col("answer")), F.lit("?")).when(F.col("relevance") >= 0.3, "COVERED").otherwise("MISSING: nothing fits")
    verdict = F.when(is_blank(F.col("answer")), "REFUSED").otherwise(guards.final_verdict(tx.verdict_of(said), F.col("answer"), F.when(F.col("reason") == "numbers", "numbers").otherwise("")))
    return g.select("qid", "expect", "retrieved", verdict.alias("verdict"), tx.gate_of(gate).alias("gate"), tx.refusal_kind(F.col("answer")).alias("refusal"), "reason")


def verdict_parse(spark: SparkSession, root: str) -> DataFrame:
    """Verdict and gate of every answer of run b."""
    return _judged(spark, root, 1).select("qid", "verdict", "gate")


def outcome_matrix(spark: SparkSession, root: str) -> DataFrame:
    """All outcomes of run b."""
    return guards.outcome_matrix(_judged(spark, root, 1))


def gate_confusion(spark: SparkSession, root: str) -> DataFrame:
    """Gate against truth in run b."""
    return guards.gate_confusion(_judged(spark, root, 1))


def run_diff(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts that changed from run a to run b."""
    return guards.run_diff(_judged(spark, root, 0), _judged(spark, root, 1))


def run_totals(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts of both runs."""
    return guards.run_totals({"a": _judged(spark, root, 0), "b": _judged(spark, root, 1)})


def audit_sample(spark: SparkSession, root: str) -> DataFrame:
    """Rows of run b to read by hand."""
    return auditing.audit_sample(_judged(spark, root, 1), 60)


def refusals(spark: SparkSession, root: str) -> DataFrame:
    """Refusal tests of every answer."""
    a = F.coalesce(F.col("answer"), F.lit(""))
    return table(spark, root, "faq_export").select("faq_id", tx.refused(a).alias("refused"), tx.refused_cleanly(a).alias("clean"), tx.refusal_kind(a).alias("kind")).distinct()


def term_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of each candidate's terms per source type."""
    made = auditing.sweep(table(spark, root, "records"), "source_type", "text", list(CANDIDATES))
    return made.select("question", "source_type", "n", "rare_n", "common_terms")


def sweep_totals(spark: SparkSession, root: str) -> DataFrame:
    """Mentions per candidate."""
    return term_sweep(spark, root).groupBy("question").agg(F.sum("n").alias("n"), F.sum("rare_n").alias("rare_n"))


def passages(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of documents with the terms that hit them."""
    made = auditing.passages(table(spark, root, "documents"), "doc_id", "text", ["orange flag", "defibrillator", "medical card"])
    return made.select("doc_id", F.md5("passage").alias("passage"), "terms")


def claim_counts(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of claims per topic."""
    return auditing.claim_counts(table(spark, root, "records"), "topic", "text")


def claim_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Text around the mentions of claims in documents."""
    return auditing.claim_snippets(table(spark, root, "documents"), "doc_id", "text").select("doc_id", "claim", F.col("start").cast("long").alias("start"), F.md5("snippet").alias("snippet"))


def key_report(spark: SparkSession, root: str) -> DataFrame:
    """Whether stated keys can serve."""
    return auditing.key_report(table(spark, root, "records"), "text", KEYS)


def evidence_top3(spark: SparkSession, root: str) -> DataFrame:
    """The best evidence in documents for the evaluation passages, each taken whole."""
    items = table(spark, root, "eval_items").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    made = auditing.evidence(items, table(spark, root, "documents"), "qid", "answer", "doc_id", "text")
    return made.select("qid", F.col("place").cast("long").alias("place"), "doc_id", F.md5("sentence").alias("sentence"), "score")


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Questions per category, those of the table and stated ones that are empty."""
    return auditing.coverage(table(spark, root, "questions_public"), ["fees", "kit", "safety", "travel", "weather"])


def leak_window_hits(spark: SparkSession, root: str) -> DataFrame:
    """Windows of documents that stand in an evaluation passage."""
    made = verbatim.window_hits(table(spark, root, "documents"), table(spark, root, "eval_items"), "doc_id", "text", "item_id", "text")
    return made.select("doc_id", F.col("start").cast("long").alias("start"), "item_id")


def leak_by_doc(spark: SparkSession, root: str) -> DataFrame:
    """Hits per document."""
    return leak_window_hits(spark, root).groupBy("doc_id").agg(F.count("*").alias("hits"), F.countDistinct("item_id").alias("items"))


def leak_greedy_runs(spark: SparkSession, root: str) -> DataFrame:
    """Maximal verbatim runs."""
    made = verbatim.greedy_runs(table(spark, root, "documents"), table(spark, root, "eval_items"), "doc_id", "text", "item_id", "text")
    return made.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "run")


def secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Secrets in the texts of all documents, records and answers, and in notes of customers with made-up contacts."""
    k = F.col("c_custkey")
    note = F.when(k % 5 == 0, F.concat(F.lit("mail c"), k.cast("string"), F.lit("@example.org"))).when(k % 7 == 0, F.concat(F.lit("call (555) 010-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 11 == 0, F.concat(F.lit("sk-"), F.md5(k.cast("string")))).otherwise(F.col("c_name"))
    texts = table(spark, root, "customer").select(F.concat(F.lit("customer-"), k.cast("string")).alias("id"), note.alias("text"))
    for name, key, column in (("documents", "doc_id", "text"), ("records", "doc_id", "text"), ("faq_export", "faq_id", "answer")):
        texts = texts.unionByName(table(spark, root, name).select(F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("id"), F.col(column).alias("text")))
    return verbatim.secret_scan(texts, "id", "text")


def denied_paths(spark: SparkSession, root: str) -> DataFrame:
    """Source files that a rule keeps back."""
    files = table(spark, root, "records").select("source_file").distinct()
    return verbatim.denied_paths(files, "source_file", RULES)


def chat_trim(spark: SparkSession, root: str) -> DataFrame:
    """Chats cut to a budget (orders play the chats, their lines the messages)."""
    messages = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").alias("_n"), F.floor(F.col("l_extendedprice").cast("double") / 100).cast("long").alias("tokens"))
    first = messages.groupBy("conv_id", "_n").agg(F.sum("tokens").alias("tokens"))
    dense = first.select("conv_id", (F.col("_n") - 1).cast("long").alias("turn"), "tokens")
    return runs.trim_chats(dense, 900)


def latency_summary(spark: SparkSession, root: str) -> DataFrame:
    """Latency and cost per task (events play the calls)."""
    calls = table(spark, root, "events")
    size = F.length("props").cast("long")
    return runs.latency_summary(calls, "event_type", "value", size, F.pmod("user_id", F.lit(50)).cast("long"), F.pmod("event_id", F.lit(13)) != 0)


def model_scorecard(spark: SparkSession, root: str) -> DataFrame:
    """Scorecard per model (events play the cases)."""
    kind = F.when(F.pmod("event_id", F.lit(3)) == 0, "refusal").otherwise("grounded")
    cases = table(spark, root, "events").select(F.col("event_type").alias("model"), kind.alias("kind"), (F.pmod("user_id", F.lit(4)) != 0).alias("ok"), F.col("value").alias("seconds"), F.pmod("user_id", F.lit(9)).cast("double").alias("tok_s"))
    return runs.scorecard(cases)


def label_compliance(spark: SparkSession, root: str) -> DataFrame:
    """Whether event types are allowed labels."""
    ok = tx.label_complies(F.concat(F.lit(" "), F.upper("event_type"), F.lit(". ")), ("click", "view"))
    return table(spark, root, "events").groupBy("event_type").agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


def repeat_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Unordered pairs of answers per question."""
    return runs.pair_counts(table(spark, root, "faq_export").select("question", "answer"), ["question"])


def stub_sweep(spark: SparkSession, root: str) -> DataFrame:
    """A grid of prompts, temperatures and seeds over the stand-in client."""
    prompts = table(spark, root, "eval_items").select(F.col("text").alias("prompt"))
    calls = models.grid(prompts, "prompt", (0.0, 0.3, 0.6, 0.9, 1.2), tuple(range(100, 106)))
    said = models.call_model(calls, "call_id", F.col("prompt"), models.StubClient(), "stub", F.col("temperature"), F.col("seed"))
    return runs.repeat_stats(calls.join(said, "call_id"), ["prompt", "temperature"], "answer")


def judge_pipeline_stub(spark: SparkSession, root: str) -> DataFrame:
    """Gate, answer and judge over the stand-in client."""
    asked = answers(spark, root, 1).select("qid", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("context", F.lit("")).alias("context"))
    return models.judge_pipeline(asked, models.StubClient(), "answerer", "judge", "gate")


def sampled_records(spark: SparkSession, root: str) -> DataFrame:
    """Records sampled with a seed for review."""
    return seeded_sample(table(spark, root, "records").select("doc_id").distinct(), "doc_id", 40, 7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        grounding, bad_numbers, best_sentence, relevance, guard_reason, guard_histogram, verdict_parse, outcome_matrix, gate_confusion,
        run_diff, run_totals, audit_sample, refusals, term_sweep, sweep_totals, passages, claim_counts, claim_snippets, key_report,
        evidence_top3, coverage, leak_window_hits, leak_by_doc, leak_greedy_runs, secret_scan, denied_paths, chat_trim, latency_summary,
        model_scorecard, label_compliance, repeat_pairs, stub_sweep, judge_pipeline_stub, sampled_records,
    )
}


_WS = r"\s\p{Z}\x0B\x1C-\x1F\x{85}"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _guard(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9$]+'), lambda t: length(t) >= 3 AND t NOT IN ({_list(tx.STOP_GUARD)}))"


def _all(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9$]+')"


def _nums(c: str) -> str:
    found = f"regexp_extract_all(coalesce({c}, ''), '{tx.NUMBER}')"
    return f"list_transform({found}, lambda x: replace(lower(regexp_replace(trim(x), '^[.,;:]+|[.,;:]+$', '', 'g')), ',', ''))"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"


def _squash(c: str) -> str:
    return f"lower(regexp_replace({c}, '[{_WS}]+', '', 'g'))"


def _sentences(c: str) -> str:
    return f"regexp_split_to_array(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n')"


def _answers_sql(step: int, name: str) -> str:
    return f"""{name} AS (SELECT f.faq_id AS qid, question, answer, t.text AS context, CASE WHEN length(trim(coalesce(answer, ''))) >= 20 THEN 'answerable' ELSE 'refuse' END AS expect,
  contains({_squash("coalesce(t.text, '')")}, {_squash("coalesce(answer, '')")})::INT AS retrieved
  FROM (SELECT DISTINCT faq_id, question, answer FROM faq_export) f LEFT JOIN cur t ON t.doc_id = 'faq-F' || lpad((substr(faq_id, 2)::BIGINT + {step})::VARCHAR, 7, '0'))"""


def _guarded_sql(source: str, name: str) -> str:
    return f"""
{name}_g AS (SELECT *, {_guard('answer')} AS said, {_all('context')} AS known, list_filter({_nums('answer')}, lambda x: x <> '' AND NOT contains(replace(lower({_flat("coalesce(context, '')")}), ',', ''), x)) AS bad,
  list_distinct({_all('answer')}) AS aw, list_distinct({_nums('answer')}) AS figs FROM {source}),
{name}_s AS (SELECT qid, aw, figs, pos, trim(s) AS s FROM (SELECT qid, aw, figs, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS s FROM (SELECT qid, aw, figs, {_sentences("coalesce(context, '')")} AS l FROM {name}_g)) WHERE length(trim(s)) >= 25),
{name}_q AS (SELECT qid, s, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS nth FROM (SELECT *,
  round(len(list_intersect(aw, own)) / sqrt(greatest(len(own), 1)) * CASE WHEN len(figs) > 0 THEN 1 + 2 * len(list_intersect(figs, list_distinct({_nums('s')})))::DOUBLE / len(figs) ELSE 1 END, 9) AS score
  FROM (SELECT *, list_distinct({_all('s')}) AS own FROM {name}_s)) WHERE score > 0),
{name}_b AS (SELECT g.*, CASE WHEN len(said) = 0 THEN 1 ELSE 1 - len(list_filter(said, lambda t: NOT list_contains(known, t)))::DOUBLE / len(said) END AS grounding, coalesce(substr(s, 1, 340), '') AS quote
  FROM {name}_g g LEFT JOIN {name}_q q ON q.qid = g.qid AND nth = 1),
{name}_r AS (SELECT qid, sum(CASE WHEN list_contains(has, CASE WHEN length(term) > 4 THEN regexp_replace(term, 's$', '') ELSE term END) THEN coalesce(idf, 1.0::DOUBLE) ELSE 0 END) / sum(coalesce(idf, 1.0::DOUBLE)) AS relevance
  FROM (SELECT qid, list_transform({_all('quote')}, lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t END) AS has, unnest({_guard('question')}) AS term FROM {name}_b) LEFT JOIN idf USING (term) GROUP BY qid),
{name} AS (SELECT *, CASE WHEN len(bad) > 0 THEN 'numbers' WHEN grounding < 0.8 THEN 'grounding' WHEN quote = '' OR support < 0.3 THEN 'no source' WHEN relevance < 0.55 THEN 'relevance' ELSE '' END AS reason
  FROM (SELECT b.*, coalesce(relevance, 1) AS relevance, len(list_intersect(list_distinct(said), {_guard('quote')}))::DOUBLE / greatest(len(list_distinct(said)), 1) AS support FROM {name}_b b LEFT JOIN {name}_r USING (qid)))"""


_BLANK = f"NOT coalesce(regexp_matches(answer, '[^{_WS}]'), false)"
_KIND_T = f"regexp_replace(lower({_flat('answer')}), '^[ .\"]+|[ .\"]+$', '', 'g')"
_KIND = f"CASE WHEN contains({_KIND_T}, '{tx.REFUSAL_CORE}') AND length({_KIND_T}) <= 90 THEN CASE WHEN contains({_KIND_T}, 'not {tx.REFUSAL_CORE}') THEN 'clean' ELSE 'corrupt' END END"


def _judged_sql(source: str, name: str) -> str:
    return f"""
{name} AS (SELECT qid, expect, retrieved, CASE WHEN {_BLANK} OR {_KIND} IS NOT NULL OR reason = 'numbers' THEN 'REFUSED' WHEN grounding >= 0.5 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict,
  CASE WHEN {_BLANK} THEN 'UNPARSED' WHEN relevance >= 0.3 THEN 'COVERED' ELSE 'MISSING' END AS gate, {_KIND} AS refusal, reason FROM {source})"""


_G0 = f"""WITH cur AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, text DESC) AS nth FROM records) WHERE nth = 1),
qs AS (SELECT DISTINCT question FROM faq_export), idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM qs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM (SELECT unnest(list_distinct({_guard('question')})) AS term FROM qs) GROUP BY term),
{_answers_sql(1, 'ab')}, {_guarded_sql('ab', 'gb')}, {_judged_sql('gb', 'jb')}, {_answers_sql(0, 'aa')}, {_guarded_sql('aa', 'ga')}, {_judged_sql('ga', 'ja')}
"""
_GOOD = "((expect = 'answerable' AND {0}.verdict = 'SUPPORTED') OR (expect = 'refuse' AND {0}.verdict = 'REFUSED'))"


def _count_word(text: str, term: str) -> str:
    """Whole-word count without lookaround: separators are doubled so that neighbours do not share one."""
    edge = "[^\\p{L}\\p{N}_]"
    tail = "(?:e?s)?" if term.isalpha() and len(term) > 3 else ""
    body = term.replace(" ", "\\s+")
    doubled = f"regexp_replace({text}, '({edge})', '\\1\\1', 'g')"
    body = term.replace(" ", "\\s+")
    return f"len(regexp_extract_all({doubled}, '(?i)(?:^|{edge}){body}{tail}(?:$|{edge})'))"


_TERMS = sorted({t for _, ts in CANDIDATES for t in ts})
_ASKED = " UNION ALL ".join(f"SELECT '{q}' AS question, '{t}' AS term" for q, ts in CANDIDATES for t in ts)
_SWEEP = f"""WITH asked AS ({_ASKED}),
per AS ({" UNION ALL ".join(f"SELECT source_type, '{t}' AS term, sum({_count_word('text', t)})::BIGINT AS n FROM records GROUP BY source_type" for t in _TERMS)}),
tot AS (SELECT term, sum(n) AS total FROM per GROUP BY term),
found AS (SELECT question, source_type, sum(n)::BIGINT AS n, sum(CASE WHEN total <= 40 THEN n ELSE 0 END)::BIGINT AS rare_n, array_to_string(list_sort(coalesce(list(DISTINCT term) FILTER (total > 40), [])), ',') AS common_terms
  FROM asked JOIN tot USING (term) JOIN per USING (term) WHERE n > 0 GROUP BY ALL),
swept AS (SELECT * FROM found UNION ALL SELECT DISTINCT question, NULL, 0::BIGINT, 0::BIGINT, '' FROM asked WHERE question NOT IN (SELECT question FROM found))
"""
_CLAIMS = " UNION ALL ".join(f"SELECT '{c}' AS claim, '{t}' AS term, {i} AS place" for c, ts in auditing.CLAIMS.items() for i, t in enumerate(ts))
_PASS_TERMS = ["defibrillator", "medical card", "orange flag"]
_HITS = "list_filter([" + ", ".join(f"CASE WHEN {_count_word('s', t)} > 0 THEN '{t}' END" for t in _PASS_TERMS) + "], lambda t: t IS NOT NULL)"
_WINDOWS = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9$][A-Za-z0-9$''/.-]*') AS w FROM documents),
each AS (SELECT doc_id, i AS start, regexp_replace(lower(array_to_string(w[i + 1:i + 8], ' ')), '[^a-z0-9]+', '', 'g') AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM w)),
ref AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ref FROM eval_items),
hits AS (SELECT DISTINCT doc_id, start, item_id FROM each JOIN ref ON contains(ref, win) WHERE length(win) >= 40)
"""
_REFUSED = " OR ".join(f"contains(lower(coalesce(answer, '')), '{p}')" for p in tx.REFUSAL_PHRASES)

ORACLES: dict[str, str] = {
    "grounding": _G0 + "SELECT qid, round(grounding, 6)::DOUBLE AS grounding FROM gb",
    "bad_numbers": _G0 + "SELECT qid, array_to_string(bad, ',') AS numbers FROM gb",
    "best_sentence": _G0 + "SELECT qid, quote FROM gb",
    "relevance": _G0 + "SELECT qid, round(relevance, 6)::DOUBLE AS relevance, round(support, 6)::DOUBLE AS support FROM gb",
    "guard_reason": _G0 + "SELECT qid, reason FROM gb",
    "guard_histogram": _G0 + "SELECT reason, count(*) AS n FROM gb WHERE reason <> '' GROUP BY 1",
    "verdict_parse": _G0 + "SELECT qid, verdict, gate FROM jb",
    "outcome_matrix": _G0
    + """SELECT count_if(expect = 'refuse' AND verdict = 'REFUSED')::BIGINT AS correct_refusals, count_if(expect = 'refuse')::BIGINT AS must_refuse, count_if(expect = 'answerable' AND verdict = 'SUPPORTED')::BIGINT AS grounded,
  count_if(expect = 'answerable')::BIGINT AS answerable, count_if(verdict = 'UNSUPPORTED')::BIGINT AS invented, count_if(expect = 'refuse' AND verdict = 'UNSUPPORTED')::BIGINT AS invented_on_refuse,
  count_if(expect = 'answerable' AND verdict = 'REFUSED' AND retrieved = 1)::BIGINT AS over_refused, count_if(coalesce(refusal, '') = 'corrupt')::BIGINT AS mangled, count_if(reason <> '')::BIGINT AS held FROM jb""",
    "gate_confusion": _G0
    + """SELECT CASE WHEN expect = 'answerable' AND retrieved = 1 THEN 'COVERED' ELSE 'MISSING' END AS truth, count_if(gate = 'COVERED')::BIGINT AS covered, count_if(gate = 'MISSING')::BIGINT AS missing,
  count_if(gate = 'UNPARSED')::BIGINT AS unparsed FROM jb GROUP BY 1""",
    "run_diff": _G0
    + f"""SELECT coalesce(ja.qid, jb.qid) AS qid, ja.verdict AS verdict_a, jb.verdict AS verdict_b, CASE WHEN jb.verdict IS NULL THEN 'only a' WHEN ja.verdict IS NULL THEN 'only b'
  WHEN {_GOOD.format('jb').replace('expect', 'jb.expect')} AND NOT {_GOOD.format('ja').replace('expect', 'ja.expect')} THEN 'FIXED'
  WHEN {_GOOD.format('ja').replace('expect', 'ja.expect')} AND NOT {_GOOD.format('jb').replace('expect', 'jb.expect')} THEN 'BROKE' ELSE 'sideways' END AS change
FROM ja FULL JOIN jb ON ja.qid = jb.qid WHERE ja.verdict IS DISTINCT FROM jb.verdict""",
    "run_totals": _G0 + "SELECT run, verdict, count(*) AS n FROM (SELECT 'a' AS run, verdict FROM ja UNION ALL SELECT 'b', verdict FROM jb) GROUP BY ALL",
    "audit_sample": _G0
    + """, ruled AS (SELECT qid, CASE WHEN expect = 'refuse' AND verdict = 'SUPPORTED' THEN 0 WHEN verdict = 'UNSUPPORTED' THEN 1 ELSE 2 END AS p FROM jb WHERE verdict IN ('SUPPORTED', 'UNSUPPORTED') AND refusal IS NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY p, qid) AS n, count_if(p < 2) OVER () AS head, count_if(p = 2) OVER () AS rest FROM ruled),
cut AS (SELECT *, greatest(0, 60 - head) AS want, n - head - 1 AS nth FROM placed),
cut2 AS (SELECT *, CASE WHEN want > 0 THEN greatest(1, rest // want) ELSE 1 END AS step FROM cut)
SELECT qid, (CASE WHEN p < 2 THEN n ELSE head + nth // step + 1 END)::BIGINT AS place FROM cut2 WHERE (p < 2 AND n <= 60) OR (p = 2 AND nth % step = 0 AND nth // step < want)""",
    "refusals": f"SELECT DISTINCT faq_id, {_REFUSED} AS refused, ({_REFUSED}) AND NOT regexp_matches(coalesce(answer, ''), '[£$€]\\s?\\d') AS clean, {_KIND.replace('answer', "coalesce(answer, '')")} AS kind FROM faq_export",
    "term_sweep": _SWEEP + "SELECT question, source_type, n, rare_n, common_terms FROM swept",
    "sweep_totals": _SWEEP + "SELECT question, sum(n)::BIGINT AS n, sum(rare_n)::BIGINT AS rare_n FROM swept GROUP BY 1",
    "passages": f"""WITH cut AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace({_flat('text')}, '([.!?])\\s+|\\s+•\\s*', '\\1' || chr(1), 'g'), chr(1))) AS raw FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, {_flat('raw')} AS s FROM cut), hit AS (SELECT doc_id, s, {_HITS} AS terms FROM s WHERE s <> '' AND NOT regexp_matches(s, '\\.{{6,}}')),
b AS (SELECT *, greatest(1, list_min(list_filter(list_transform(terms, lambda t: instr(lower(s), t)), lambda p: p > 0)) - 173) AS b FROM hit WHERE len(terms) > 0)
SELECT doc_id, md5(CASE WHEN length(s) > 520 THEN CASE WHEN b > 1 THEN '… ' ELSE '' END || substr(s, b, 520) || ' …' ELSE s END) AS passage, array_to_string(terms, ',') AS terms FROM b""",
    "claim_counts": f"""WITH c AS ({_CLAIMS}), per AS (SELECT claim, topic, term, place, sum((length(t) - length(replace(t, term, ''))) // length(term))::BIGINT AS n FROM (SELECT topic, lower(coalesce(text, '')) AS t FROM records) JOIN c ON contains(t, term) GROUP BY ALL)
SELECT claim, topic, sum(n)::BIGINT AS n, arg_max(term, n * 100 - place) AS best_term FROM per GROUP BY ALL""",
    "claim_snippets": f"""WITH c AS ({_CLAIMS}), d AS (SELECT doc_id, {_flat("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, claim, term, t, string_split(lower(t), term) AS l FROM d JOIN c ON contains(lower(t), term)),
e AS (SELECT doc_id, claim, t, length(term) AS n, unnest(list_transform(range(1, len(l)), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + length(term))) - length(term))) AS start FROM p),
s AS (SELECT doc_id, claim, start, substr(t, (greatest(0, start - 230) + 1)::BIGINT, (start + n + 230 - greatest(0, start - 230))::BIGINT) AS s FROM e)
SELECT doc_id, claim, min(start)::BIGINT AS start, md5(arg_min(s, start)) AS snippet FROM s WHERE NOT regexp_matches(s, '\\.{{6,}}') GROUP BY doc_id, claim, substr(s, 1, 50)""",
    "key_report": "SELECT key, hits, CASE WHEN hits = 0 THEN 'MISSING' WHEN len(string_split(key, ' ')) < 2 AND length(key) < 6 AND NOT regexp_matches(key, '[0-9$£€]') THEN 'too vague' WHEN hits > 15 THEN 'too common' ELSE 'ok' END AS verdict FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS key, sum((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{k.lower()}', ''))) // {len(k)})::BIGINT AS hits FROM records" for k in KEYS)
    + ")",
    "evidence_top3": f"""WITH a AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: length(t) >= 3 AND t NOT IN ({_list(tx.STOP_AUDIT)})))) AS w FROM eval_items),
c AS (SELECT doc_id, pos, trim(s) AS s FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS s FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)) WHERE length(trim(s)) > 25),
o AS (SELECT doc_id, pos, s, list_distinct(regexp_extract_all(lower(s), '[a-z0-9$]+')) AS own FROM c),
h AS (SELECT qid, doc_id, pos, s, round(count(*) / pow(len(own), 0.4), 6) AS score FROM (SELECT *, unnest(own) AS w FROM o) JOIN a USING (w) GROUP BY qid, doc_id, pos, s, own HAVING count(*) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, substr(s, 1, 40) ORDER BY score DESC, doc_id, pos) AS nth FROM h)
SELECT qid, place, doc_id, md5(s) AS sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, pos) AS place FROM b WHERE nth = 1) WHERE place <= 3""",
    "coverage": """WITH dim AS (SELECT unnest(['fees', 'kit', 'safety', 'travel', 'weather']) AS category)
SELECT category, coalesce(n, 0) AS n, coalesce(refuse, 0)::BIGINT AS refuse, NULL::BOOLEAN AS enough FROM dim FULL JOIN (SELECT category, count(*) AS n, count_if(expect = 'refuse') AS refuse FROM questions_public GROUP BY 1) USING (category)
UNION ALL SELECT 'total', count(*), count_if(expect = 'refuse')::BIGINT, count(*) >= 25 AND count_if(expect = 'refuse') >= 5 FROM questions_public""",
    "leak_window_hits": _WINDOWS + "SELECT doc_id, start, item_id FROM hits",
    "leak_by_doc": _WINDOWS + "SELECT doc_id, count(*) AS hits, count(DISTINCT item_id) AS items FROM hits GROUP BY 1",
    "leak_greedy_runs": _WINDOWS.replace("WITH w AS", "WITH RECURSIVE w AS")
    + """, longest AS (SELECT doc_id, start, max(stop) AS stop FROM (SELECT h.doc_id, h.start, unnest(range(h.start + 8, len(w.w) + 1)) AS stop, w.w, ref.ref FROM hits h JOIN w USING (doc_id) JOIN ref USING (item_id))
  WHERE contains(ref, regexp_replace(lower(array_to_string(w[start + 1:stop], ' ')), '[^a-z0-9]+', '', 'g')) GROUP BY doc_id, start),
linked AS (SELECT l.*, (SELECT min(n.start) FROM longest n WHERE n.doc_id = l.doc_id AND n.start >= l.stop) AS next FROM longest l),
walk AS (SELECT linked.* FROM linked JOIN (SELECT doc_id, min(start) AS start FROM longest GROUP BY doc_id) USING (doc_id, start)
  UNION ALL SELECT n.* FROM walk JOIN linked n ON n.doc_id = walk.doc_id AND n.start = walk.next)
SELECT doc_id, start, stop, array_to_string(w[start + 1:stop], ' ') AS run FROM walk JOIN w USING (doc_id)""",
    "secret_scan": r"""WITH n AS (SELECT 'customer-' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'mail c' || c_custkey || '@example.org' WHEN c_custkey % 7 = 0 THEN 'call (555) 010-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
  WHEN c_custkey % 11 = 0 THEN 'sk-' || md5(c_custkey::VARCHAR) ELSE c_name END AS note FROM customer
  UNION ALL SELECT 'documents-' || doc_id, text FROM documents UNION ALL SELECT 'records-' || doc_id, text FROM records UNION ALL SELECT 'faq_export-' || faq_id, answer FROM faq_export),
f AS (SELECT id, coalesce(regexp_matches(note, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(com|org|net|edu|io)'), false) AS email, coalesce(regexp_matches(note, '\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}'), false) AS phone,
  coalesce(regexp_matches(note, '-----BEGIN [A-Z ]*PRIVATE KEY'), false) AS private_key, coalesce(regexp_matches(note, '(sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})'), false) AS token FROM n)
SELECT * FROM f WHERE email OR phone OR private_key OR token""",
    "denied_paths": "SELECT source_file, rule FROM (SELECT DISTINCT source_file FROM records) JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{p}' AS pat" for n, p in RULES.items()) + ") ON regexp_matches(source_file, pat)",
    "chat_trim": """WITH m AS (SELECT l_orderkey AS conv_id, (l_linenumber - 1)::BIGINT AS turn, sum(floor(l_extendedprice::DOUBLE / 100)::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS run, sum(tokens) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS len FROM m),
f AS (SELECT *, max(CASE WHEN turn = 0 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS first FROM r),
d AS (SELECT conv_id, min(turn // 2) AS m FROM f WHERE turn % 2 = 0 AND (total - (run - first) <= 900 OR len - 2 * (turn // 2) <= 3) GROUP BY 1)
SELECT f.conv_id, turn, tokens FROM f LEFT JOIN d USING (conv_id) WHERE turn = 0 OR turn > 2 * coalesce(m, 0)""",
    "latency_summary": """WITH e AS (SELECT event_type, value AS s, length(props) AS i, user_id % 50 AS o, event_id % 13 <> 0 AS ok FROM events),
a AS (SELECT event_type, count(*) AS calls, round(median(s), 2) AS median_s, round(list_sort(list(s))[round_even(0.95::DOUBLE * (count(s) - 1), 0)::BIGINT + 1], 2) AS p95_s, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(s) AS total,
  count_if(NOT ok)::BIGINT AS failures FROM e GROUP BY 1)
SELECT event_type, calls, median_s, p95_s, tokens_in, tokens_out, CASE WHEN total > 0 THEN round(tokens_out / total, 1) ELSE 0.0 END::DOUBLE AS tok_s, failures, round(tokens_in / 1e6::DOUBLE * 3.0 * (1000 / calls), 4)::DOUBLE AS per_1k_usd FROM a""",
    "model_scorecard": """WITH e AS (SELECT event_type AS model, event_id % 3 = 0 AS r, user_id % 4 <> 0 AS ok, value AS s, user_id % 9 AS t FROM events)
SELECT model, count_if(NOT r AND ok) || '/' || count_if(NOT r) AS grounded, count_if(r AND ok) || '/' || count_if(r) AS refusal, round(median(s), 2) AS median_s, round(median(t) FILTER (t > 0), 1) AS tok_s FROM e GROUP BY 1""",
    "label_compliance": "SELECT event_type, (CASE WHEN lower(event_type) IN ('click', 'view') THEN count(*) ELSE 0 END)::BIGINT AS ok, count(*) AS n FROM events GROUP BY 1",
    "sampled_records": "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM records) ORDER BY md5(doc_id || '|7'), doc_id LIMIT 40)",
    "repeat_pairs": "SELECT question, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM faq_export GROUP BY 1",
}
