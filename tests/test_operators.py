import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import auditing, costs, evaluation, guards, keys, models, quantiles, ranking, records, runs, segments, verbatim
from corpuslab.operators.skew import current_rows, join_hot_cold, join_unique


def test_bm25_against_formula(spark):
    docs = {1: "red flag red", 2: "flag at the gate", 3: "", 4: None, 5: "boat"}
    index = ranking.TermIndex(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, "red flag red"), (2, "nothing here"), (3, None)], "qid long, query string"))
    got = {(r.qid, r.doc_id): r.score for r in index.bm25().collect()}
    n, lens = 5, {1: 3, 2: 2, 3: 0, 4: 0, 5: 1}
    avg = sum(lens.values()) / n

    def part(f, df, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / max(avg, 1)))

    assert got == pytest.approx({(1, 1): 2 * part(2, 1, 3) + part(1, 2, 3), (1, 2): part(1, 2, 2)})
    top = ranking.top_k(index.padded(index.bm25(), 3), 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id) for r in top] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_ties_follow_the_policy(spark):
    scores = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0000000001), (1, 9, 1.0)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in ranking.top_k(scores, 2).orderBy("rank").collect()] == [3, 5]
    assert [r.doc_id for r in ranking.top_k(scores, 2, lower_first=False).orderBy("rank").collect()] == [9, 5]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "qid long, doc_id long, rank int")
    got = ranking.fused_top_k(ranking.reciprocal_rank_fusion(a, b), 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [10, 12, 11]
    assert all(r.score <= 2 / 61 for r in got)


def test_knn_in_blocks_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.qid, r.rank): r.vec_id for r in ranking.knn(v, v.filter("vec_id % 10 = 0"), 3, query_block=2, chunk=7).collect()}

    def cos(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb), 5) if na and nb else 0.0

    for q, u in rows[:61:10]:
        want = sorted(((cos(u, w), i) for i, w in rows[:61] if i != q), reverse=True)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in want]


def test_containment_pairs_equal_product(spark):
    rng = random.Random(2)
    text = ["".join(rng.choice("ab") for _ in range(120)) for _ in range(8)]
    needles = [t[i : i + n] for t in text[:4] for i, n in ((0, 31), (17, 40), (50, 5), (3, 60))]
    docs = spark.createDataFrame(list(enumerate(text)), "d long, hay string")
    asked = spark.createDataFrame(list(enumerate(needles)), "k long, needle string")
    got = {(r.d, r.k) for r in ranking.containment_pairs(docs, asked, "hay", "needle").collect()}
    assert got == {(d, k) for d, t in enumerate(text) for k, n in enumerate(needles) if n in t}


def test_evaluation_labels(spark):
    questions = spark.createDataFrame([(1, "c", "q", "flagx", "s", "answerable"), (2, "c", "q", "none", None, "refuse"), (3, "c", "q", "abcd", "s", "answerable")], "qid long, category string, query string, key string, document string, expect string")
    docs = spark.createDataFrame([(1, "the Flag X", "s"), (2, "ab", "t"), (3, "cd", "t")], "doc_id long, text string, source string")
    ranked = spark.createDataFrame([(1, 2, 3.0, 1), (1, 1, 2.0, 2), (2, 2, 1.0, 1), (3, 2, 5.0, 1), (3, 3, 4.0, 2)], "qid long, doc_id long, score double, rank int")
    rows = evaluation.evaluation_rows(questions, ranked, docs)
    got = {r.qid: (r.hit, r.union, r.refused, r.winner, r.status) for r in rows.collect()}
    assert got == {1: (1, 1, None, "s", "hit"), 2: (None, None, 1, None, "GONE"), 3: (0, 1, None, None, "MISS")}
    s = evaluation.evaluation_summary(rows).collect()[0]
    assert (s.hits, s.unions, s.hit_percent, s.lost_in_ranking, s.lost_in_corpus) == (1, 2, 50, 1, 1)
    sep = evaluation.separability(rows).collect()[0]
    assert (sep.worst_leak, sep.weakest_hit, sep.separates) == (1.0, 3.0, True)
    assert evaluation.weighted_hits(rows, spark.createDataFrame([("c", 2.0)], "category string, weight double")).collect()[0][0] == 2.0


def test_current_rows_and_joins(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("a", "2", "z"), (None, "3", "w"), ("b", None, "v")], "doc_id string, loaded_at string, text string")
    got = {r.key: r.text for r in current_rows(rows, F.col("doc_id"), ["text"]).collect()}
    assert got == {"a": "z", "b": "v"}
    big = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    facts = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("f"))
    assert join_unique(big, facts, "k", 120_000).agg(F.sum("f"), F.count("*")).collect() == big.join(facts, "k").agg(F.sum("f"), F.count("*")).collect()
    assert join_unique(big, facts, "k", 120_000, "left").count() == 120_000
    assert join_hot_cold(big, facts, "k", F.col("k") < 10).count() == big.join(facts, "k").count()


def test_order_statistics(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, 50))) for g in "ab" for _ in range(rng.randint(50, 400))] + [("c", 5.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in quantiles.median_of(df, ["g"], "v").collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert got == {g: statistics.median(v) for g, v in by.items()}
    whole = quantiles.median_of(df, [], "v").collect()[0].median
    assert whole == statistics.median([v for _, v in rows if v is not None])


def test_numbered(spark):
    names = [f"k{i:04d}" for i in range(1000)]
    shuffled = names[:]
    random.Random(4).shuffle(shuffled)
    df = spark.createDataFrame([(n,) for n in shuffled], "k string")
    assert [r.k for r in quantiles.numbered(df, "k", "n", 16).orderBy("n").collect()] == names
    assert quantiles.numbered(df.limit(0), "k", "n").count() == 0


def test_record_checks(spark):
    rows = [("a", "f", "t", "T", "text", "", 1), ("a", "f", "t", "T", "other", "", 2), ("b", "f", "t", "", " ", "", 1), ("c", "f", "t", "same ", " same", "", 1), ("b", "f", "t", "T", "x", "", 2), (None, "f", "t", None, None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id string, source_file string, source_type string, title string, text string, updated string, n int")
    got = sorted((r.doc_id or "", r.n, tuple(r.problems)) for r in records.checked(df, "n").collect())
    assert got == [("", 1, ("empty text", "empty title")), ("a", 1, ()), ("a", 2, ("duplicate doc_id",)), ("b", 1, ("empty text", "empty title")), ("b", 2, ("duplicate doc_id",)), ("c", 1, ("text adds nothing beyond the title",))]


def test_fee_tables(spark):
    text = "Fees. Age group Season fee Instalment Kit included U8 – U9 £120.50 £30 x 4 Yes U10–U11 £150 £37.5 x 4 Training top only Pay early."
    df = spark.createDataFrame([("p1", "f", "policy", "Fees", text, ""), ("p2", "f", "policy", "Other", "no table", "")], "doc_id string, source_file string, source_type string, title string, text string, updated string")
    got = {r.doc_id: (r.title, r.text) for r in records.split_fee_tables(df).collect()}
    assert got == {
        "p1": ("Fees", "Fees. Pay early."), "p2": ("Other", "no table"),
        "p1-u8-u9": ("U8 – U9 season fee", "U8 – U9: season fee £120.50, or 4 instalments of £30. Kit included: Yes."),
        "p1-u10-u11": ("U10–U11 season fee", "U10–U11: season fee £150, or 4 instalments of £37.5. Kit included: Training top only."),
    }


def test_decisions_and_samples(spark):
    q = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "qid string, key string")
    d = spark.createDataFrame([("q1", "fix", "A", "r"), ("q2", "delete", None, None)], "qid string, action string, new_key string, reason string")
    assert sorted(tuple(r) for r in records.apply_decisions(q, d).collect()) == [("q1", "A"), ("q3", "c")]
    s = records.seeded_sample(q, "qid", 2, 1)
    assert s.collect() == records.seeded_sample(q.repartition(3), "qid", 2, 1).collect() and s.count() == 2


def test_unique_dimension(spark):
    with pytest.raises(ValueError, match="not unique"):
        costs.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_half_even_mean(spark):
    counts = spark.createDataFrame([("a", 108, 1, None), ("b", 109, 1, None), ("c", None, 3, None)], "doc_id string, subword long, word long, loaded_at timestamp_ntz")
    meta = spark.createDataFrame([("A", "x", None), ("b ", "x", None)], "doc_id string, source_type string, loaded_at timestamp_ntz")
    got = {r.source_type: (r.docs, r.tokens, r.mean_tokens, r.share) for r in costs.cost_by_source(counts, meta, 3).collect()}
    assert got == {"x": (2, 217, 108, 98.2), None: (1, 4, 4, 1.8)}


def test_heading_scores(spark):
    cases = [("", "", 0), ("12", "", -99), ("2.1 Kit rules", "", 6), ("SEASON FEES", "x" * 90, 8), ("Adult fee: £38", "", -8 + 2), ("The pitch is shut today.", "", -4), ("A) Rules", "", 7), ("SECTION IV Rules", "", 8), ("Notes:", "", 3)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "line string, nxt string")
    got = [r[0] for r in df.select(segments.line_score(F.col("line"), F.col("nxt"))).collect()]
    assert got[:4] == [c for _, _, c in cases][:4] and got[4] < 0 and got[5] == -4 and got[8] == 3


def sequential_sections(lines, heads, least):
    out = []
    for line, head in zip(lines, heads, strict=True):
        if head:
            out.append([line, []])
        elif out:
            out[-1][1].append(line)
    merged = []
    for title, body in ((t, " ".join(b)) for t, b in out):
        if body and len(body) < least and merged:
            merged[-1][1] = f"{merged[-1][1]} {title} {body}".strip()
        else:
            merged.append([title, body])
    return merged


def test_sections_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    docs = []
    for d in range(30):
        docs.append((d, "\n".join(rng.choice(["SOME HEADING HERE", "short", "a longer line of ordinary prose that goes on and on.", ""]) for _ in range(12))))
    docs += [(98, None), (99, "")]
    lines = segments.lines_of(spark.createDataFrame(docs, "d long, t string"), "d", "t")
    got = {}
    for r in segments.sections(lines, "d").orderBy("d", "section_no").collect():
        got.setdefault(r.d, []).append([r.title, r.body])
    for d, text in docs:
        ls = [x for x in (text or "").split("\n")]
        want = sequential_sections([x for x in ls if x], [x == "SOME HEADING HERE" for x in ls if x], 40)
        assert got.get(d, []) == want


def packed_by_hand(body, most, target, overlap):
    """The same by strings: a part is closed when the next sentence does not fit."""
    out, part = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", body):
        if part and len(part) + len(sentence) >= target:
            out.append(part.strip())
            part = part[len(part) - min(overlap, len(part)) :] + " " + sentence
        else:
            part = (part + " " + sentence).strip()
    out = [x for x in [*out, part.strip()] if x]
    return out if len(body) > most and len(out) > 1 else [body]


def test_packing(spark):
    rng = random.Random(3)
    bodies = [" ".join("w" * rng.randint(1, 9) + rng.choice([".", "", "!", "? x"]) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["", "short", "x" * 3000, ". " * 400, "a.  b." * 90]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, body string")
    got = {r.i: r.p for r in df.select("i", segments.packed_sentences(F.col("body"), 60, 45, 12).alias("p")).collect()}
    assert got == {i: packed_by_hand(b, 60, 45, 12) for i, b in enumerate(bodies)}
    body = " ".join(f"Sentence number {i} is here." for i in range(100))
    rows = segments.split_long(spark.createDataFrame([(1, 1, "T", body), (1, 2, "S", "short"), (1, 3, "N", None)], "d long, section_no int, title string, body string"), "d").orderBy("section_no", "part_no").collect()
    assert [r.body for r in rows if r.section_no == 1] == packed_by_hand(body, 1200, 900, 160) and rows[0].title == f"T (1 of {len(rows) - 1})" and rows[-1].title == "S"


def test_respacing(spark):
    page = "The club opens\nThe  club has no payment.plan today\nRegistration forms are here\nThe club opens again"
    given = ["Theclub opens", "xx registrationforms.yy", "Theclubhasnopayment.plan xx", "theclubopens", None, " ", "nowhere at all", "e-mailaddressesof members"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(given)] + [(2, 0, "Noto page"), (3, 0, "Null page")], "p long, line_no int, line string")
    pages = spark.createDataFrame([(1, page), (3, None)], "p long, page string")
    got = {(r.p, r.line_no): r.line for r in segments.respace(lines, pages, "p").collect()}
    assert [got[1, i] for i in range(8)] == ["The club opens", "xx registrationforms.yy", "The club has no payment.plan xx", "The club opens", None, " ", "nowhere at all", "e-mailaddressesof members"]
    assert got[2, 0] == "Noto page" and got[3, 0] == "Null page"


def test_lines_from_runs(spark):
    runs_ = [(1, 10.0, 700.01, "World", 12.0, True, False), (1, 1.0, 700.02, "Hello", 12.0, True, False), (1, 1.0, 600.0, "body", 10.0, False, False), (2, 50.0, 1.0, "b", 9.0, False, True), (2, 40.0, 1.0, "a", 9.0, False, True)]
    df = spark.createDataFrame(runs_, "page int, across double, down double, text string, size double, bold boolean, rotated boolean")
    got = [(r.page, r.line, r.bold) for r in segments.lines_from_runs(df, "page").orderBy("page", "line_no").collect()]
    assert got == [(1, "Hello World", True), (1, "body", False), (2, "a", False), (2, "b", False)]


def test_guards(spark):
    rows = [("q1", "What is the levy?", "The levy is £38 for juniors.", "The levy is £38 for juniors and seniors, payable in March."), ("q2", "What is the levy?", "The levy is £99.", "The levy is £38."), ("q3", None, None, None), ("q4", "Who?", "", "x")]
    df = spark.createDataFrame(rows, "qid string, question string, answer string, context string")
    idf = spark.createDataFrame([("levy", 2.0)], "term string, idf double")
    got = {r.qid: (r.reason, round(r.grounding, 3), r.bad_numbers) for r in guards.guarded(df, idf, "qid", 10).collect()}
    assert got["q1"] == ("", 1.0, []) and got["q2"][0] == "numbers" and got["q2"][2] == ["£99"] or got["q2"][2] == ["99"]
    assert got["q3"][1] == 1.0 and got["q3"][0] == "no source"


def test_run_diff(spark):
    a = spark.createDataFrame([("1", "answerable", "REFUSED"), ("2", "answerable", "SUPPORTED"), ("3", "refuse", "SUPPORTED"), ("4", "refuse", "REFUSED"), ("5", "refuse", "REFUSED")], "qid string, expect string, verdict string")
    b = spark.createDataFrame([("1", "answerable", "SUPPORTED"), ("2", "answerable", "REFUSED"), ("3", "refuse", "UNSUPPORTED"), ("4", "refuse", "REFUSED"), ("6", "refuse", "REFUSED")], "qid string, expect string, verdict string")
    assert {r.qid: r.change for r in guards.run_diff(a, b).collect()} == {"1": "FIXED", "2": "BROKE", "3": "sideways", "5": "only a", "6": "only b"}


def test_candidates_and_sweep(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("Do you sell season tickets? | Season pass, ticket",), ("Who runs it?",)], "value string")
    got = {r.question: r.terms for r in auditing.parse_candidates(lines).collect()}
    assert got["Do you sell season tickets?"] == ["season pass", "ticket", "sell", "season", "tickets"]
    docs = spark.createDataFrame([("a", "tickets and a ticket"), ("b", "no"), ("b", None)], "club string, text string")
    s = auditing.sweep(docs, "club", "text", [("q1", ["ticket"]), ("q2", ["zebra"])])
    assert sorted((r.question, r.club, r.n, r.rare_n) for r in s.collect()) == [("q1", "a", 2, 2), ("q2", None, 0, 0)]
    conflicts = auditing.refuse_conflicts(s, spark.createDataFrame([("q1", "refuse"), ("q2", "refuse")], "question string, expect string"))
    assert [r.question for r in conflicts.collect()] == ["q1"]


def test_audit_sample_and_coverage(spark):
    rows = [(f"q{i:03d}", "answerable", "SUPPORTED", None) for i in range(40)] + [("z1", "refuse", "SUPPORTED", None), ("y1", "answerable", "UNSUPPORTED", None), ("x", "refuse", "REFUSED", None), ("w", "answerable", "SUPPORTED", "clean")]
    df = spark.createDataFrame(rows, "qid string, expect string, verdict string, refusal string")
    got = [r.qid for r in auditing.audit_sample(df, 10).orderBy("place").collect()]
    assert got == ["z1", "y1", *[f"q{i:03d}" for i in range(0, 40, 5)]]
    cov = auditing.coverage(df.withColumn("category", F.lit("kit")), ["kit", "fees"])
    assert {r.category: (r.n, r.enough) for r in cov.collect()} == {"kit": (44, None), "fees": (0, None), "total": (44, False)}
    ids = [r.qid for r in auditing.renumbered(df.withColumn("seq", F.col("qid")), "seq").orderBy("qid").collect()]
    assert ids[0] == "q01" and len(set(ids)) == 44


def test_verbatim(spark):
    ref_text = " ".join(f"word{i} alpha{i} beta{i}" for i in range(900))
    ref = spark.createDataFrame([(1, ref_text)], "item_id long, text string")
    quote = " ".join(ref_text.split()[30:60])
    docs = spark.createDataFrame([(1, f"intro words here {quote} and the end"), (2, "nothing to see in this one at all really"), (3, None), (4, "")], "doc_id long, text string")
    got = [(r.doc_id, r.run) for r in verbatim.greedy_runs(docs, ref, "doc_id", "text", "item_id", "text").collect()]
    assert got == [(1, quote)]
    assert verbatim.window_hits(docs, ref, "doc_id", "text", "item_id", "text").count() == 30 - 8 + 1
    with pytest.raises(ValueError, match="only"):
        verbatim.greedy_runs(docs, spark.createDataFrame([(1, "tiny")], "item_id long, text string"), "doc_id", "text", "item_id", "text")
    paths = spark.createDataFrame([("a/.env",), ("b.txt",)], "path string")
    assert [tuple(r) for r in verbatim.denied_paths(paths, "path", {"env": r"(^|/)\.env$"}).collect()] == [("a/.env", "env")]


def test_trimmed_chats_equal_the_loop(spark):
    rng = random.Random(6)
    chats = {c: [rng.randint(0, 40) for _ in range(rng.randint(1, 12))] for c in range(60)}
    df = spark.createDataFrame([(c, t, n) for c, ns in chats.items() for t, n in enumerate(ns)], "conv_id long, turn long, tokens long")
    got = {}
    for r in runs.trim_chats(df, 90).orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    for c, ns in chats.items():
        held = list(enumerate(ns))
        while sum(n for _, n in held) > 90 and len(held) > 3:
            del held[1:3]
        assert got[c] == [t for t, _ in held]
    spread = runs.running_totals(df, "conv_id", "turn", "tokens", "run", span=3)
    assert {(r.conv_id, r.turn): r.run for r in spread.collect()} == {(c, t): sum(ns[: t + 1]) for c, ns in chats.items() for t in range(len(ns))}


def test_repeats_and_models(spark):
    client = models.StubClient()
    prompts = spark.createDataFrame([("one two three four five six seven eight nine ten",), ("a b",)], "prompt string")
    calls = models.grid(prompts, "prompt", (0.0, 1.0), (1, 2, 3))
    said = models.call_model(calls, "call_id", F.col("prompt"), client, "m", F.col("temperature"), F.col("seed"))
    stats = {(r.prompt[:1], r.temperature): r for r in runs.repeat_stats(calls.join(said, "call_id"), ["prompt", "temperature"], "answer").collect()}
    assert stats["o", 0.0].unique == 1 and stats["o", 0.0].label == "deterministic" and stats["o", 0.0].runs == 3
    assert runs.pair_counts(calls, ["prompt"]).collect()[0].pairs == 15

    class Broken:
        def complete(self, model, prompt, temperature, seed):
            raise RuntimeError("down")

    row = models.call_model(calls, "call_id", F.col("prompt"), Broken(), "m").collect()[0]
    assert (row.answer, row.ok) == ("[RuntimeError: down]", False)
    questions = spark.createDataFrame([(f"q{i}", f"question {i}", f"context {i}") for i in range(20)], "qid string, question string, context string")
    out = models.judge_pipeline(questions, client, "a", "j", "g").collect()
    assert len(out) == 20 and all(r.verdict == "REFUSED" for r in out if r.gate == "MISSING")
    with pytest.raises(ValueError, match="different"):
        models.judge_pipeline(questions, client, "a", "j", "j")
    assert models.stamp(questions, model="m", seed=7).select("config.seed").first()[0] == 7


def test_key_proposals(spark):
    rows = [("What is the levy?", "Members gather at the gate each day. The levy for juniors is £38 per season, payable in March."), (None, None), ("zebra", "Nothing of the kind is said in here at all.")]
    got = [r.proposed for r in keys.with_proposed_key(spark.createDataFrame(rows, "question string, passage string"), "question", "passage").collect()]
    assert "£38" in got[0] and got[1:] == ["", ""]


def test_sections_by_number_and_fallback(spark):
    text = "cover\n1. First\nRevision 4\na\n\nb\nPage 3\n2. Empty\n10. Last\nc"
    lines = segments.lines_of(spark.createDataFrame([(1, text), (2, "no heading"), (3, None), (4, "")], "d long, t string"), "d", "t")
    got = [(r.d, r.section_no, r.number, r.title, r.body) for r in segments.numbered_sections(lines, "d").orderBy("d", "section_no").collect()]
    assert got == [(1, 1, "1", "First", "a b"), (1, 2, "2", "Empty", ""), (1, 3, "10", "Last", "c")]
    first = spark.createDataFrame([(1, "f")], "d long, body string")
    second = spark.createDataFrame([(1, "t"), (2, "t")], "d long, body string")
    assert sorted((r.d, r.body, r.used) for r in segments.with_fallback(first, second, "d").collect()) == [(1, "f", "font"), (2, "t", "text")]


def test_rows_without_the_last(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], "k long, v string")
    assert sorted(r.k for r in records.without_last(df, "k", 2).collect()) == [0, 1, 2]
    assert records.without_last(df, "k", 9).count() == 0 and records.without_last(df, "k", 0).count() == 5


def test_scoped_vector_search(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice("abc")) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place string")
    asked = spark.createDataFrame([(1000 + i, v, p if i % 3 else None) for i, (_, v, p) in enumerate(rows[:12])], "vec_id long, embedding array<double>, place string")
    got = {}
    for r in ranking.knn(vectors, asked, 3, query_block=5, chunk=20, scope="place").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 5)

    for q in asked.collect():
        inside = [(cosine(q.embedding, v), i) for i, v, p in rows if q.place is None or p == q.place]
        assert got[q.vec_id] == [i for _, i in sorted(inside, reverse=True)[:3]]


def test_embedding_client_in_batches_with_fallback(spark):
    class Fussy:
        def embed(self, texts):
            if len(texts) > 32 or "bad" in texts:
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

    class Plain:
        def embed(self, texts):
            return [[-1.0] for _ in texts]

    docs = spark.createDataFrame([(i, None if i == 3 else "bad" if i == 90 else "x" * i) for i in range(100)], "k long, t string").coalesce(1)
    got = {r.k: r.embedding for r in ranking.embedded(docs, "k", F.col("t"), Fussy(), Plain()).collect()}
    assert got[5] == [5.0] and got[3] == [0.0] and got[63] == [63.0] and got[64] == got[90] == [-1.0]
    assert sum(v == [-1.0] for v in got.values()) <= 32  # only the batch of the text that fails
    with pytest.raises(Exception, match="no"):
        ranking.embedded(docs, "k", F.col("t"), Fussy()).collect()
    assert ranking.hashed_embedding(docs.limit(0), "k", "t").count() == 0


def test_runners(spark):
    class Echo:
        def complete(self, model, prompt, temperature, seed):
            said = "positive." if "sentiment" in prompt else '{"topic": 1, "action_required": true, "deadline": null}' if "JSON" in prompt else "That is not covered in the club documents." if "secret" in prompt else prompt
            return said, 0.5, 3, 4

    cases = spark.createDataFrame([(1, "who?", "the BURSAR", "bursar"), (2, "who?", "nobody", "bursar"), (3, "secret", "", None), (4, "open", None, None)], "case_id long, question string, context string, fact string")
    got = {(r.case_id, r.kind): r.ok for r in models.run_cases(cases, Echo(), ("m",)).collect()}
    assert got == {(1, "grounded"): True, (2, "grounded"): False, (3, "refusal"): True, (4, "refusal"): False}
    one = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    tasks = models.run_tasks({"sentiment": one, "summarize": one, "extract": one}, Echo(), "m").collect()
    assert len(tasks) == 6 and all(r.ok for r in tasks)
    floor = models.noise_floor(spark.createDataFrame([("p",)], "p string"), "p", Echo(), "m", 4).first()
    assert (floor.runs, floor.unique, floor.label) == (4, 1, "deterministic")
    assert models.temperature_identity(one, "id", "text", models.StubClient(), "m").filter("not same").count() == 0
    both = models.grounded_and_plain(spark.createDataFrame([("q", "who?", None), ("r", "who?", "a b c")], "qid string, question string, context string"), Echo(), "m")
    assert all(r.cost_grounded > r.cost_plain for r in both.collect())


def test_block_ranking_equals_ranking_of_all_scores(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, None if i == 7 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice("ab")) for i in range(80)] + [(None, "w1", "a")]
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for q in range(9)] + [(50, "unknown"), (51, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, scope string")
    index = ranking.TermIndex(df.drop("scope"), spark.createDataFrame(asked, "qid long, query string"))

    def rows(ranked):
        return sorted((r.qid, r.rank, r.doc_id, round(r.score, 5)) for r in ranked.collect())

    assert rows(index.top(5)) == rows(ranking.top_k(index.padded(index.bm25(), 5), 5))
    assert rows(index.top(4, "tfidf", zeros=False, lower_first=False)) == rows(ranking.top_k(index.saturated_tfidf(), 4, lower_first=False))
    named = spark.createDataFrame([(q, "a" if q % 2 else None) for q, _ in asked], "qid long, scope string")
    all_scores = index.bm25().join(df.select("doc_id", F.col("scope").alias("s")), "doc_id").join(named, "qid").filter("scope is null or scope = s")
    assert rows(index.top(5, zeros=False, scope=(df, named))) == rows(ranking.top_k(all_scores.select("qid", "doc_id", "score"), 5))
    assert ranking.TermIndex(df.drop("scope").limit(0), spark.createDataFrame(asked, "qid long, query string")).top(3).count() == 0
