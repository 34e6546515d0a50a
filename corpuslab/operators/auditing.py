"""Audits: evidence for answers, term sweeps, claims, keys, samples, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators.quantiles import numbered
from corpuslab.session import cut_lineage

#: Fixed value: a line of a table of contents.
DOTS = r"\.{6,}"

#: Claims and the terms under which a source would speak of them.
CLAIMS = {
    "concussion procedure": ["concussion", "head injury"],
    "what to do if injured": ["injured", "injury"],
    "family cannot afford the fees": ["scholarship", "financial assistance", "hardship", "fee waiver", "reduced fee", "afford", "unable to pay"],
    "game start times": ["game time", "kick off", "kickoff", "games start", "games begin"],
    "practice schedule": ["practice schedule", "twice per week", "practice times", "practices are"],
    "game locations": ["home games", "away games", "directions to"],
    "tryout dates": ["tryout"],
    "parent meeting": ["meeting"],
    "uniform cost": ["uniform"],
    "tournament fees": ["tournament"],
}


def parse_candidates(lines: DataFrame, column: str = "value") -> DataFrame:
    """`(question, terms)` of lines `question | extra, terms`; blank lines and those that start with # are left out.

    Terms are the extra ones, the question's sweep tokens and their forms without a final s, each once in that order.
    """
    kept = lines.select(F.trim(column).alias("l")).filter((F.col("l") != "") & ~F.col("l").startswith("#"))
    question = F.trim(F.substring_index("l", "|", 1))
    extra = F.when(F.contains("l", F.lit("|")), F.expr("substring(l, instr(l, '|') + 1)")).otherwise("")
    given = F.filter(F.transform(F.split(extra, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    derived = tx.tokens(question, "sweep")
    stems = F.transform(F.filter(derived, lambda w: (F.length(w) > 4) & w.rlike(r"[\p{L}\p{N}]s$")), lambda w: F.regexp_replace(w, "s$", ""))
    return kept.select(question.alias("question"), F.array_distinct(F.concat(given, derived, stems)).alias("terms"))


def term_counts(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """`(key, term, n)`: whole-word counts of a stated list of terms in every text; terms without a hit have no row.

    One pass over the texts: every term is a literal pattern, compiled once.
    """
    counts = F.array(*[F.struct(F.lit(t).alias("term"), tx.whole_word_count(F.col(text), t).cast("long").alias("n")) for t in terms])
    each = docs.select(key, F.explode(counts).alias("c")).select(key, "c.term", "c.n")
    return each.filter("n > 0")


def sweep(docs: DataFrame, group: str, text: str, candidates: list[tuple[str, list[str]]], cap: int = 40) -> DataFrame:
    """`(question, group, n, rare_n, common_terms)`: mentions of each candidate's terms per group.

    Terms that occur more than `cap` times in all groups together localise nothing and count only in `n`. Groups without
    any mention have no row; a candidate that nothing mentions has one row with a null group.
    """
    terms = sorted({t for _, ts in candidates for t in ts})
    per = term_counts(docs, group, text, terms).groupBy(group, "term").agg(F.sum("n").alias("n"))
    total = per.groupBy("term").agg(F.sum("n").alias("total"))
    spark = docs.sparkSession
    asked = F.broadcast(spark.createDataFrame([(q, t) for q, ts in candidates for t in dict.fromkeys(ts)], "question string, term string"))
    joined = asked.join(F.broadcast(total), "term").join(per, "term")
    rare = F.when(F.col("total") <= cap, F.col("n")).otherwise(0)
    found = joined.groupBy("question", group).agg(F.sum("n").alias("n"), F.sum(rare).alias("rare_n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("total") > cap, F.col("term")))), ",").alias("common_terms"))
    none = asked.select("question").distinct().join(F.broadcast(found.select("question").distinct()), "question", "left_anti")
    empty = none.select("question", F.lit(None).cast(docs.schema[group].dataType).alias(group), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("rare_n"), F.lit("").alias("common_terms"))
    return found.unionByName(empty)


def refuse_conflicts(swept: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions labelled to be refused that the sweep finds mentions for (an extension: a label check)."""
    mentioned = swept.groupBy("question").agg(F.sum("rare_n").alias("mentions")).filter("mentions > 0")
    return labels.filter("expect = 'refuse'").join(mentioned, "question")


def passages(docs: DataFrame, key: str, text: str, terms: list[str], limit: int = 520) -> DataFrame:
    """`(key, start, passage, terms)`: each sentence that terms hit, once, with the set of its terms.

    Lines of tables of contents are dropped; of a sentence over the limit the part around its first hit is kept.
    """
    each = docs.select(key, F.explode(tx.bounded_sentences(tx.collapse(F.col(text)))).alias("s")).select(key, "s.start", tx.collapse(F.col("s.sentence")).alias("s"))
    each = each.filter((F.col("s") != "") & ~F.col("s").rlike(DOTS))
    hits = F.array_sort(F.filter(F.array(*[F.when(tx.whole_word_count(F.col("s"), t) > 0, F.lit(t)) for t in sorted(terms)]), lambda t: t.isNotNull()))
    marked = each.withColumn("terms", hits).filter(F.size("terms") > 0)
    first = F.array_min(F.filter(F.transform("terms", lambda t: F.instr(F.lower("s"), t)), lambda p: p > 0))
    begin = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - limit // 3)
    part = F.concat(F.when(begin > 1, "… ").otherwise(""), F.substring(F.col("s"), begin, F.lit(limit)), F.lit(" …"))
    return marked.select(key, "start", F.when(F.length("s") > limit, part).otherwise(F.col("s")).alias("passage"), F.array_join("terms", ",").alias("terms"))


def claim_counts(docs: DataFrame, group: str, text: str, claims: dict[str, list[str]] | None = None) -> DataFrame:
    """`(claim, group, n, best_term)`: substring counts of a claim's terms and the most frequent, the first on ties."""
    claims = claims or CLAIMS
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counted = [F.struct(F.lit(c).alias("claim"), F.lit(i).alias("place"), F.lit(t).alias("term"), tx.substring_count(low, F.lit(t)).cast("long").alias("n")) for c, ts in claims.items() for i, t in enumerate(ts)]
    each = docs.select(group, F.explode(F.array(*counted)).alias("c")).select(group, "c.*").filter("n > 0")
    per = each.groupBy("claim", group, "term", "place").agg(F.sum("n").alias("n"))
    return per.groupBy("claim", group).agg(F.sum("n").alias("n"), F.max_by("term", F.struct("n", -F.col("place"))).alias("best_term"))


def claim_snippets(docs: DataFrame, key: str, text: str, claims: dict[str, list[str]] | None = None, pad: int = 230) -> DataFrame:
    """`(key, claim, start, snippet)`: the text around every occurrence of a claim's terms.

    Contents lines are dropped, and of snippets with the same first 50 characters in one text only the first is kept.
    """
    claims = claims or CLAIMS
    flat = tx.collapse(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(key, flat.alias("_t"), F.lower(flat).alias("_l"))
    pairs = F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(t).alias("term")) for c, ts in claims.items() for t in ts])
    hit = base.select(key, "_t", "_l", F.explode(pairs).alias("c")).filter(F.contains(F.col("_l"), F.col("c.term")))
    pieces = F.split(F.col("_l"), F.concat(F.lit(r"\Q"), F.col("c.term"), F.lit(r"\E")), F.lit(-1))
    size = F.length(F.col("c.term"))
    ends = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"),
        lambda done, p: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)) + size, F.lit(0)) + F.length(p))),
    )
    each = hit.select(key, F.col("c.claim").alias("claim"), "_t", size.alias("_n"), F.explode(ends).alias("start"))
    left = F.greatest(F.lit(0), F.col("start") - pad)
    cut = each.select(key, "claim", "start", F.substring("_t", left + 1, F.col("start") + F.col("_n") + pad - left).alias("snippet"))
    shown = cut.filter(~F.col("snippet").rlike(DOTS))
    return shown.groupBy(key, "claim", F.substring("snippet", 1, 50).alias("_head")).agg(F.min("start").alias("start"), F.min_by("snippet", "start").alias("snippet")).drop("_head")


def key_report(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """`(key, hits, verdict)` of stated keys: how often they occur in all texts together, and whether they can serve."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counted = F.array(*[F.struct(F.lit(k).alias("key"), tx.substring_count(low, F.lit(k.lower())).cast("long").alias("n")) for k in keys])
    sums = docs.select(F.explode(counted).alias("c")).groupBy("c.key").agg(F.sum("c.n").alias("hits"))
    return sums.select("key", "hits", tx.key_verdict(F.col("hits"), F.col("key")).alias("verdict"))


def evidence(answers: DataFrame, docs: DataFrame, qid: str, answer: str, key: str, text: str, n: int = 3, least: int = 25) -> DataFrame:
    """`(qid, place, key, sentence, score)`: the sentences that share most rare words with each answer, at least two.

    Shared words over the sentence's to the power 0.4; of sentences with the same first 40 characters only the best
    counts. The answers are a stated audit set: their words go to the tasks, where each sentence meets the answers of its
    words in one count over arrays; only the best sentences of a batch, n for each answer, leave it.
    """
    words = F.array_distinct(tx.tokens(F.coalesce(F.col(answer), F.lit("")), "audit"))
    asked = answers.select(qid, words.alias("w")).collect()
    ids = [r[0] for r in asked]
    holders: dict[str, list[int]] = {}
    for i, r in enumerate(asked):
        for w in r["w"]:
            holders.setdefault(w, []).append(i)
    of = {w: np.array(x, np.int64) for w, x in holders.items()}
    none = np.zeros(0, np.int64)

    def best(found: pd.DataFrame) -> pd.DataFrame:
        """The n best rows of each answer, one for each opening."""
        found = found.sort_values(["q", "score", "key", "pos"], ascending=[True, False, True, True]).drop_duplicates(["q", "head"])
        return found.groupby("q", sort=False).head(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a : a + 2000]
                size = part["own"].map(len).to_numpy()
                met = [np.concatenate([of.get(w, none) for w in own]) if len(own) else none for own in part["own"]]
                at = np.repeat(np.arange(len(part)), [len(x) for x in met]) * max(len(ids), 1) + (np.concatenate(met) if met else none)
                pair, hits = np.unique(at, return_counts=True)
                pair, hits = pair[hits >= 2], hits[hits >= 2]
                row, q = pair // max(len(ids), 1), pair % max(len(ids), 1)
                taken = part.iloc[row]
                found = pd.DataFrame({"q": q, "key": taken["key"].to_numpy(), "pos": taken["pos"].to_numpy(), "s": taken["s"].to_numpy(), "hit": hits, "size": size[row]})
                found["score"] = np.round(found["hit"] / found["size"] ** 0.4, 6)
                found["head"] = found["s"].str[:40]
                kept = best(found)
                yield pd.DataFrame({"q": [ids[i] for i in kept["q"]], "key": kept["key"], "pos": kept["pos"], "s": kept["s"], "hit": kept["hit"], "size": kept["size"]})

    cut = docs.select(F.col(key).alias("key"), F.posexplode(F.transform(tx.sentences(F.col(text)), lambda s: F.trim(s))).alias("pos", "s")).filter((F.length("s") > least) & F.col("key").isNotNull())
    own = F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9$]+"), F.lit(0)))
    kinds = f"q {answers.schema[qid].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, pos int, s string, hit long, size long"
    scored = cut.select("key", "pos", "s", own.alias("own")).mapInPandas(run, kinds).withColumn("score", F.round(F.col("hit") / F.pow("size", F.lit(0.4)), 6))
    heads = scored.groupBy("q", F.substring("s", 1, 40).alias("_head")).agg(F.max_by(F.struct("key", "pos", "s", "score"), F.struct("score", -F.col("key"), -F.col("pos"))).alias("b"))
    order = Window.partitionBy("q").orderBy(F.desc("b.score"), "b.key", "b.pos")
    ranked = heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.select(F.col("q").alias(qid), "place", F.col("b.key").alias(key), F.col("b.s").alias("sentence"), "b.score")


def audit_sample(judged: DataFrame, n: int) -> DataFrame:
    """`(qid, place)`: rows to read by hand: all that matter most first, then every so-manieth of the rest.

    First answers to questions that should be refused, then rejected answers, each by id and at most n together; then
    every step-th of the supported rest with step = max(1, rest // still wanted). The ids that can be chosen, one short row
    each, are written to the checkpoint folder, so that the judged rows are computed once.
    """
    ruled = judged.filter(F.col("verdict").isin("SUPPORTED", "UNSUPPORTED") & F.col("refusal").isNull())
    priority = F.when((F.col("expect") == "refuse") & (F.col("verdict") == "SUPPORTED"), 0).when(F.col("verdict") == "UNSUPPORTED", 1).otherwise(2)
    slim = cut_lineage(ruled.select(F.concat(priority.cast("string"), F.lit(":"), "qid").alias("_k"), "qid", priority.alias("_p")))
    placed = numbered(slim, "_k", "_n")
    head = slim.agg(F.count_if(F.col("_p") < 2)).scalar()
    rest = slim.agg(F.count_if(F.col("_p") == 2)).scalar()
    want = F.greatest(F.lit(0), F.lit(n) - head)
    step = F.greatest(F.lit(1), F.when(want > 0, F.floor(rest / want)).otherwise(1))
    nth = F.col("_n") - head - 1
    in_rest = (F.col("_p") == 2) & (nth % step == 0) & (nth / step < want)
    chosen = placed.filter(((F.col("_p") < 2) & (F.col("_n") <= n)) | in_rest)
    place = F.when(F.col("_p") < 2, F.col("_n")).otherwise(head + nth / step + 1)
    return chosen.select("qid", place.cast("long").alias("place"))


def coverage(questions: DataFrame, categories: list[str], least: int = 25, least_refuse: int = 5) -> DataFrame:
    """Questions per category, stated or not, unused ones with 0, and a row 'total' that says whether the set is large enough."""
    spark = questions.sparkSession
    counts = questions.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("expect") == "refuse").alias("refuse"))
    dim = spark.createDataFrame([(c,) for c in categories], "category string")
    per = dim.join(counts, "category", "full").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("refuse", F.lit(0)).alias("refuse"), F.lit(None).cast("boolean").alias("enough"))
    total = questions.agg(F.count("*").alias("n"), F.count_if(F.col("expect") == "refuse").alias("refuse"))
    return per.unionByName(total.select(F.lit("total").alias("category"), "n", "refuse", ((F.col("n") >= least) & (F.col("refuse") >= least_refuse)).alias("enough")))


def renumbered(questions: DataFrame, order: str) -> DataFrame:
    """Questions with new sequential ids q01, q02, ... in a given order."""
    return numbered(questions, order, "_n").withColumn("qid", F.concat(F.lit("q"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(2), F.length(F.col("_n").cast("string"))), F.lit("0")))).drop("_n")
