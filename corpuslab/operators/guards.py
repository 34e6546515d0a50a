"""Grounding guards for answers: numbers, vocabulary, support and relevance, and the final verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import collapse, numbers, refusal_kind, stem, tokens
from corpuslab.operators.skew import join_unique

_ALL = r"[a-z0-9$]+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_ALL), F.lit(0))


def grounding(answer: Column, context: Column) -> Column:
    """The share of the answer's content tokens, repeats counted, that the context has; 1 for an answer without any."""
    known = F.array_distinct(_tokens(F.coalesce(context, F.lit(""))))
    said = tokens(F.coalesce(answer, F.lit("")), "guard")
    absent = F.filter(said, lambda t: ~F.array_contains(known, t))
    return F.when(F.size(said) == 0, 1.0).otherwise(1 - F.size(absent) / F.size(said))


def bad_numbers(answer: Column, context: Column) -> Column:
    """The numbers of the answer, in normal form, that the context does not have."""
    flat = F.replace(F.lower(collapse(F.coalesce(context, F.lit("")))), F.lit(","), F.lit(""))
    return F.filter(numbers(F.coalesce(answer, F.lit(""))), lambda x: (x != "") & ~F.contains(flat, x))


def best_sentence(answer: Column, text: Column, least: int = 25, most: int = 340) -> Column:
    """The sentence of a text that an answer leans on, cut to `most` characters; empty if none shares a token with it.

    Shared tokens over the root of the sentence's, times 1 + 2 * the share of the answer's numbers it has; the first of
    equals. All in one expression, so nothing is exploded or moved.
    """
    said = F.array_distinct(_tokens(F.coalesce(answer, F.lit(""))))
    figures = F.array_distinct(numbers(F.coalesce(answer, F.lit(""))))
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)

    def scored(s: Column, i: Column) -> Column:
        own = F.array_distinct(_tokens(s))
        overlap = F.size(F.array_intersect(said, own)) / F.sqrt(F.greatest(F.size(own), F.lit(1)))
        shared = F.size(F.array_intersect(figures, F.array_distinct(numbers(s))))
        factor = F.when(F.size(figures) > 0, 1 + 2 * shared / F.size(figures)).otherwise(1.0)
        return F.struct(F.round(overlap * factor, 9).alias("score"), (-i).alias("order"), s.alias("s"))

    best = F.array_max(F.transform(pieces, scored))
    return F.when(best["score"] > 0, F.substring(best["s"], 1, most)).otherwise("")


def support(answer: Column, quote: Column) -> Column:
    """The share of the answer's distinct content tokens that the quote has; 0 for an answer without any."""
    said = F.array_distinct(tokens(F.coalesce(answer, F.lit("")), "guard"))
    return F.size(F.array_intersect(said, tokens(quote, "guard"))) / F.greatest(F.size(said), F.lit(1))


def relevance(rows: DataFrame, idf: DataFrame, key: str, question: str, quote: str, total: int) -> DataFrame:
    """`(key, relevance)`: how much of the question's content, weighted by rarity, the quote has; stems are compared.

    Terms without a weight count 1; a question without content tokens has relevance 1.
    """
    has = F.transform(F.array_distinct(_tokens(F.coalesce(quote, F.lit("")))), stem)
    each = rows.select(key, has.alias("_has"), F.explode_outer(tokens(F.coalesce(question, F.lit("")), "guard")).alias("term"))
    marked = each.select(key, "term", F.coalesce(F.array_contains("_has", stem(F.col("term"))), F.lit(False)).alias("_in"))
    named = marked.filter("term is not null")
    weighed = join_unique(named, idf, "term", total, "left").withColumn("_w", F.coalesce("idf", F.lit(1.0)))
    found = weighed.groupBy(key).agg((F.sum(F.when(F.col("_in"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("relevance"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("relevance", F.lit(1.0)).alias("relevance"))


#: Floors of the guards.
FLOORS = {"grounding": 0.80, "support": 0.30, "relevance": 0.55}


def guarded(rows: DataFrame, idf: DataFrame, key: str, total: int, floors: dict[str, float] | None = None) -> DataFrame:
    """Answers `(key, question, answer, context)` with what each guard says and the first that fails, if any.

    `reason` is 'numbers', 'grounding', 'no source', 'relevance' or empty, in that order.
    """
    at = floors or FLOORS
    answer, context = F.col("answer"), F.col("context")
    made = rows.withColumn("bad_numbers", bad_numbers(answer, context)).withColumn("grounding", grounding(answer, context))
    made = made.withColumn("quote", best_sentence(answer, context)).withColumn("support", support(answer, F.col("quote")))
    made = made.join(relevance(made, idf, key, F.col("question"), F.col("quote"), total), key)
    reason = (
        F.when(F.size("bad_numbers") > 0, "numbers")
        .when(F.col("grounding") < at["grounding"], "grounding")
        .when((F.col("quote") == "") | (F.col("support") < at["support"]), "no source")
        .when(F.col("relevance") < at["relevance"], "relevance")
        .otherwise("")
    )
    return made.withColumn("reason", reason)


def final_verdict(verdict: Column, answer: Column, reason: Column) -> Column:
    """The judge's verdict, unless the answer is a refusal or a guard held it back: then REFUSED."""
    return F.when(refusal_kind(answer).isNotNull() | (reason != ""), "REFUSED").otherwise(verdict)


def outcome_matrix(judged: DataFrame) -> DataFrame:
    """All outcomes in one pass; inventions are counted over all rows, also those that should be refused."""
    answerable, verdict = F.col("expect") == "answerable", F.col("verdict")
    return judged.agg(
        F.count_if(~answerable & (verdict == "REFUSED")).alias("correct_refusals"),
        F.count_if(~answerable).alias("must_refuse"),
        F.count_if(answerable & (verdict == "SUPPORTED")).alias("grounded"),
        F.count_if(answerable).alias("answerable"),
        F.count_if(verdict == "UNSUPPORTED").alias("invented"),
        F.count_if(~answerable & (verdict == "UNSUPPORTED")).alias("invented_on_refuse"),
        F.count_if(answerable & (verdict == "REFUSED") & (F.col("retrieved") == 1)).alias("over_refused"),
        F.count_if(F.col("refusal") == "corrupt").alias("mangled"),
        F.count_if(F.col("reason") != "").alias("held"),
    )


def gate_confusion(judged: DataFrame) -> DataFrame:
    """What the gate said against whether the context had the answer; UNPARSED is a column of its own."""
    truth = F.when((F.col("expect") == "answerable") & (F.col("retrieved") == 1), "COVERED").otherwise("MISSING")
    return judged.groupBy(truth.alias("truth")).agg(*[F.count_if(F.col("gate") == g).alias(g.lower()) for g in ("COVERED", "MISSING", "UNPARSED")])


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions whose verdict changed between two runs: FIXED, BROKE or sideways; those of one run only are 'only a' or 'only b'."""

    def good(side: str) -> Column:
        expect, verdict = F.col(f"expect_{side}"), F.col(f"verdict_{side}")
        return ((expect == "answerable") & (verdict == "SUPPORTED")) | ((expect == "refuse") & (verdict == "REFUSED"))

    left = a.select("qid", F.col("expect").alias("expect_a"), F.col("verdict").alias("verdict_a"))
    right = b.select("qid", F.col("expect").alias("expect_b"), F.col("verdict").alias("verdict_b"))
    change = (
        F.when(F.col("verdict_b").isNull(), "only a")
        .when(F.col("verdict_a").isNull(), "only b")
        .when(good("b") & ~good("a"), "FIXED")
        .when(good("a") & ~good("b"), "BROKE")
        .otherwise("sideways")
    )
    joined = left.join(right, "qid", "full")
    return joined.filter(~F.col("verdict_a").eqNullSafe(F.col("verdict_b"))).select("qid", "verdict_a", "verdict_b", change.alias("change"))


def run_totals(runs: dict[str, DataFrame]) -> DataFrame:
    """Verdicts per run."""
    parts = [df.select(F.lit(name).alias("run"), "verdict") for name, df in runs.items()]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return pool.groupBy("run", "verdict").agg(F.count("*").alias("n"))
