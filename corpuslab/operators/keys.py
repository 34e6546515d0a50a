"""Proposing answer keys: the shortest fragment of a passage that carries the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import tokens
from corpuslab.operators.ranking import TermIndex

#: An amount or number, and the clause around it.
FIGURE = r"[$£€]\s?\d|\b\d{1,4}\b"
CLAUSE = r"[^,;:]{0,45}(?:[$£€]\s?[\d,]+|\b\d{1,4}\b)[^,;:]{0,45}"


def with_proposed_key(rows: DataFrame, question: str, passage: str, name: str = "proposed", most: int = 72, least: int = 8) -> DataFrame:
    """Add the clause around a number of the passage's best sentence, else the sentence, cut to whole words; '' if none serves.

    A sentence of more than 25 characters scores its distinct draft tokens shared with the question, and 2 more for a
    number; the first of the best counts. Built in steps, so that each is computed once.
    """
    cut = F.filter(F.transform(F.split(F.coalesce(passage, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 25)

    def scored(s: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("_asked"), F.array_distinct(tokens(s, "draft"))))
        return F.struct((shared + F.when(s.rlike(FIGURE), 2).otherwise(0)).alias("score"), (-i).alias("order"), s.alias("s"))

    edges = r"^[ ,;:.]+|[ ,;:.]+$"
    before = F.col("_sentence").substr(F.col("_at") - 1, F.lit(1))
    broken = (F.col("_at") > 1) & before.rlike(r"\S") & F.contains("_clause", F.lit(" "))
    whole = F.when(broken, F.regexp_replace("_clause", r"^\S* ", "")).otherwise(F.col("_clause"))
    sizes = F.filter(F.sequence(F.lit(1), F.size("_words")), lambda n: (F.length(F.concat_ws(" ", F.slice("_words", 1, n))) <= most) | (n <= 4))
    return (
        rows.withColumn("_asked", F.array_distinct(tokens(F.coalesce(question, F.lit("")), "draft")))
        .withColumn("_pieces", cut)
        .withColumn("_best", F.array_max(F.transform("_pieces", scored)))
        .withColumn("_sentence", F.coalesce("_best.s", F.lit("")))
        .withColumn("_clause", F.regexp_extract("_sentence", f"({CLAUSE})", 1))
        .withColumn("_at", F.instr("_sentence", F.col("_clause")))
        .withColumn("_frag", F.regexp_replace(F.when(F.col("_clause") != "", whole).otherwise(F.col("_sentence")), edges, ""))
        .withColumn("_words", F.split("_frag", r"\s+"))
        .withColumn("_made", F.regexp_replace(F.concat_ws(" ", F.slice("_words", 1, F.array_max(sizes))), edges, ""))
        .withColumn(name, F.when((F.col("_best.score") > 0) & (F.length("_made") >= least), F.col("_made")).otherwise(""))
        .drop("_asked", "_pieces", "_best", "_sentence", "_clause", "_at", "_frag", "_words", "_made")
    )


def proposed_keys(questions: DataFrame, passages: DataFrame, k: int = 4) -> DataFrame:
    """`(qid, doc_id, rank, proposed)`: a key from each of the k best passages of every question by saturated TF-IDF."""
    index = TermIndex(passages, questions, tokenizer="draft")
    best = index.top(k, "tfidf", zeros=False, lower_first=False)
    joined = passages.select("doc_id", "text").join(F.broadcast(best), "doc_id").join(F.broadcast(questions.select("qid", "query")), "qid")
    return with_proposed_key(joined, "query", "text").select("qid", "doc_id", "rank", "proposed")


