"""Scoring rankings by answer-key containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import squash_alnum
from corpuslab.operators.ranking import containment_pairs


def planted_questions(items: DataFrame, docs: DataFrame, key_chars: int = 60) -> DataFrame:
    """Questions with ground truth that needs no model: `(qid, category, query, key, n_planted, document, expect)`.

    The key is the start of the squashed passage, the query the whole of it; a question is answerable if a document
    contains its key, and `document` is the source of the first such document.
    """
    questions = items.select(
        F.col("item_id").alias("qid"),
        "category",
        F.col("text").alias("query"),
        F.substring(squash_alnum(F.col("text")), 1, key_chars).alias("key"),
    )
    pairs = planted_pairs(questions, docs)
    truth = pairs.groupBy("qid").agg(F.count("*").alias("n_planted"), F.min_by("source", "doc_id").alias("document"))
    expect = F.when(F.col("n_planted") > 0, "answerable").otherwise("refuse")
    return questions.join(F.broadcast(truth), "qid", "left").withColumn("n_planted", F.coalesce("n_planted", F.lit(0))).withColumn("expect", expect)


def planted_pairs(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """`(qid, doc_id, source)` of the documents that contain a question's key, without regard to case and punctuation."""
    hay = docs.select("doc_id", "source", squash_alnum(F.col("text")).alias("_hay")).filter("_hay is not null")
    return containment_pairs(hay, questions.select("qid", F.col("key").alias("_needle")), "_hay", "_needle").select("qid", "doc_id", "source")


def evaluation_rows(questions: DataFrame, ranked: DataFrame, docs: DataFrame, floor: float = 2.0) -> DataFrame:
    """One row per question: `answerable, hit, union, refused, top_score, winner, status`.

    `hit` is 1 if a ranked record contains the key, `union` if the joined text of the ranked records does, `refused` if
    the best score is under the floor (for questions without any match: 0). `winner` is the source of the first record
    that contains the key. What does not apply to a question's label is null.

    The ranking, a stated query set times k rows, is broadcast to the records. Only the ends of each text leave the task:
    a key that stands in the joined text but in no record lies over an end of one.
    """
    few = F.broadcast(ranked.select("qid", "doc_id", "score", "rank"))
    asked = F.broadcast(questions.select("qid", "key"))
    joined = docs.select("doc_id", "source", "text").join(few, "doc_id").join(asked, "qid").withColumn("_hay", squash_alnum(F.coalesce("text", F.lit(""))))
    has = F.contains("_hay", "key")
    near = F.greatest(F.length("key") - 1, F.lit(0))
    ends = F.when(F.length("_hay") <= 2 * near, F.col("_hay")).otherwise(F.concat(F.substring("_hay", F.lit(1), near), F.lit("|"), F.substring("_hay", F.length("_hay") - near + 1, near)))
    slim = joined.select("qid", "source", "score", "rank", "key", has.alias("_has"), ends.alias("_ends"))
    per = slim.groupBy("qid").agg(
        F.max(F.col("_has").cast("int")).alias("hit"),
        F.array_sort(F.collect_list(F.struct("rank", "_ends"))).alias("_texts"),
        F.max("score").alias("top_score"),
        F.min_by("source", F.when(F.col("_has"), F.col("rank"))).alias("_winner"),
        F.first("key").alias("_key"),
    )
    over = F.contains(F.concat_ws("", F.transform("_texts", lambda t: t["_ends"])), F.col("_key"))
    per = per.select("qid", "hit", ((F.col("hit") == 1) | over).cast("int").alias("union"), "top_score", F.when(F.col("hit") == 1, F.col("_winner")).alias("winner"))
    rows = questions.join(per, "qid", "left")
    answerable, top = F.col("expect") == "answerable", F.coalesce("top_score", F.lit(0.0))
    hit = F.coalesce("hit", F.lit(0))
    status = F.when(answerable & (hit == 1), "hit").when(answerable, "MISS").otherwise("GONE")
    return rows.select(
        "qid", "category", "expect", "document",
        answerable.cast("long").alias("answerable"),
        F.when(answerable, hit).cast("long").alias("hit"),
        F.when(answerable, F.coalesce("union", F.lit(0))).cast("long").alias("union"),
        F.when(~answerable, (top < floor).cast("long")).alias("refused"),
        top.alias("top_score"), "winner", status.alias("status"),
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Totals with integer-floored percentages and the share of losses that ranking, not the corpus, is to blame for."""
    ans = F.col("expect") == "answerable"
    n = F.greatest(F.count_if(ans), F.lit(1))
    totals = rows.agg(
        F.count("*").alias("questions"), F.count_if(ans).alias("answerable"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("union"), F.lit(0)).alias("unions"), F.count_if(~ans).alias("must_refuse"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"),
        n.alias("_n"),
    )
    return totals.select(
        "questions", "answerable", "hits", "unions", "must_refuse", "refused",
        F.floor(F.col("hits") * 100 / F.col("_n")).cast("long").alias("hit_percent"),
        (F.col("answerable") - F.col("hits")).alias("lost_in_ranking"),
        (F.col("questions") - F.col("answerable")).alias("lost_in_corpus"),
    )


def separability(rows: DataFrame) -> DataFrame:
    """The best score of a question to be refused against the least best score of a hit; separate only if strictly less."""
    out = rows.agg(
        F.max(F.when(F.col("expect") == "refuse", F.col("top_score"))).alias("worst_leak"),
        F.min(F.when(F.col("hit") == 1, F.col("top_score"))).alias("weakest_hit"),
    )
    return out.withColumn("separates", F.coalesce(F.col("worst_leak") < F.col("weakest_hit"), F.lit(False)))


def summary_by_source(rows: DataFrame) -> DataFrame:
    """Answerable questions and hits per source: that of the winning record, else of the first record with the answer."""
    at = F.coalesce("winner", "document")
    return rows.filter("expect = 'answerable'").groupBy(at.alias("source")).agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"))


def ranker_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions for which two rankers differ in `hit`: rescued by the second or dropped by it."""
    joined = a.select("qid", F.col("hit").alias("hit_a")).join(b.select("qid", F.col("hit").alias("hit_b")), "qid")
    return joined.filter("hit_a <> hit_b").withColumn("change", F.when(F.col("hit_b") == 1, "rescued").otherwise("dropped"))


def scoped(scores: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores inside the source a question names; statistics stay those of the whole corpus. Questions without one are free."""
    with_source = scores.join(docs.select("doc_id", "source"), "doc_id").join(F.broadcast(questions.select("qid", "document")), "qid")
    return with_source.filter(F.col("document").isNull() | (F.col("source") == F.col("document"))).select("qid", "doc_id", "score")


def weighted_hits(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Hits weighted per category, missing weights counting 1: an extension of the plain totals."""
    joined = rows.filter("expect = 'answerable'").join(F.broadcast(weights), "category", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return joined.agg(F.sum(F.col("w") * F.col("hit")).alias("weighted_hits"), F.sum("w").alias("weight"))


def contexts(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """`(qid, context)`: the ranked records as `[id] text`, in order of rank, joined by blank lines.

    The ranking, a stated query set times k rows, is broadcast, so that only the texts it names leave their task.
    """
    joined = docs.select("doc_id", "text").join(F.broadcast(ranked.select("qid", "doc_id", "rank")), "doc_id")
    part = F.struct("rank", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("part"))
    return joined.groupBy("qid").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])).alias("context"))


