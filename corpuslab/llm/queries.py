"""Registered queries of the language-model operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import languages, leaks, mixing, pairs, split, terms, tokens
from corpuslab.llm.oracles import ORACLES
from corpuslab.operators.skew import current_rows
from corpuslab.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Terms that occur three or more times in a record and in two to six records, by their score, which is above 0 for all."""
    return terms.distinctive_terms(table(spark, root, "records"), min_tf=3, min_df=2, max_df=6).filter("score > 0").select("doc_id", "term")


def p2_top_terms(spark: SparkSession, root: str) -> DataFrame:
    """The five most distinctive terms of every record with their scores."""
    scored = terms.distinctive_terms(table(spark, root, "records")).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    top = scored.withColumn("place", F.row_number().over(best)).filter("place <= 5")
    return top.select("doc_id", F.col("place").cast("long").alias("place"), "term", "tf", "df", "score")


def _record_tokens(spark: SparkSession, root: str) -> DataFrame:
    return tokens.record_tokens(table(spark, root, "records"), table(spark, root, "tokenizer_vocab"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Published token counts of known records that cannot be used."""
    return tokens.unusable_counts(table(spark, root, "token_counts"), _record_tokens(spark, root))


def p4_totals(spark: SparkSession, root: str) -> DataFrame:
    """Documents and tokens per official source type, language and topic."""
    return tokens.token_totals(_record_tokens(spark, root), table(spark, root, "cost_by_source"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The kind of boundary at which each oversized record is cut."""
    return split.split_oversized(table(spark, root, "records")).filter("piece_no = 1").select("doc_id", "cut_level")


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all oversized records."""
    return split.split_oversized(table(spark, root, "records"))


def p5_whole(spark: SparkSession, root: str) -> DataFrame:
    """Whether the pieces of each oversized record fit, cover it without a gap, overlap as asked and end where they say."""
    records = table(spark, root, "records")
    made = split.split_oversized(records)
    before = Window.partitionBy("doc_id").orderBy("piece_no")
    texts = current_rows(records, F.col("doc_id"), ["text"]).select(F.col("key").alias("doc_id"), "text")
    each = made.withColumn("_last", F.lag("stop").over(before)).withColumn("_size", F.lag(F.col("stop") - F.col("start")).over(before)).join(texts, "doc_id")
    shared = F.col("_last") - F.col("start")
    head = F.substring("text", F.lit(1), F.col("stop"))
    ends = (
        F.when(F.col("boundary") == "paragraph", head.rlike(r"\n\s*\n\s*$"))
        .when(F.col("boundary") == "sentence", head.rlike(r"(?:\n|[.!?]\s+)$"))
        .when(F.col("boundary") == "word", head.rlike(r"\s$"))
        .otherwise(True)
    )
    return each.groupBy("doc_id").agg(
        F.max("stop").cast("long").alias("chars"),
        F.min("start").cast("long").alias("first"),
        F.count_if(F.length("piece") > 1200).alias("over"),
        F.count_if(F.col("piece") != F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))).alias("changed"),
        F.count_if((shared < 1) | (shared > 200) | (shared < 120) & (F.col("_size") > 200)).alias("badly_shared"),
        F.count_if(~ends).alias("elsewhere"),
    )


def p6_empty(spark: SparkSession, root: str) -> DataFrame:
    """Pairs whose answer has no content."""
    return p6_found(spark, root).filter("defect = 'empty'").select("faq_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Question and answer pairs that cannot be used, with the kind of defect."""
    return pairs.broken_pairs(table(spark, root, "faq_export"), table(spark, root, "lang_samples"))


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs per category and kind of defect."""
    faq = table(spark, root, "faq_export").select("faq_id", "category").distinct()
    found = p6_found(spark, root).join(faq, "faq_id")
    return found.groupBy("category", "defect").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of evaluation item and document that share eight or more words in a row."""
    found = leaks.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return found.select("item_id", "doc_id").distinct()


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """The documents without any evaluation passage."""
    documents = table(spark, root, "documents").select("doc_id", "text")
    return leaks.without_leaks(documents, leaks.leaked_passages(documents, table(spark, root, "eval_items"))).select("doc_id")


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """Each item with the number of documents it leaked into and its longest match."""
    items = table(spark, root, "eval_items")
    return leaks.leaks_by_item(items, leaks.leaked_passages(table(spark, root, "documents"), items))


def _plan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.documents_with_tokens(table(spark, root, "documents"))
    return sized, mixing.mix_plan(sized, table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    return mixing.scheduled_shortages(_plan(spark, root)[1])


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mix itself, one row per use of a document."""
    return mixing.mix(*_plan(spark, root))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every source."""
    sized, plan = _plan(spark, root)
    shares = mixing.mix_shares(mixing.mix(sized, plan), plan)
    return shares.withColumn("actual_share", F.round("actual_share", 6))


def _languages(spark: SparkSession, root: str) -> DataFrame:
    return languages.document_languages(table(spark, root, "documents"), table(spark, root, "lang_samples"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or one of several languages."""
    return languages.mislabelled(_languages(spark, root))


def p9_documents(spark: SparkSession, root: str) -> DataFrame:
    """The main language of every document with its confidence."""
    return _languages(spark, root).select("doc_id", "lang", F.round("confidence", 4).alias("confidence"))


def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    """The stretches of every document with their language and confidence."""
    return languages.language_segments(_languages(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_top_terms, p4_found, p4_totals, p5_found, p5_pieces, p5_whole, p6_found, p6_empty, p6_report, p7_found, p7_clean, p7_items, p8_found, p8_mix, p8_shares, p9_found, p9_documents, p9_segments)
}

__all__ = ["ORACLES", "QUERIES"]
