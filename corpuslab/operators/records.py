"""Records: shaping exports into one form, checking and cleaning them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.keys import is_blank
from corpuslab.functions.text import collapse

FIELDS = ("doc_id", "source_file", "source_type", "title", "text", "updated")


def shape(df: DataFrame, *extra: str) -> DataFrame:
    """The six fields of a record: title and text with single spaces, missing ones as the empty text."""
    clean = [F.coalesce(collapse(F.col(c)) if c in ("title", "text") else F.col(c), F.lit("")).alias(c) for c in FIELDS]
    return df.select(*clean, *extra)


def faq_records(faq: DataFrame, source_file: str = "faq_export.csv") -> DataFrame:
    """Records of question and answer pairs; a blank answer leaves the text empty, so that checking rejects it."""
    text = F.when(~is_blank(F.col("answer")), F.concat_ws(" ", "question", "answer")).otherwise("")
    named = faq.select(F.concat(F.lit("faq-"), "faq_id").alias("doc_id"), F.lit(source_file).alias("source_file"), F.lit("faq").alias("source_type"), F.col("question").alias("title"), text.alias("text"), "updated")
    return shape(named)


def announcement_records(exports: DataFrame, source_file: str = "announcements.json") -> DataFrame:
    """Records of announcements in typed exports; title and body make the text."""
    a = exports.select(F.explode("announcements").alias("a")).select("a.*")
    named = a.select(
        F.concat(F.lit("ann-"), F.trim("id")).alias("doc_id"),
        F.lit(source_file).alias("source_file"),
        F.lit("announcement").alias("source_type"),
        "title",
        F.concat_ws(" ", "title", "content.body").alias("text"),
        F.col("meta.posted").alias("updated"),
    )
    return shape(named.filter(~is_blank(F.col("doc_id").substr(5, 100))))


def checked(records: DataFrame, *order: str) -> DataFrame:
    """Records with `problems`, the list of all that is wrong; sound records have an empty list.

    A repeated identifier is a problem of all its rows but the first in order, even if the first is rejected itself. Rows
    that are the same in all columns are counted together and given back with their place, since nothing else tells them
    apart whichever way the table is computed; the first is then found by one aggregation with map-side combine and a
    join on unique keys, not by sorting each group.
    """
    same = records.groupBy(*records.columns).agg(F.count("*").alias("_copies"))
    placed = same.withColumn("_at", F.struct(*order, F.xxhash64(*records.columns).alias("_row"))).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    first = placed.groupBy("doc_id").agg(F.min("_at").alias("_first"))
    joined = placed.join(first, placed["doc_id"].eqNullSafe(first["doc_id"]), "left").drop(first["doc_id"])
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    found = F.array(
        F.when(text == "", "empty text"),
        F.when(title == "", "empty title"),
        F.when(~F.col("_at").eqNullSafe(F.col("_first")) | (F.col("_copy") > 1), "duplicate doc_id"),
        F.when((text != "") & (text == title), "text adds nothing beyond the title"),
    )
    return joined.withColumn("problems", F.filter(found, lambda p: p.isNotNull())).drop("_at", "_first", "_copy", "_copies")


#: Fixed value: a row of a flattened fee table; age band, fee, instalment, number of instalments, kit.
FEE_ROW = r"(U\d+\s*[–-]\s*U\d+)\s+£([\d.]+)\s+£([\d.]+)\s*x\s*(\d+)\s+(Yes|No|Training top only)"
FEE_HEADER = "Age group Season fee Instalment Kit included"


def split_fee_tables(records: DataFrame) -> DataFrame:
    """Every row of a fee table in a text as a record of its own; the text keeps its prose."""
    groups = [F.regexp_extract_all("text", F.lit(FEE_ROW), F.lit(i)) for i in range(1, 6)]
    prose = collapse(F.replace(F.regexp_replace("text", FEE_ROW, " "), F.lit(FEE_HEADER), F.lit(" ")))
    with_rows = records.withColumn("_rows", F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("band", "fee", "part", "n", "kit"), strict=True)]))
    kept = with_rows.withColumn("text", F.when(F.size("_rows") > 0, prose).otherwise(F.col("text"))).select(*FIELDS)
    each = with_rows.select(*FIELDS, F.explode("_rows").alias("r")).withColumn("band", collapse(F.col("r.band")))
    slug = F.regexp_replace(F.regexp_replace(F.lower("band"), " ", ""), "–", "-")
    sentence = F.concat("band", F.lit(": season fee £"), "r.fee", F.lit(", or "), "r.n", F.lit(" instalments of £"), "r.part", F.lit(". Kit included: "), "r.kit", F.lit("."))
    made = each.select(F.concat("doc_id", F.lit("-"), slug).alias("doc_id"), "source_file", "source_type", F.concat("band", F.lit(" season fee")).alias("title"), sentence.alias("text"), "updated")
    return kept.unionByName(made)


def public_questions(questions: DataFrame) -> DataFrame:
    """Questions as they may be published: no answers, no keys, null texts as empty ones, each row once."""
    cols = ("qid", "category", "question", "expect", "document", "note")
    return questions.select(*[F.coalesce(c, F.lit("")).alias(c) for c in cols]).distinct()


def apply_decisions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions after an audit: `(qid, action, new_key, reason)` keeps, fixes or deletes; others stay as they are.

    Fixed questions get the new key; deleted ones are left out. At most one decision per question counts, the greatest.
    """
    one = decisions.groupBy("qid").agg(F.max(F.struct("action", "new_key", "reason")).alias("d"))
    joined = questions.join(one, "qid", "left").filter(F.coalesce(F.col("d.action"), F.lit("keep")) != "delete")
    return joined.withColumn("key", F.when(F.col("d.action") == "fix", F.col("d.new_key")).otherwise(F.col("key"))).drop("d")


def without_last(df: DataFrame, order: str, n: int) -> DataFrame:
    """All rows but the last n by a unique, non-null order; none if there are no more than n. Only those n are gathered."""
    last = df.select(order).orderBy(F.desc(order)).limit(n)
    return df.join(F.broadcast(last), order, "left_anti")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a digest of their key and the seed: repeatable, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
