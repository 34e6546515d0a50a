"""References to records that do not exist, per referring table and period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.keys import norm_key

#: A key with more than this fraction of all references is split over `SALTS` tasks; there are at most 1 / HOT of them.
HOT = 1 / 1000
SALTS = 64


def child_rows(table: DataFrame, ref_table: str, column: str, parent: str) -> DataFrame:
    """The references of one table in long form; blank and null keys refer to nothing and give no row."""
    return table.select(
        F.lit(parent).alias("parent"),
        norm_key(F.col(column)).alias("key"),
        F.lit(ref_table).alias("ref_table"),
        F.col("row_id").cast("long").alias("row_id"),
        F.col("loaded_at").alias("loaded_at"),
    ).filter("key is not null")


def parent_rows(table: DataFrame, key: Column, parent: str) -> DataFrame:
    """The keys of one parent table in long form with the times between which each row lived."""
    cols = [F.lit(parent).alias("parent"), norm_key(key).alias("key"), F.col("loaded_at").alias("loaded_at"), F.col("deleted_at").alias("deleted_at")]
    return table.select(*cols).filter("key is not null")


def suspect_groups(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Groups of the union of tagged parent and child keys in which some reference has no live parent.

    One aggregation with map-side combine over (parent table, key). A group is kept if it lacks the parent flag, or if
    its latest child is not before the end of all its parents, or its earliest child is before its first parent.
    """
    tagged = parents.select("parent", "key", F.lit(1).alias("is_parent"), F.col("loaded_at").alias("born"), "deleted_at", F.lit(None).cast("timestamp_ntz").alias("seen")).unionByName(
        children.select("parent", "key", F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.col("loaded_at").alias("seen"))
    )
    groups = tagged.groupBy("parent", "key").agg(
        F.sum("is_parent").alias("n_parents"),
        F.min("born").alias("born"),
        F.count("deleted_at").alias("n_deleted"),
        F.max("deleted_at").alias("died"),
        F.sum(1 - F.col("is_parent")).alias("n_children"),
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
    )
    dead = F.when(F.col("n_deleted") == F.col("n_parents"), F.col("died"))
    bad = (F.col("n_parents") == 0) | (F.col("born") > F.col("first_seen")) | (dead <= F.col("last_seen"))
    return groups.filter((F.col("n_children") > 0) & bad).select("parent", "key", "n_parents", "born", dead.alias("dead"), "n_children")


def orphan_references(children: DataFrame, parents: DataFrame, total: int, hot: float = HOT, salts: int = SALTS) -> DataFrame:
    """Every reference without a live parent: `(ref_table, row_id, ref_month, reason)`.

    `reason` is 'missing' if no parent row has the key, else 'late' if the first of them was loaded after the reference,
    else 'deleted' if all of them were deleted at or before its time. A reference without a time can only be 'missing'
    and has a null month; repeated rows come out as often as they went in. Only suspect groups join back to their
    references. `total` is the number of rows of the referring tables: keys above the `hot` fraction of it are at most
    1 / hot in number, so their list is broadcast, and both sides of the join are spread over `salts` values for them
    alone.
    """
    groups = suspect_groups(children, parents)
    limit = max(1000, int(total * hot))
    many = F.col("n_children") > limit
    salted = groups.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    marked = children
    if total > 1000:
        hot_keys = groups.filter(many).select("parent", "key", F.lit(True).alias("is_hot"))
        marked = marked.join(F.broadcast(hot_keys), ["parent", "key"], "left")
        marked = marked.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("row_id", "loaded_at"), F.lit(salts)).cast("int")).otherwise(0))
    else:
        marked = marked.withColumn("salt", F.lit(0))
    reason = (
        F.when(F.col("n_parents") == 0, "missing")
        .when(F.col("born") > F.col("loaded_at"), "late")
        .when(F.col("dead") <= F.col("loaded_at"), "deleted")
    )
    return (
        marked.join(salted.drop("n_children"), ["parent", "key", "salt"])
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select("ref_table", "row_id", F.date_format("loaded_at", "yyyy-MM").alias("ref_month"), "reason")
    )


def handbook_references(records: DataFrame, token_counts: DataFrame, metadata: DataFrame, questions: DataFrame) -> DataFrame:
    """Orphan references of the three referring tables of this engine's data model to `records`."""
    total = token_counts.count() + metadata.count() + questions.count()  # from Parquet footers
    children = [
        child_rows(token_counts, "token_counts", "doc_id", "doc"),
        child_rows(metadata, "metadata", "doc_id", "doc"),
        child_rows(questions, "questions_public", "document", "file"),
    ]
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    parents = parent_rows(records, F.col("doc_id"), "doc").unionByName(parent_rows(records, stem, "file"))
    return orphan_references(reduce(DataFrame.unionByName, children), parents, total)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references summed per referring table, month and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("n"))
