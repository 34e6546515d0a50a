"""Joins of a many-row side to a side with unique keys that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(table: DataFrame, key: Column, columns: list[str], order: str = "loaded_at") -> DataFrame:
    """The latest row of each key as `(key, *columns)`: one aggregation with map-side combine, no window over raw rows.

    Rows with a null key are no record and are dropped. Among rows of equal `order` (repeated deliveries) the greatest
    by the other columns is taken, so the result does not depend on row order; a null `order` is the earliest.
    """
    rest = [c for c in columns if c != order]
    picked = F.max(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in rest])).alias("_row")
    out = [F.col("_row._order").alias(order)] if order in columns else []
    named = table.select(key.alias("key"), order, *rest).filter("key is not null")
    return named.groupBy("key").agg(picked).select("key", *out, *[F.col(f"_row.{c}") for c in rest])


def join_hot_cold(rows: DataFrame, facts: DataFrame, key: str, is_hot: Column) -> DataFrame:
    """Inner join of `rows` to `facts` (unique by `key`) in which hot facts are broadcast and only cold rows move.

    `is_hot` must hold for a provably bounded number of facts, such as keys above a fixed fraction of all rows; it must
    not be null. Cold keys are by definition too rare to unbalance the shuffle.
    """
    hot = F.broadcast(facts.filter(is_hot))
    cold = facts.filter(~is_hot)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(facts.filter(is_hot).select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def join_unique(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner", hot: float = 1 / 1000, salts: int = 64) -> DataFrame:
    """Join of `rows` to `facts` (unique by `key`), with keys above the `hot` fraction of `total` rows salted.

    There are at most 1 / hot such keys, so their list is broadcast. Below 100,000 rows nothing is worth salting.
    """
    if total < 100_000:
        return rows.join(facts, key, how)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > int(total * hot))
    keys = counts.select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(salts)).cast("int")).otherwise(0)
    marked = rows.join(F.broadcast(keys), key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = facts.join(F.broadcast(keys), key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return marked.join(spread, [key, "_salt"], how).drop("_salt")
