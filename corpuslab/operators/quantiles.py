"""Exact order statistics and global numbering without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the keys of a table to be numbered are cut.
PARTS = 200
#: Steps of the sketch that tells about where a position lies, and its accuracy, which is ten times as fine.
STEPS, ACCURACY = 1000, 10_000


def _range_of(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, by a balanced tree of comparisons (compiled, not a loop)."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _range_of(value, bounds[:mid], first)).otherwise(_range_of(value, bounds[mid + 1 :], first + mid + 1))


def order_statistics(df: DataFrame, group: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """`(*group, n, *positions)`: per group the values at 0-based positions of the sorted values, each given in terms of `n`.

    A sketch in steps of 1 / `STEPS` bounds each position from both sides, two steps away, well beyond its error of
    1 / `ACCURACY`. Values below the bounds are only counted, those between them, some thousandths of a group, are counted
    by value and walked in order. Groups are few (tasks, models, sources), so the bounds are a small table. Null values
    are left out; a group without values has no row.
    """
    named = df.select(*group, F.col(value).alias("_v")).filter("_v is not null")
    fractions = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    cuts = named.groupBy(*group).agg(F.percentile_approx("_v", fractions, F.lit(ACCURACY)).alias("_cuts"), F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in positions.items()])
    step = F.floor(F.col("_w.at") * STEPS / F.col("n")).cast("int")
    asked = cuts.select(*group, "n", "_cuts", F.explode(wanted).alias("_w"))
    low, high = F.when(step >= 2, F.get("_cuts", step - 2)), F.get("_cuts", step + 3)
    bounds = F.broadcast(asked.select(*group, "n", F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"), low.alias("_low"), high.alias("_high")))
    near = named.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), ["_one", *group])
    inside = near.filter(F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))).withColumn("_v", F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v")))
    counted = inside.groupBy(*group, "n", "_name", "_at", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*group, "_name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_end", F.sum("_c").over(order))
    chosen = ranked.filter((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c")))
    return chosen.groupBy(*group, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions])


def median_of(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """`(*group, n, name)`: the interpolated median per group."""
    n = F.col("n")
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    return order_statistics(df, group, value, {"_lo": low, "_hi": high}).select(*group, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def numbered(df: DataFrame, order: str, name: str, parts: int = PARTS) -> DataFrame:
    """Add the 1-based place of each row in the order of a column, over the whole table.

    A sample of the keys, at most `parts` of them, cuts the table into ranges; it decides only how even they are. The
    counts per range, at most `parts` rows, give each its offset. The key should be unique; equal keys are numbered in
    any order, and null keys come first.
    """
    keys = df.select(F.col(order).alias("_k")).filter("_k is not null").orderBy(F.xxhash64("_k")).limit(parts).distinct().orderBy("_k").collect()
    placed = df.withColumn("_b", F.when(F.col(order).isNull(), -1).otherwise(_range_of(F.col(order), [r[0] for r in keys])))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy(order)
    return placed.join(F.broadcast(offsets), "_b").withColumn(name, (F.col("_o") + F.row_number().over(inside)).cast("long")).drop("_b", "_o")
