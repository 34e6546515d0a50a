"""Token, cost and size accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.keys import norm_key
from corpuslab.functions.text import collapse, tokens
from corpuslab.operators.quantiles import median_of
from corpuslab.operators.skew import current_rows, join_unique


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The frame itself; raises at once if a key occurs twice (the one-to-one rule of a dimension)."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} is not unique")
    return df


def count_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`(key, bytes, word, chars)` of every text; 0 for null."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, F.octet_length(t).cast("long").alias("bytes"), F.size(tokens(t, "word")).cast("long").alias("word"), F.length(t).cast("long").alias("chars"))


def cost_by_source(counts: DataFrame, metadata: DataFrame, total_rows: int) -> DataFrame:
    """Documents, tokens, mean and share per source type, of the current count and metadata of each document.

    Tokens are the subword counts where usable, else words times 1.33, half to even. Counts without metadata are
    reported under null.
    """
    now = current_rows(counts, norm_key(F.col("doc_id")), ["subword", "word", "loaded_at"])
    meta = current_rows(metadata, norm_key(F.col("doc_id")), ["source_type", "loaded_at"]).select("key", norm_key(F.col("source_type")).alias("source_type"))
    used = F.when(F.col("subword") > 0, F.col("subword")).otherwise(F.bround(F.col("word") * F.lit(1.33)).cast("long"))
    joined = join_unique(now.select("key", used.alias("tokens")), meta, "key", total_rows, "left")
    per = joined.groupBy("source_type").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.bround(F.avg("tokens")).cast("long").alias("mean_tokens"))
    total = per.agg(F.sum("tokens")).scalar()
    return per.withColumn("share", F.round(F.col("tokens") * 100.0 / total, 1))


def corpus_stats(docs: DataFrame, group: str, kind: str, text: str) -> DataFrame:
    """Documents, estimated tokens and the set of kinds per group, and of all together with a null group."""
    words = F.size(F.filter(F.split(collapse(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != ""))
    sized = docs.select(F.coalesce(F.col(group), F.lit("")).alias(group), F.col(kind).alias("_kind"), F.bround(words * F.lit(1.17)).cast("long").alias("_n"))
    out = sized.rollup(group).agg(F.count("*").alias("docs"), F.sum("_n").alias("tokens"), F.array_join(F.sort_array(F.collect_set("_kind")), ",").alias("kinds"))
    return out.withColumn("mean_tokens", F.bround(F.col("tokens") / F.col("docs"), 1))


def retrieval_saving(docs: DataFrame, text: str, records: int = 4, tokens_each: int = 300) -> DataFrame:
    """What a question costs with the whole corpus as context against a few records."""
    words = F.size(F.filter(F.split(collapse(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != ""))
    total = docs.agg(F.sum(F.bround(words * F.lit(1.17)).cast("long")).alias("full_tokens"), F.count("*").alias("n"))
    few = F.bround(F.col("full_tokens") / F.col("n") * records).cast("long")
    return total.select("full_tokens", few.alias("few_tokens"), F.lit(records * tokens_each).cast("long").alias("budget_tokens"), F.round(F.col("full_tokens") / few, 1).alias("ratio"))


def largest(df: DataFrame, key: str, value: str, n: int = 1) -> DataFrame:
    """The n rows of greatest value, the lower key first on ties."""
    return df.select(key, value).orderBy(F.desc(value), key).limit(n)


def length_profile(docs: DataFrame, group: str, text: str, short: int = 100, long: int = 2000) -> DataFrame:
    """Per group: count, median (cut to an integer), least and greatest length, and how many are short or long."""
    sized = docs.select(F.col(group).alias(group), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_n")).withColumn(group, F.coalesce(group, F.lit("")))
    per = sized.groupBy(group).agg(F.count("*").alias("docs"), F.min("_n").cast("long").alias("least"), F.max("_n").cast("long").alias("most"), F.count_if(F.col("_n") < short).alias("short"), F.count_if(F.col("_n") > long).alias("long"))
    mid = median_of(sized, [group], "_n").select(group, F.col("median").cast("long").alias("median"))
    return per.join(F.broadcast(mid), group)


def tokenizer_totals(counts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Per kind of token: sum, mean, least, greatest and the ratio of its sum to that of words."""
    pairs = ", ".join(f"'{k}', {k}" for k in kinds)
    long = counts.selectExpr(f"stack({len(kinds)}, {pairs}) as (kind, n)")
    words = counts.agg(F.sum("word")).scalar()
    out = long.groupBy("kind").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    return out.withColumn("to_words", F.round(F.col("total") / words, 3))


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """Counts per bin of a given width."""
    return df.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side whose key the right side lacks."""
    return left.join(right.select(key), key, "left_anti")


def join_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows before and after an inner join, and whether none was lost."""
    before = left.agg(F.count("*")).scalar()
    joined = left.select(F.col(left_key).alias("_k")).join(right.select(F.col(right_key).alias("_k")), "_k")
    return joined.agg(F.count("*").alias("rows_after")).withColumn("rows_before", before).withColumn("rows_match", F.col("rows_before") == F.col("rows_after"))
