"""Token counts of records under an existing tokenizer, and the checks and totals built on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.keys import norm_key
from corpuslab.llm.units import units
from corpuslab.operators.skew import current_rows, join_unique

#: Units above this fraction of all unit occurrences are broadcast with their lengths; there are at most 1 / HOT of them.
HOT = 1 / 50_000


def piece_count(unit: str, pieces: frozenset[str], longest: int) -> int:
    """Tokens of one unit: from left to right the longest known piece, else one character."""
    n, at, size = 0, 0, len(unit)
    while at < size:
        step = 1
        for width in range(min(longest, size - at), 1, -1):
            if unit[at : at + width] in pieces:
                step = width
                break
        at += step
        n += 1
    return n


def unit_lengths(distinct_units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add `length`, the tokens of each unit; each distinct unit is tokenized once, in Arrow batches.

    The vocabulary is the fixed table of an existing tokenizer; it is read once on the driver and sent with the task.
    """
    pieces = frozenset(r.piece for r in vocabulary.select("piece").filter("piece is not null").distinct().collect())
    longest = max(map(len, pieces), default=1)

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda u: piece_count(u, pieces, longest)).astype("int64")

    return distinct_units.withColumn("length", length("unit"))


def record_tokens(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`(key, tokens, source_type, lang, topic)` of the current record of each key (`doc_id` without case and spaces).

    Distinct units are counted and tokenized once. The units of each record are then counted once: lengths of units above
    a fixed fraction of all occurrences are broadcast and summed where the text is, one row a record, and only the
    document frequencies of rarer units move to meet their lengths. A null or empty text has 0 tokens.
    """
    current = current_rows(records, norm_key(F.col("doc_id")), ["text", "source_type", "lang", "topic"])
    each = current.select("key", F.explode(units(F.col("text"))).alias("unit"))
    counted = each.groupBy("unit").agg(F.count("*").alias("n"))
    limit = F.coalesce(counted.agg(F.sum("n")).scalar(), F.lit(0)) * F.lit(HOT)
    lengths = unit_lengths(counted, vocabulary)
    hot = F.broadcast(lengths.filter(F.col("n") > limit).select("unit", F.col("length").alias("_hot")))
    cold = lengths.filter(F.col("n") <= limit).select("unit", "length")
    marked = each.join(hot, "unit", "left")
    # what is known at once is kept under the record's own key, which is no unit, so that it meets no length and no other record
    met = F.when(F.col("_hot").isNull(), F.col("unit")).otherwise(F.concat(F.lit(" "), "key"))
    freq = marked.groupBy("key", met.alias("unit")).agg(F.count("*").alias("f"), F.sum("_hot").alias("_hot"))
    sums = freq.join(cold, "unit", "left").select("key", F.coalesce("_hot", F.col("f") * F.col("length")).alias("tokens"))
    facts = current.select("key", F.lit(0).cast("long").alias("tokens"), "source_type", "lang", "topic")
    parts = facts.unionByName(sums, allowMissingColumns=True)
    return parts.groupBy("key").agg(F.sum("tokens").alias("tokens"), *[F.max(x).alias(x) for x in ("source_type", "lang", "topic")])


def unusable_counts(token_counts: DataFrame, totals: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """`row_id` of the published counts of known records that are missing, not positive or off by more than `tolerance`.

    Counts whose key is blank, null or without a record are no matter of this operator; repeated rows come out each
    under its own `row_id`.
    """
    published = token_counts.select("row_id", norm_key(F.col("doc_id")).alias("key"), "subword").filter("key is not null")
    joined = join_unique(published, totals.select("key", "tokens"), "key", token_counts.count())
    off = F.abs(F.col("subword") - F.col("tokens")) > tolerance * F.col("tokens")
    return joined.filter(F.col("subword").isNull() | (F.col("subword") <= 0) | off).select("row_id")


def token_totals(totals: DataFrame, official: DataFrame) -> DataFrame:
    """Documents and tokens per official source type, language and topic.

    Spellings of a source type meet without case and outer spaces in the official table (a fixed handful of rows); other
    and missing values are reported as 'unknown'.
    """
    names = F.broadcast(official.select(norm_key(F.col("source_type")).alias("_key"), F.col("source_type").alias("_name")).dropDuplicates(["_key"]))
    known = totals.join(names, norm_key(F.col("source_type")) == F.col("_key"), "left")
    cols = [F.coalesce("_name", F.lit("unknown")).alias("source_type"), *[F.coalesce(norm_key(F.col(x)), F.lit("unknown")).alias(x) for x in ("lang", "topic")]]
    return known.groupBy(*cols).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
