"""Conversations, call logs and repeated runs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.quantiles import median_of, order_statistics

#: Positions that are summed in one task when a conversation is long.
SPAN = 10_000


def running_totals(df: DataFrame, key: str, position: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Add the total of a value up to and with each row of its group, for dense integer positions.

    Groups are cut into spans of positions; totals of spans give offsets, so that a long group is spread over tasks.
    """
    cut = df.withColumn("_span", F.floor(F.col(position) / span))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(key, "_span").agg(F.sum(value).alias("_s")).select(key, "_span", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, "_span").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [key, "_span"]).withColumn(name, F.col("_o") + F.sum(value).over(inside)).drop("_span", "_o")


def trim_chats(messages: DataFrame, budget: int, key: str = "conv_id", position: str = "turn", tokens: str = "tokens") -> DataFrame:
    """The messages that stay when the oldest pairs after the first are dropped until a chat fits its budget.

    The first message always stays; pairs are dropped while the rest is over budget and has more than three messages. In
    closed form: the least m with total - tokens of the m oldest pairs <= budget or length - 2m <= 3. Positions are dense
    from 0 in each chat.
    """
    run = running_totals(messages, key, position, tokens, "_run")
    facts = run.groupBy(key).agg(F.max("_run").alias("_total"), F.count("*").alias("_len"), F.sum(F.when(F.col(position) == 0, F.col(tokens)).otherwise(0)).alias("_first"))
    # dropping m pairs leaves total - (running total at position 2m - first); each even position gives an m
    joined = run.join(facts, key)
    m = F.floor(F.col(position) / 2)
    even = F.col(position) % 2 == 0
    fits = (F.col("_total") - (F.col("_run") - F.col("_first")) <= budget) | (F.col("_len") - 2 * m <= 3)
    least = joined.filter(even & fits).groupBy(key).agg(F.min(m).alias("_m"))
    kept = joined.join(least, key, "left").filter((F.col(position) == 0) | (F.col(position) > 2 * F.coalesce("_m", F.lit(0))))
    return kept.select(*messages.columns)


def latency_summary(calls: DataFrame, task: str, seconds: str, tokens_in: Column, tokens_out: Column, ok: Column, rate: float = 3.0) -> DataFrame:
    """Per task: calls, median, p95, token sums, tokens per second, failures and price of a thousand calls.

    p95 is the element at round(0.95 * (n - 1)) of the sorted times, half to even, not an interpolation.
    """
    n = F.col("n")
    stats = order_statistics(calls, [task], seconds, {"lo": F.floor((n - 1) / 2), "hi": F.ceil((n - 1) / 2), "p95": F.bround(F.lit(0.95) * (n - 1))})
    named = calls.select(task, F.col(seconds).alias("_s"), tokens_in.alias("_i"), tokens_out.alias("_o"), ok.alias("_ok"))
    sums = named.groupBy(task).agg(F.count("*").alias("calls"), F.sum("_i").alias("tokens_in"), F.sum("_o").alias("tokens_out"), F.count_if(~F.col("_ok")).alias("failures"), F.sum("_s").alias("_total"))
    joined = sums.join(F.broadcast(stats), task)
    return joined.select(
        task, "calls", F.round((F.col("lo") + F.col("hi")) / 2, 2).alias("median_s"), F.round("p95", 2).alias("p95_s"), "tokens_in", "tokens_out",
        F.when(F.col("_total") > 0, F.round(F.col("tokens_out") / F.col("_total"), 1)).otherwise(0.0).alias("tok_s"), "failures",
        F.round(F.col("tokens_in") / 1e6 * rate * (1000 / F.greatest("calls", F.lit(1))), 4).alias("per_1k_usd"),
    )


def scorecard(cases: DataFrame, model: str = "model") -> DataFrame:
    """Per model: cases passed of each kind as `ok/total`, median seconds, and median tokens per second without zeros."""
    mid = median_of(cases, [model], "seconds", "median_s").select(model, F.round("median_s", 2).alias("median_s"))
    speed = median_of(cases.filter("tok_s > 0"), [model], "tok_s", "tok_s").select(model, F.round("tok_s", 1).alias("tok_s"))

    def of(kind: str) -> Column:
        own = F.col("kind") == kind
        return F.concat(F.count_if(own & F.col("ok")).cast("string"), F.lit("/"), F.count_if(own).cast("string")).alias(kind)

    return cases.groupBy(model).agg(of("grounded"), of("refusal")).join(F.broadcast(mid), model, "left").join(F.broadcast(speed), model, "left")


def similarity(a: str, b: str) -> float:
    """Ratio of matching characters of two texts."""
    return SequenceMatcher(None, a, b).ratio()


def repeat_stats(runs: DataFrame, keys: list[str], answer: str, most: int = 1000) -> DataFrame:
    """Per group of repeated runs: runs, distinct answers, mean pairwise similarity, mean and sample deviation of length.

    Each group is the few repetitions of one call, all compared with each other; more than `most` in one group is an
    error, not a case to cut. `label` says 'deterministic', 'stable' (mean similarity of 0.9 or more) or 'noisy'.
    """
    kinds = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf[answer].fillna("").tolist()
        if len(texts) > most:
            raise ValueError(f"{len(texts)} repetitions of one call")
        pairs = [similarity(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
        sizes = pd.Series([len(t) for t in texts])
        mean, unique = sum(pairs) / len(pairs) if pairs else 1.0, len(set(texts))
        label = "deterministic" if unique == 1 else "stable" if mean >= 0.9 else "noisy"
        row = [*[pdf[k].iloc[0] for k in keys], len(texts), unique, round(mean, 6), float(sizes.mean()), float(sizes.std()) if len(texts) > 1 else 0.0, label]
        return pd.DataFrame([row], columns=[*keys, "runs", "unique", "similarity", "mean_len", "stdev_len", "label"])

    return runs.select(*keys, answer).groupBy(*keys).applyInPandas(one, f"{kinds}, runs long, unique long, similarity double, mean_len double, stdev_len double, label string")


def pair_counts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs per group, by formula."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def grounding_cost(pairs: DataFrame, grounded: str, plain: str) -> DataFrame:
    """Prompt tokens that grounding adds, summed over all questions."""
    return pairs.agg(F.sum(F.col(grounded) - F.col(plain)).alias("extra_tokens"), F.count("*").alias("questions"))


