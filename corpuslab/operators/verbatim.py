"""Verbatim runs of a reference text in other texts, and what must not be published."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import secret_flags, squash_alnum, tokens

#: A hit has at least so many squashed characters.
MIN_CHARS = 40
#: A reference with fewer squashed characters is taken for a mistake.
MIN_REFERENCE = 10_000
#: A reference with more characters is not broadcast (its grams take about 20 bytes a character).
MOST_REFERENCE = 20_000_000


def word_windows(docs: DataFrame, key: str, text: str, words: int = 8, chars: int = MIN_CHARS) -> DataFrame:
    """`(key, start, window)`: squashed runs of `words` leak tokens of at least `chars` characters."""
    listed = docs.select(key, tokens(F.col(text), "leak").alias("_w")).filter(F.size("_w") >= words)
    starts = F.sequence(F.lit(0), F.size("_w") - words)
    each = listed.select(key, "_w", F.explode(starts).alias("start"))
    squashed = squash_alnum(F.concat_ws(" ", F.slice("_w", F.col("start") + 1, words)))
    return each.select(key, "start", squashed.alias("window")).filter(F.length("window") >= chars)


def reference_grams(reference: DataFrame, ref_id: str, text: str, chars: int = MIN_CHARS) -> DataFrame:
    """`(gram, ref_id, at)`: every run of `chars` squashed characters of each reference text, as a 64-bit hash, and where it starts."""
    flat = reference.select(ref_id, squash_alnum(F.col(text)).alias("_ref")).filter(F.length("_ref") >= chars)
    each = flat.select(ref_id, "_ref", F.explode(F.sequence(F.lit(1), F.length("_ref") - chars + 1)).alias("at"))
    return each.select(F.xxhash64(F.substring("_ref", F.col("at"), F.lit(chars))).alias("gram"), ref_id, "at")


def _reference_size(reference: DataFrame, text: str) -> int:
    return reference.agg(F.sum(F.length(text))).first()[0] or 0


def window_places(docs: DataFrame, reference: DataFrame, key: str, text: str, ref_id: str, ref_text: str, words: int = 8) -> DataFrame:
    """`(key, start, ref_id, at)`: windows of the documents and the places in the reference texts where they stand.

    An exact rewriting of the containment join: a hit has at least `MIN_CHARS` squashed characters, so its first
    `MIN_CHARS` are a gram of the reference; the equi join on hashed grams is verified on the whole window against the
    reference's one row. The size of the reference is checked: up to `MOST_REFERENCE` characters its grams and texts are
    broadcast and the documents never move; a larger one is joined by shuffle.
    """
    small = _reference_size(reference, ref_text) <= MOST_REFERENCE
    near = F.broadcast if small else (lambda df: df)
    grams = near(reference_grams(reference, ref_id, ref_text))
    whole = near(reference.select(F.col(ref_id).alias("_id"), squash_alnum(F.col(ref_text)).alias("_ref")))
    each = word_windows(docs, key, text, words).withColumn("gram", F.xxhash64(F.substring("window", 1, MIN_CHARS)))
    found = each.join(grams, "gram").join(whole, F.col(ref_id) == F.col("_id"))
    stands = F.substring("_ref", F.col("at"), F.length("window")) == F.col("window")
    return found.filter(stands).select(key, "start", ref_id, "at")


def window_hits(docs: DataFrame, reference: DataFrame, key: str, text: str, ref_id: str, ref_text: str, words: int = 8) -> DataFrame:
    """`(key, start, ref_id)`: windows of the documents that stand in a reference text."""
    return window_places(docs, reference, key, text, ref_id, ref_text, words).drop("at").distinct()


def greedy_runs(docs: DataFrame, reference: DataFrame, key: str, text: str, ref_id: str, ref_text: str, words: int = 8) -> DataFrame:
    """`(key, start, stop, run)`: the maximal, non-overlapping verbatim runs, found from left to right.

    A run stands within one reference text. Raises if the reference is too small to be one. The places of all windows are
    joined first, so that only texts with a hit are walked and only what follows a known place is compared, word by word;
    the walk is sequential within a text and runs in Python. The reference texts go to the tasks, so their size is checked.
    """
    import re

    rows = reference.select(ref_id, squash_alnum(F.col(ref_text)).alias("ref")).filter(f"{ref_id} is not null and ref is not null")
    size = _reference_size(reference, ref_text)
    if size > MOST_REFERENCE:
        raise ValueError(f"the reference has {size} characters; walk it in parts of at most {MOST_REFERENCE}")
    refs = {r[0]: r[1] for r in rows.collect()}
    if sum(map(len, refs.values())) < MIN_REFERENCE:
        raise ValueError(f"the reference has only {sum(map(len, refs.values()))} characters")
    word = re.compile(r"[A-Za-z0-9$][A-Za-z0-9$'/.-]*")
    drop = re.compile(r"[^a-z0-9]+")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, start int, stop int, run string"

    def stops(flat: list[str], first: int, ref: str, at: int) -> int:
        """How far the words from `first` on go on standing in the reference from a place."""
        i = first
        while i < len(flat) and ref.startswith(flat[i], at):
            at += len(flat[i])
            i += 1
        return i

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, places in zip(batch[key], batch[text], batch["_places"], strict=True):
                ws = word.findall(t)
                flat = [drop.sub("", w.lower()) for w in ws]
                known: dict[int, list[tuple]] = {}
                for p in places:
                    known.setdefault(p["start"], []).append((p["ref"], p["at"] - 1))
                done = 0
                for start in sorted(known):
                    if start >= done:
                        done = max(stops(flat, start, refs[r], at) for r, at in known[start])
                        out.append((k, start, done, " ".join(ws[start:done])))
            yield pd.DataFrame(out, columns=[key, "start", "stop", "run"])

    found = window_places(docs.select(key, text), reference, key, text, ref_id, ref_text, words)
    grouped = found.groupBy(key).agg(F.collect_set(F.struct("start", F.col(ref_id).alias("ref"), "at")).alias("_places"))
    return docs.select(key, text).join(grouped, key).mapInPandas(run, schema)


def secret_scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts in which something that must not be published occurs, with a flag per kind."""
    flags = secret_flags(F.col(text))
    marked = docs.select(key, *[c.alias(n) for n, c in flags.items()])
    return marked.filter(" or ".join(flags))


def denied_paths(paths: DataFrame, column: str, rules: dict[str, str]) -> DataFrame:
    """`(path, rule)` of paths that match a deny rule, a name and a pattern each."""
    hits = F.array(*[F.when(F.col(column).rlike(p), F.lit(name)) for name, p in rules.items()])
    return paths.select(column, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule"))
