"""Evaluation passages that stand in training documents, by suffix arrays of document shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[a-z0-9]+")
SCHEMA = "item_id long, doc_id long, words int, item_start int, doc_start int"


class Suite:
    """The suffixes of all evaluation items as rows of word numbers; word 0 stands for every word not in them."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.number: dict[str, int] = {}
        self.least = least
        ids, suffixes, owner, at = [], [], [], []
        self.longest = least
        for item_id, text in items:
            words = _WORDS.findall((text or "").lower())
            row = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            self.longest = max(self.longest, len(row))
            for i in range(len(row) - least + 1):
                suffixes.append(row[i : i + least])
                owner.append(len(ids))
                at.append(i)
            ids.append(item_id)
        self.ids = np.array(ids, np.int64)
        self.suffixes = np.array(suffixes, np.int32).reshape(-1, least)
        self.owner, self.at = np.array(owner, np.int64), np.array(at, np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in lexicographic order of their first `depth` words, by prefix doubling."""
    n = len(words)
    rank = words.astype(np.int64) + 1
    width = 1
    while width < depth:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] if width < n else 0
        _, rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        width *= 2
        if int(rank.max()) == n:
            break
    return np.argsort(rank, kind="stable")


def _bound(words: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each wanted row of words the first place in the suffix array not before it (`upper`: after it)."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    steps = np.arange(wanted.shape[1])
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        there = words[order[np.where(open_, mid, 0)][:, None] + steps]
        differs = there != wanted
        at = differs.argmax(1)
        rows = np.arange(len(wanted))
        same = ~differs[rows, at]
        right = np.where(same, upper, there[rows, at] < wanted[rows, at])
        lo = np.where(open_ & right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def shard_matches(doc_ids: list[int], texts: list[str], suite: Suite) -> list[tuple[int, int, int, int, int]]:
    """Longest verbatim match of every (item, document) of a shard that share at least `suite.least` words."""
    number, least = suite.number, suite.least
    parts, owner_at = [], [0]
    for text in texts:
        words = _WORDS.findall(text.lower())
        parts.append(np.fromiter((number.get(w, 0) for w in words), np.int32, len(words)))
        parts.append(np.zeros(least, np.int32))  # no match reaches over the end of a document
        owner_at.append(owner_at[-1] + len(words) + least)
    if not parts or not len(suite.suffixes):
        return []
    words = np.concatenate(parts)
    n = len(words) - least
    order = suffix_array(words, suite.longest)
    order = order[order <= n]
    lo, hi = _bound(words, order, suite.suffixes, False), _bound(words, order, suite.suffixes, True)
    counts = hi - lo
    if not counts.any():
        return []
    suffix = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(suffix)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = order[lo[suffix] + offset]
    ends = np.array(owner_at)
    doc = np.searchsorted(ends, place, side="right") - 1
    item, item_at = suite.owner[suffix], suite.at[suffix]
    diagonal = place - item_at
    by = np.lexsort((item_at, diagonal, item, doc))
    item, doc, item_at, place, diagonal = item[by], doc[by], item_at[by], place[by], diagonal[by]
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(diagonal) != 0) | (np.diff(item_at) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(by))) + least - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for f, size in zip(first.tolist(), length.tolist(), strict=True):
        pair = (int(suite.ids[item[f]]), doc_ids[doc[f]])
        if size > best.get(pair, (0, 0, 0))[0]:
            best[pair] = (size, int(item_at[f]), int(place[f] - ends[doc[f]]))
    return [(*pair, *found) for pair, found in best.items()]


#: Characters of items whose suffixes go to the tasks together; each takes about 10 bytes there.
SUITE_CHARS = 20_000_000


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 8, shard_chars: int = 3_000_000, suite_chars: int = SUITE_CHARS) -> DataFrame:
    """`(item_id, doc_id, words, item_start, doc_start)`: the longest run of words an item shares with a document.

    Words are maximal runs of a-z and 0-9 in the lower-cased text; runs under `least` words do not count. Each task
    joins its documents into shards of about `shard_chars` characters, builds a suffix array of each and binary-searches
    every suffix of every item in it; documents do not move. The items are the held-out set of an evaluation and go to
    the tasks with the code, in blocks by a hash of their id if they have more than `suite_chars` characters; the
    documents are then read once for each block. Null and blank texts match nothing; null ids are dropped.
    """
    known = items.select("item_id", "text").filter("item_id is not null and text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // suite_chars) or 1
    usable = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")

    def searched(rows: list) -> DataFrame:
        suite = Suite([(r.item_id, r.text) for r in rows], least)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["item_id", "doc_id", "words", "item_start", "doc_start"]
            ids: list[int] = []
            texts: list[str] = []
            size = 0
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size >= shard_chars:
                        yield pd.DataFrame(shard_matches(ids, texts, suite), columns=names)
                        ids, texts, size = [], [], 0
            yield pd.DataFrame(shard_matches(ids, texts, suite), columns=names)

        return usable.mapInPandas(run, SCHEMA)

    if blocks == 1:
        return searched(known.collect())
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [searched(known.filter(block == i).collect()) for i in range(blocks)])


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that share no passage with any item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def leaks_by_item(items: DataFrame, leaks: DataFrame) -> DataFrame:
    """For every item the number of documents that hold part of it and the longest match, 0 where there is none."""
    found = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("words").alias("words"))
    kept = items.select("item_id").distinct().join(found, "item_id", "left")
    return kept.select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
