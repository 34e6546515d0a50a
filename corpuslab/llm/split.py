"""Splitting oversized texts at natural boundaries, by lexical cohesion."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.skew import current_rows

_BLANK_LINES = re.compile(r"\n\s*\n")
_SENTENCES = re.compile(r"\n\s*\n|\n|(?<=[.!?])\s+")
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
LEVELS = (("paragraph", _BLANK_LINES), ("sentence", _SENTENCES), ("word", _SPACES))
SCHEMA = "doc_id string, cut_level string, piece_no int, start int, stop int, piece string, boundary string"


def starts(text: str, gaps: re.Pattern[str]) -> tuple[list[int], int]:
    """Where the pieces between gaps start, without the first, and the length of the longest piece."""
    at, longest, found = 0, 0, []
    for m in gaps.finditer(text):
        longest = max(longest, m.start() - at)
        at = m.end()
        found.append(at)
    return [x for x in found if 0 < x < len(text)], max(longest, len(text) - at)


def cut_level(text: str, limit: int) -> str:
    """The coarsest kind of boundary at which all pieces fit the limit."""
    return next((name for name, gaps in LEVELS if starts(text, gaps)[1] <= limit), "none")


def valley_depths(text: str, block: int) -> tuple[list[int], list[float]]:
    """Word starts of a text and, for each, how deep the valley of block similarity is there.

    The similarity of the `block` words before and after each word gap is the cosine of their counts, kept up to date
    word by word; the depth is the climb to the nearest peak on either side.
    """
    spans = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    words = [w for _, w in spans]
    n = len(words)
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    for w in words[:block]:
        right[w] = right.get(w, 0) + 1
    dot, ll, rr = 0, 0, sum(x * x for x in right.values())
    sims = [0.0] * n
    for g in range(n):
        sims[g] = dot / sqrt(ll * rr) if ll and rr else 0.0
        w = words[g]  # moves from the right block to the left
        a, b = left.get(w, 0), right[w]
        dot += (a + 1) * (b - 1) - a * b
        ll += 2 * a + 1
        rr -= 2 * b - 1
        left[w], right[w] = a + 1, b - 1
        if g >= block:  # leaves the left block
            w = words[g - block]
            a, b = left[w], right.get(w, 0)
            dot -= b
            ll -= 2 * a - 1
            left[w] = a - 1
        if g + block < n:  # enters the right block
            w = words[g + block]
            a, b = left.get(w, 0), right.get(w, 0)
            dot += a
            rr += 2 * b + 1
            right[w] = b + 1
    before, after = sims[:], sims[:]
    for g in range(1, n):
        before[g] = max(sims[g], before[g - 1]) if sims[g - 1] >= sims[g] else sims[g]
    for g in range(n - 2, -1, -1):
        after[g] = max(sims[g], after[g + 1]) if sims[g + 1] >= sims[g] else sims[g]
    return [s for s, _ in spans], [before[g] + after[g] - 2 * sims[g] for g in range(n)]


def split_text(text: str, limit: int = 1200, overlap: int = 160, block: int = 30) -> tuple[str, list[tuple[int, int]]]:
    """Cut level and `(start, stop)` of the pieces of a text over the limit."""
    level, pieces = split_pieces(text, limit, overlap, block)
    return level, [(a, b) for a, b, _ in pieces]


def split_pieces(text: str, limit: int = 1200, overlap: int = 160, block: int = 30) -> tuple[str, list[tuple[int, int, str]]]:
    """Cut level and `(start, stop, boundary)` of the pieces of a text over the limit.

    Each piece but the first starts at a word about `overlap` characters before the end of the one before; within the
    window that is left the boundary with the deepest cohesion valley in its last two thirds is taken, the last one on
    ties. The valley of a boundary is that of the next word, since what follows may start with a mark. Where no boundary
    of the text's own level lies in the window (a paragraph close to the limit leaves no room for the overlap) the next
    finer level is used, and only a run without white space is cut anywhere; `boundary` says at what the piece ends.
    """
    level = cut_level(text, limit)
    names = [name for name, _ in LEVELS]
    first = names.index(level) if level in names else len(names) - 1
    places, depths = valley_depths(text, block)

    def depth(at: int) -> float:
        i = bisect_left(places, at)
        return depths[i] if i < len(places) else 0.0

    bounds = [starts(text, gaps)[0] for _, gaps in LEVELS[first:]]
    cursor = [0] * len(bounds)
    spans: list[tuple[int, int, str]] = []
    begin, done, size = 0, 0, len(text)
    while size - begin > limit:
        low, high, cut, kind = max(done + 1, begin + limit // 3), begin + limit, 0, "none"
        for k, at in enumerate(bounds):
            while cursor[k] < len(at) and at[cursor[k]] <= done:
                cursor[k] += 1
            inside = at[cursor[k] : bisect_left(at, high + 1, cursor[k])]
            late = inside[bisect_left(inside, low) :]
            if late:
                cut = max(late, key=lambda x: (depth(x), x))
            elif inside:
                cut = inside[-1]
            if cut:
                kind = names[first + k]
                break
        cut = cut or high
        spans.append((begin, cut, kind))
        done = cut
        want = cut - overlap
        space = _SPACES.search(text, max(begin + 1, want - overlap // 4), max(begin + 1, min(cut, want + overlap // 4)))
        begin = max(begin + 1, space.end() if space else want)
    spans.append((begin, size, "end"))
    return level, spans


def split_oversized(records: DataFrame, limit: int = 1200, overlap: int = 160, block: int = 30) -> DataFrame:
    """Pieces `(doc_id, cut_level, piece_no, start, stop, piece, boundary)` of the current records whose text exceeds the limit.

    `cut_level` is the coarsest boundary at which all pieces could fit, `boundary` that at which the piece ends. Lengths and positions are in characters. Only oversized texts reach Python; null and short texts have no rows.
    """
    current = current_rows(records, F.col("doc_id"), ["text"]).filter(F.length("text") > limit).withColumnRenamed("key", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "cut_level", "piece_no", "start", "stop", "piece", "boundary"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                level, spans = split_pieces(text, limit, overlap, block)
                rows.extend((doc_id, level, i, a, b, text[a:b], kind) for i, (a, b, kind) in enumerate(spans, 1))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return current.mapInPandas(run, SCHEMA)
