"""Ranking records for questions: term index, BM25, saturated TF-IDF, exact vector search, rank fusion."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import tokens


def token_relation(docs: DataFrame, key: str, text: str, tokenizer: str = "rank") -> DataFrame:
    """`(key, dl, term)` with one row per token occurrence; null texts have no rows and length 0."""
    listed = docs.select(F.col(key), tokens(F.col(text), tokenizer).alias("_t"))
    return listed.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))


def doc_lengths(docs: DataFrame, key: str, text: str, tokenizer: str = "rank") -> DataFrame:
    """`(key, dl)` of every record, 0 for null and empty texts."""
    return docs.select(key, F.coalesce(F.size(tokens(F.col(text), tokenizer)), F.lit(0)).cast("long").alias("dl"))


def term_frequencies(docs: DataFrame, key: str, text: str, tokenizer: str = "rank") -> DataFrame:
    """`(key, dl, term, f)`: how often a term stands in a record."""
    return token_relation(docs, key, text, tokenizer).groupBy(key, "dl", "term").agg(F.count("*").alias("f"))


def query_terms(queries: DataFrame, qid: str, text: str, tokenizer: str = "rank") -> DataFrame:
    """`(qid, term, qf)`: repeated terms of a query count repeatedly."""
    return token_relation(queries, qid, text, tokenizer).groupBy(qid, "term").agg(F.count("*").alias("qf"))


class TermIndex:
    """The postings of the terms of a fixed set of queries and the statistics of the whole collection.

    The queries are a stated evaluation set; their terms are broadcast and cut the postings before anything is shuffled,
    while the number of records, their mean length and document frequencies still cover the whole collection.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", qid: str = "qid", query: str = "query", tokenizer: str = "rank") -> None:
        self.key, self.qid, self.text, self.tokenizer = key, qid, text, tokenizer
        self.docs = docs.select(key, text).filter(F.col(key).isNotNull())
        self.queries = query_terms(queries, qid, query, tokenizer)
        wanted = F.broadcast(self.queries.select("term").distinct())
        each = token_relation(self.docs, key, text, tokenizer).join(wanted, "term", "left_semi")
        self.postings = each.groupBy(key, "dl", "term").agg(F.count("*").alias("f"))
        self.df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.lengths = doc_lengths(self.docs, key, text, tokenizer).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        self.n, self.avgdl = self.lengths.select("n").scalar(), self.lengths.select("avgdl").scalar()

    def _sum(self, weight: Column) -> DataFrame:
        facts = self.queries.join(self.df, "term")
        matched = self.postings.join(F.broadcast(facts), "term")
        return matched.groupBy(self.qid, self.key).agg(F.sum(F.col("qf") * weight).alias("score"))

    def top(self, k: int, kind: str = "bm25", zeros: bool = True, lower_first: bool = True, scope: tuple[DataFrame, DataFrame] | None = None, k1: float = 1.5, b: float = 0.75, cap: int = 3) -> DataFrame:
        """`(qid, key, score, rank)` of the k best records of every query, the same as ranking all scores of `bm25` or `saturated_tfidf`.

        The query terms with their document frequencies, a table no larger than the query set, go to the records. There
        records and queries meet in blocks as matrices, and only the k best of each block for each query leave the task.
        With `zeros`, records without any term of a query fill up its places. `scope` are `(key, text, scope)` of all records
        and `(qid, scope)` of the queries: a query that names a scope meets only records of it.
        """
        asked = self.queries.collect()
        distinct = self.docs.select(F.explode(F.array_distinct(tokens(F.col(self.text), self.tokenizer))).alias("term"))
        df = {r["term"]: r["df"] for r in distinct.join(F.broadcast(self.queries.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
        facts = self.lengths.first()
        n, mean = facts["n"], max(facts["avgdl"] or 0.0, 1.0)
        qids = sorted({r[self.qid] for r in asked})
        at = {q: i for i, q in enumerate(qids)}
        number = {t: i for i, t in enumerate(sorted(df))}
        width = max(len(number), 1)
        idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(df)] or [0.0])
        weights = np.zeros((width, len(qids)))
        for r in asked:
            if r["term"] in number:
                weights[number[r["term"]], at[r[self.qid]]] += r["qf"]
        named = {r[0]: r[1] for r in scope[1].select(self.qid, "scope").collect()} if scope else {}
        wanted = np.array([named.get(q) for q in qids], object)
        rows, scoped = max(16, 2_000_000 // width), scope is not None
        names = [self.qid, self.key, "score"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for a in range(0, len(batch), rows):
                    part = batch.iloc[a : a + rows].sort_values("_key", ascending=lower_first)
                    terms = [[number[t] for t in x if t in number] if x is not None else [] for x in part["_terms"]]
                    flat = np.repeat(np.arange(len(part)), [len(x) for x in terms]) * width + np.array([t for x in terms for t in x], np.int64)
                    f = np.bincount(flat, minlength=len(part) * width).reshape(len(part), width).astype(np.float64)
                    if kind == "bm25":
                        dl = np.array([0 if x is None else len(x) for x in part["_terms"]])
                        f = f * (k1 + 1) / (f + k1 * (1 - b + b * dl / mean)[:, None])
                    else:
                        f = np.minimum(f, cap)
                    scores = (f * idf) @ weights
                    rounded = np.round(scores, 6)
                    if not zeros:
                        rounded[scores <= 0] = -np.inf
                    if scoped:
                        held = part["_scope"].to_numpy(object)
                        rounded[np.array([x is not None for x in wanted])[None, :] & (held[:, None] != wanted[None, :])] = -np.inf
                    best = np.argsort(-rounded, axis=0, kind="stable")[:k]
                    kept = np.take_along_axis(rounded, best, 0) > -np.inf
                    keys = part["_key"].to_numpy()
                    yield pd.DataFrame({names[0]: np.tile(np.array(qids, object), len(best))[kept.ravel()], names[1]: keys[best].ravel()[kept.ravel()], "score": np.take_along_axis(scores, best, 0).ravel()[kept.ravel()]})

        kinds = f"{self.qid} {self.queries.schema[self.qid].dataType.simpleString()}, {self.key} {self.docs.schema[self.key].dataType.simpleString()}, score double"
        listed = self.docs.select(F.col(self.key).alias("_key"), tokens(F.col(self.text), self.tokenizer).alias("_terms"))
        if scope:
            listed = self.scoped_docs(scope[0])
        return top_k(listed.mapInPandas(run, kinds), k, self.qid, self.key, lower_first)

    def scoped_docs(self, scopes: DataFrame) -> DataFrame:
        """`(_key, _terms, _scope)` of records that hold their scope themselves: `scopes` has the columns key, text and scope."""
        return scopes.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("_key"), tokens(F.col(self.text), self.tokenizer).alias("_terms"), F.col("scope").alias("_scope"))

    def idf(self) -> Column:
        return F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def bm25(self, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """`(qid, key, score)` of all records that share a term with a query."""
        norm = 1 - b + b * F.col("dl") / F.greatest(self.avgdl, F.lit(1.0))
        return self._sum(self.idf() * F.col("f") * (k1 + 1) / (F.col("f") + k1 * norm))

    def saturated_tfidf(self, cap: int = 3) -> DataFrame:
        """The same with term frequencies cut at `cap` and no length normalisation."""
        return self._sum(self.idf() * F.least("f", F.lit(cap)))

    def padded(self, scores: DataFrame, k: int) -> DataFrame:
        """Scores with enough records of score 0 for every query to have k records; the lowest keys come first."""
        first = [r[0] for r in self.docs.select(self.key).distinct().orderBy(self.key).limit(2 * k).collect()]
        if not first:
            return scores
        empty = self.queries.select(self.qid).distinct().select(self.qid, F.explode(F.array(*[F.lit(x) for x in first])).alias(self.key), F.lit(0.0).alias("score"))
        return scores.unionByName(empty).groupBy(self.qid, self.key).agg(F.max("score").alias("score"))


def top_k(scores: DataFrame, k: int, qid: str = "qid", key: str = "doc_id", lower_first: bool = True, digits: int = 6) -> DataFrame:
    """`(qid, key, score, rank)` of the k best per query; scores tie after rounding, then the lower or higher key is first."""
    tie = F.asc(key) if lower_first else F.desc(key)
    order = Window.partitionBy(qid).orderBy(F.desc("score"), tie)
    rounded = scores.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit(vector: Column) -> Column:
    """A vector of length 1 in doubles; the zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two vectors in doubles; the cosine if both are of length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_block: int = 2000, chunk: int = 50_000, digits: int = 5, sizes: tuple[int, int] | None = None, scope: str | None = None) -> DataFrame:
    """`(qid, key, score, rank)`: the exact k nearest vectors of every query by cosine, itself left out.

    A block nested loop: vectors in chunks and queries in blocks meet in one task per (block, chunk), are multiplied
    there as matrices and only the k best of each chunk leave it, so that neither side is ever broadcast or collected.
    Ties go to the higher key. Null vectors and keys are left out; zero vectors have cosine 0 with everything. `sizes`
    are about how many vectors and queries there are, to be given where counting them would compute them. With `scope`, a
    column of both, a query that names a scope meets only vectors of it, and one with a null scope meets all.
    """
    size, n = sizes or (vectors.count(), queries.count())
    chunks, blocks = max(1, -(-size // chunk)), max(1, -(-n // query_block))
    kind = vectors.schema[key].dataType.simpleString()
    all_blocks, all_chunks = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (blocks, chunks))

    def usable(df: DataFrame, own: str, parts: int, other: str, all_other: Column) -> DataFrame:
        named = (F.col(scope) if scope else F.lit(None)).cast("string").alias("_scope")
        kept = df.select(F.col(key).alias("_key"), unit(F.col(vector)).alias("_vec"), named).filter("_key is not null and _vec is not null")
        return kept.withColumn(own, F.pmod(F.xxhash64("_key"), F.lit(parts))).withColumn(other, all_other)

    left = usable(vectors, "_chunk", chunks, "_block", all_blocks)
    right = usable(queries, "_block", blocks, "_chunk", all_chunks)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", key, "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({x: [] for x in names})
        a = a.sort_values("_key", ascending=False)
        keys, asked = a["_key"].to_numpy(), b["_key"].to_numpy()
        scores = np.round(np.stack(b["_vec"].to_list()) @ np.stack(a["_vec"].to_list()).T, digits)
        scores[asked[:, None] == keys[None, :]] = -np.inf
        if scope:
            wanted, held = b["_scope"].to_numpy(object), a["_scope"].to_numpy(object)
            scores[np.array([x is not None for x in wanted])[:, None] & (wanted[:, None] != held[None, :])] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"qid": np.repeat(asked, order.shape[1]), key: keys[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})
        return out[np.isfinite(out["score"])]

    near = left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInPandas(best, f"qid {kind}, {key} {kind}, score double")
    return top_k(near, k, key=key, lower_first=False, digits=digits)


class Embedder(Protocol):
    """Anything that makes vectors of texts, a batch at a time; errors are raised."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector for each text."""
        ...


class HashedEmbedder:
    """A deterministic stand-in for an embedding model, a hashed bag of terms of length 1; it says nothing of any model's quality."""

    def __init__(self, size: int = 64) -> None:
        self.size = size
        self.slots: dict[str, int] = {}

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Counts of the terms' slots, the terms being divided by spaces; the zero vector for a text without any."""
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for term in text.split():
                slot = self.slots.get(term)
                if slot is None:
                    slot = int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % self.size
                    if len(self.slots) < 1_000_000:
                        self.slots[term] = slot
                row[slot] += 1
        return (out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)).tolist()


def embedded(docs: DataFrame, key: str, text: Column, client: Embedder, fallback: Embedder | None = None, batch: int = 32) -> DataFrame:
    """`(key, embedding)` of every row in one narrow pass, by a client that is given `batch` texts at a time.

    Where the client fails on a batch the fallback is asked once; if that fails too or there is none, the error ends the
    task. Null texts are the empty text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                try:
                    vectors = client.embed(part["_text"].tolist())
                except Exception:
                    if fallback is None:
                        raise
                    vectors = fallback.embed(part["_text"].tolist())
                yield pd.DataFrame({key: part[key], "embedding": vectors})

    return docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def hashed_embedding(docs: DataFrame, key: str, text: str, size: int = 64, tokenizer: str = "rank") -> DataFrame:
    """`(key, embedding)` by the stand-in embedder, which makes the vector paths run without a model."""
    return embedded(docs, key, F.concat_ws(" ", tokens(F.col(text), tokenizer)), HashedEmbedder(size), batch=1000)


def cached_embeddings(docs: DataFrame, key: str, text: str, cache: DataFrame | None, model: str, embed=hashed_embedding) -> DataFrame:
    """`(model, text_hash, embedding)` of all distinct texts: cached ones from `cache`, the misses from `embed`."""
    texts = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    if cache is not None:
        known = cache.filter(F.col("model") == model)
        texts_missing = texts.join(known, "text_hash", "left_anti")
    else:
        known, texts_missing = None, texts
    fresh = embed(texts_missing, "text_hash", "text").select(F.lit(model).alias("model"), "text_hash", "embedding")
    if known is None:
        return fresh
    return known.join(texts.select("text_hash"), "text_hash", "left_semi").select("model", "text_hash", "embedding").unionByName(fresh)


def reciprocal_rank_fusion(*rankings: DataFrame, qid: str = "qid", key: str = "doc_id", k: int = 60) -> DataFrame:
    """`(qid, key, score, first)`: the sum of 1 / (k + rank) over the rankings.

    `first` orders ties as if the rankings were read one after the other: by the first list a record is in, then by its
    rank there.
    """
    parts = [r.select(qid, key, (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(i).alias("list"), F.col("rank").alias("rank")) for i, r in enumerate(rankings)]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return pool.groupBy(qid, key).agg(F.sum("part").alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def fused_top_k(fused: DataFrame, n: int, qid: str = "qid", digits: int = 9) -> DataFrame:
    """The n best of a fusion with its tie rule."""
    order = Window.partitionBy(qid).orderBy(F.desc("score"), "first")
    ranked = fused.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).drop("first")


def containment_pairs(docs: DataFrame, keys: DataFrame, hay: str, needle: str, gram: int = 16) -> DataFrame:
    """All (record, key) rows whose normalised text contains the normalised key, by an equi-join instead of a product.

    Any occurrence of a key of at least 2 * gram - 1 characters covers a whole gram of the text that starts at a multiple
    of `gram`. Texts give only those grams, keys all of theirs, and each match is verified. Shorter keys are compared
    directly; `keys` is a stated query set. Both inputs keep their columns but for the compared texts themselves, which
    do not leave their task.
    """
    kept = [c for c in (*docs.columns, *keys.columns) if c not in (hay, needle)]
    places = F.sequence(F.lit(1), F.greatest(F.length(hay) - gram + 1, F.lit(1)), F.lit(gram))
    text_grams = docs.withColumn("_g", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(hay), i, F.lit(gram))))))
    shifts = F.sequence(F.lit(1), F.length(needle) - gram + 1)
    long = keys.filter(F.length(needle) >= 2 * gram - 1)
    key_grams = long.withColumn("_g", F.explode(F.array_distinct(F.transform(shifts, lambda i: F.substring(F.col(needle), i, F.lit(gram))))))
    found = text_grams.join(F.broadcast(key_grams), "_g").filter(F.contains(F.col(hay), F.col(needle))).select(*kept).distinct()
    short = keys.filter((F.length(needle) < 2 * gram - 1) & (F.length(needle) > 0))
    return found.unionByName(docs.join(F.broadcast(short), F.contains(F.col(hay), F.col(needle))).select(*kept))
