"""Languages of documents and of stretches within them, by nearest centroid over character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.keys import strip

#: Codes and names of the languages in several spellings, lower case, region dropped.
LABELS = {
    "en": "en eng english englisch anglais inglés inglês engels",
    "de": "de deu ger german deutsch allemand alemán alemão duits",
    "fr": "fr fra fre french français francais französisch francés francês frans",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spaans",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés neerlandês flemish vlaams",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portugees",
}

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
CLUSTERS = 2
#: Weight of the mean similarity of its whole document in a sentence's own. In documents made of held-out labelled
#: sentences both languages were found in 0.947 of them with 0, 0.944 with 0.15 and 0.900 with 0.3, another language
#: besides in 0.009, 0.008 and 0.007.
CONTEXT = 0.15
#: Standard deviations below the mean of a centroid's held-out sentences at which one sentence is too far away, and the
#: mean of several. With these 10 of 1,440 held-out texts of one to five labelled sentences are rejected.
RADIUS, RADIUS_OF_SEVERAL = 3.0, 2.45
_SCALE = (np.uint64(1099511628211), np.uint64(40503))
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
_QUOTED = re.compile(r"[“„«\"‘][^“”„«»\"\n]{1,80}[”“»\"’]")
_OPENED = re.compile(r"[“„«\"‘]")
_MARK = re.compile(r"^(?:>\s*)+|^[-*•]\s+|^[QAFRPV]:\s+|^\d+[.)]\s+")
_CLOSED = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


def fold(text: str) -> str:
    """A text without the marks on its letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words_of(text: str) -> str:
    """The words of a text in lower case, with a space before and after each; empty for a text without any."""
    words = _WORD.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def ngram_rows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(row, bucket, count)` of the hashed n-grams of each line of words, in order of row."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    kind = np.int32 if len(lines) * BUCKETS < 1 << 31 else np.int64
    row = np.cumsum(codes == 10).astype(kind)
    keys = []
    value = np.zeros(len(codes), np.uint64)
    for size in range(1, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        value = value[:n] * _SCALE[0] + codes[size - 1 :]
        if size in SIZES:
            mixed = value + np.uint64(size)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _SCALE[1]
            bucket = ((mixed ^ (mixed >> np.uint64(17))) & np.uint64(BUCKETS - 1)).astype(kind)
            inside = (row[:n] == row[size - 1 :]) & (codes[:n] != 10) & (codes[size - 1 :] != 10)
            keys.append((row[:n] * BUCKETS + bucket)[inside])
    found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, kind)
    first = np.flatnonzero(np.diff(found, prepend=-1))
    once = found[first]
    return (once // BUCKETS).astype(np.int64), (once & (BUCKETS - 1)).astype(np.int64), np.diff(np.append(first, len(found)))


#: 1 + log of a count, up to counts that no sentence has.
_DAMPED = 1 + np.log(np.maximum(np.arange(1 << 14), 1))


@dataclass
class Model:
    """Centroids of every language: `weights` has a row per centroid, `owner` its language's number.

    `middle` and `spread` are the mean and deviation of the logarithms of the similarities that the sentences of a
    centroid have to the centroids of their language made without them.
    """

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    owner: np.ndarray
    middle: np.ndarray
    spread: np.ndarray


@dataclass
class _Sparse:
    """Rows of weighted n-grams of length 1, kept as triples."""

    row: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray
    n: int

    def dots(self, centroids: np.ndarray) -> np.ndarray:
        """The inner product of every row with every centroid."""
        out = np.zeros((self.n, len(centroids)))
        if len(self.row):
            first = np.flatnonzero(np.diff(self.row, prepend=-1))
            for j, c in enumerate(centroids):
                out[self.row[first], j] = np.add.reduceat(self.weight * c[self.bucket], first)
        return out

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of some rows."""
        on = rows[self.row]
        return np.bincount(self.bucket[on], self.weight[on], BUCKETS)


def _vectors(lines: list[str], idf: np.ndarray) -> _Sparse:
    row, bucket, count = ngram_rows(lines)
    weight = _DAMPED[np.minimum(count, len(_DAMPED) - 1)] * idf[bucket]
    norm = np.sqrt(np.bincount(row, weight * weight, len(lines)))
    return _Sparse(row, bucket, weight / np.maximum(norm, 1e-9)[row], len(lines))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-9)


def fit(samples: list[tuple[str, str]], clusters: int = CLUSTERS, rounds: int = 8) -> Model:
    """A model of labelled sentences, each also without the marks on its letters.

    Vectors are normalised TF-IDF, kept sparse, the inverse frequency that of sentences times that of languages; each
    language's are clustered into a few centroids by spherical k-means that starts from vectors at equal steps of the
    sorted sentences, so that it always gives the same model. How far the sentences of a centroid are from the centroids
    of their language if they are left out of them gives its radius.
    """
    rows = sorted({(lang, t, text) for lang, text in samples if lang and text for t in (text, fold(text))})
    langs = sorted({lang for lang, _, _ in rows})
    lines = [words_of(t) for _, t, _ in rows]
    row, bucket, _ = ngram_rows(lines)
    df = np.bincount(bucket, minlength=BUCKETS)
    of = np.array([langs.index(lang) for lang, _, _ in rows], np.int64)
    of_langs = sum(((np.bincount(bucket[of[row] == k], minlength=BUCKETS) > 0).astype(int) for k in range(len(langs))), np.zeros(BUCKETS))
    rare = np.log(1 + len(lines) / (1 + df)) * np.log((len(langs) + 0.5) / np.maximum(of_langs, 1))
    idf = np.maximum(rare, 1e-3)
    vectors = _vectors(lines, idf)
    sources = {}
    source = np.array([sources.setdefault((lang, text), len(sources)) for lang, _, text in rows], np.int64)
    centroids, owner, middle, spread = [], [], [], []
    for k in range(len(langs)):
        own = np.flatnonzero(of == k)
        one = np.zeros(len(rows), bool)

        def total(members: np.ndarray, one: np.ndarray = one) -> np.ndarray:
            one[:] = False
            one[members] = True
            return vectors.total(one)

        cent = np.stack([_unit(total(own[i : i + 1])) for i in np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)])
        for _ in range(rounds):
            near = vectors.dots(cent)[own].argmax(1)
            cent = np.stack([_unit(total(own[near == j])) if (near == j).any() else cent[j] for j in range(len(cent))])
        near = vectors.dots(cent)[own].argmax(1)
        sums = [total(own[near == j]) for j in range(len(cent))]
        left_out = np.full(len(own), 1e-6)
        for s in np.unique(source[own]):
            same = own[source[own] == s]
            without = np.stack([_unit(c - total(np.array([i for i in same if near[np.searchsorted(own, i)] == j], np.int64))) for j, c in enumerate(sums)])
            left_out[np.searchsorted(own, same)] = np.maximum(vectors.dots(without)[same].max(1), 1e-6)
        for j in range(len(cent)):
            logs = np.log(left_out[near == j]) if (near == j).sum() > 2 else np.log(left_out)
            middle.append(float(logs.mean()))
            spread.append(max(float(logs.std()), 0.25))
        centroids.append(cent)
        owner += [k] * len(cent)
    weights = np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS))
    return Model(langs, idf.astype(np.float32), weights.astype(np.float32), np.array(owner, np.int64), np.array(middle), np.array(spread))


def similarities(lines: list[str], model: Model, chunk: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each line of words to the nearest centroid of each language, 0 where it has no letters, and which that is."""
    out = np.zeros((len(lines), len(model.langs)), np.float32)
    nearest = np.zeros((len(lines), len(model.langs)), np.int64)
    for a in range(0, len(lines), chunk):
        part = lines[a : a + chunk]
        if not len(model.langs):
            break
        dots = _vectors(part, model.idf).dots(model.weights)
        for k in range(len(model.langs)):
            own = np.flatnonzero(model.owner == k)
            at = dots[:, own].argmax(1)
            nearest[a : a + len(part), k] = own[at]
            out[a : a + len(part), k] = dots[np.arange(len(part)), own[at]]
    return out, nearest


def distances(sims: np.ndarray, centroid: np.ndarray, model: Model) -> np.ndarray:
    """How many standard deviations a similarity lies above the held-out sentences of its centroid, negative below."""
    return (np.log(np.maximum(sims, 1e-6)) - model.middle[centroid]) / model.spread[centroid]


def confidence(sims: np.ndarray, sharpness: float = 12.0) -> np.ndarray:
    """How clearly the nearest language wins, between 1 / number of languages and 1."""
    power = np.maximum(sims.astype(np.float64), 1e-6) ** sharpness
    return power.max(-1) / power.sum(-1)


def paragraphs(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the sentences of each paragraph; headings and rules are left out.

    A line is a paragraph, but a line that goes on in the next one, as in quoted or wrapped text, is joined with it.
    """
    blocks: list[list[tuple[int, int, str]]] = []
    pos, open_ = 0, False
    for line in text.split("\n"):
        start = pos
        pos += len(line) + 1
        bare = line.strip()
        mark = _MARK.match(bare)
        content = _MARK.sub("", bare) if mark else bare
        if not content or not _WORD.search(content):
            open_ = False
            continue
        if content.startswith("#") or (not _CLOSED.search(content) and not open_ and len(content) < 60 and "," not in content and len(_WORD.findall(content)) <= 8):
            open_ = False
            continue
        begin = start + line.index(content)
        if open_:
            blocks[-1].append((begin, begin + len(content), content))
        else:
            blocks.append([(begin, begin + len(content), content)])
        open_ = not _CLOSED.search(content)
    out = []
    for block in blocks:
        spans, begin = [], block[0][0]
        for k, (a, b, content) in enumerate(block):
            at = 0
            for m in _SENTENCE.finditer(content):
                spans.append((begin, a + m.start()))
                at = m.end()
                begin = a + at
            if k == len(block) - 1 and begin < b:
                spans.append((begin, b))
        out.append(spans)
    return out


def bounded(text: str, start: int, stop: int, most: int = 2000) -> Iterator[tuple[int, int]]:
    """A span as it is, or, if it has more than `most` characters without a sentence end, in parts cut at spaces."""
    while stop - start > most:
        cut = text.rfind(" ", start + 1, start + most)
        cut = cut if cut > start else start + most
        yield start, cut
        start = cut
    yield start, stop


def _usable(sentence: str) -> str:
    """A sentence without short quoted phrases and line marks."""
    if "\n" in sentence:
        sentence = re.sub(r"\n\s*>?\s*", " ", sentence)
    return _QUOTED.sub(" ", sentence) if _OPENED.search(sentence) else sentence


@dataclass
class _Part:
    doc: int
    paragraph: int
    start: int
    stop: int
    lang: int = -1
    sure: float = 0.0
    away: float = 0.0


def _too_far(parts: list[_Part]) -> bool:
    """Whether sentences are together farther from their centroids than held-out sentences are."""
    return sum(x.away for x in parts) / len(parts) < -(RADIUS if len(parts) == 1 else RADIUS_OF_SEVERAL)


def label_documents(texts: list[str | None], model: Model, least_words: int = 3, least_sure: float = 0.5, context: float = CONTEXT) -> list[tuple[list[str], str | None, float, list[tuple]]]:
    """`(languages, main, confidence, segments)` of each text.

    Every sentence of at least `least_words` words goes to the nearest language unless it is under `least_sure`;
    `context` times the mean similarity of its document counts with its own. Rejection is by distance: all sentences of a
    text, or those of one language in it, are of no known language if they are together farther from their centroids
    than their radius. Other sentences take the language of their neighbours. A language counts if a whole paragraph or
    two running sentences are in it. A text without such a sentence is classified as a whole. Segments are
    `(start, stop, lang, confidence)` of the longest stretches in one language.
    """
    parts: list[_Part] = []
    plain: list[str] = []
    for d, text in enumerate(texts):
        n = 0
        for p, spans in enumerate(paragraphs(text or "")):
            for a, b in (x for span in spans for x in bounded(text, *span)):
                line = words_of(_usable(text[a:b]))
                if line.count(" ") > least_words:
                    parts.append(_Part(d, p, a, b))
                    plain.append(line)
                    n += 1
        if not n and text and _WORD.search(text):
            parts.append(_Part(d, 0, 0, len(text)))
            plain.append(words_of(text))
    sims, centroid = similarities(plain, model)
    by_doc: list[list[_Part]] = [[] for _ in texts]
    if len(plain) and len(model.langs):
        of_doc = np.array([x.doc for x in parts])
        size = np.array([x.stop - x.start for x in parts], np.float32)
        means = np.stack([np.bincount(of_doc, sims[:, k] * size, len(texts)) for k in range(len(model.langs))], 1)
        means /= np.maximum(np.bincount(of_doc, size, len(texts)), 1)[:, None]
        mixed = sims + context * means[of_doc]
        best, sure = mixed.argmax(1), confidence(mixed)
        rows = np.arange(len(parts))
        away = distances(sims[rows, best], centroid[rows, best], model)
        for part, lang, s, z in zip(parts, best.tolist(), sure.tolist(), away.tolist(), strict=True):
            part.sure, part.away = s, z
            if s >= least_sure:
                part.lang = lang
            by_doc[part.doc].append(part)
        for own in by_doc:
            if own and _too_far(own):
                for x in own:
                    x.lang = -1
            for lang in {x.lang for x in own if x.lang >= 0}:
                if _too_far(group := [x for x in own if x.lang == lang]):
                    for x in group:
                        x.lang = -1
    out = []
    for own in by_doc:
        weight: dict[int, int] = {}
        counts: set[int] = set()
        groups: dict[int, list[_Part]] = {}
        for part in own:
            groups.setdefault(part.paragraph, []).append(part)
        for group in groups.values():
            known = [x.lang for x in group if x.lang >= 0]
            if known and all(x == known[0] for x in known):
                counts.add(known[0])
            run, last = 0, -2
            for x in known:
                run = run + 1 if x == last else 1
                last = x
                if run >= 2:
                    counts.add(x)
        segments: list[list] = []
        for part in own:
            if part.lang < 0:
                if segments:
                    segments[-1][1] = part.stop
                continue
            weight[part.lang] = weight.get(part.lang, 0) + part.stop - part.start
            if segments and segments[-1][2] == part.lang:
                segments[-1][1] = part.stop
                segments[-1][3].append(part.sure)
            else:
                segments.append([part.start, part.stop, part.lang, [part.sure]])
        if not counts and weight:
            counts.add(max(weight, key=lambda x: (weight[x], -x)))
        main = max(counts, key=lambda x: (weight[x], -x)) if counts else None
        total = sum(weight.values())
        sure = sum(x.sure * (x.stop - x.start) for x in own if x.lang == main) / total if total and main is not None else 0.0
        named = [(a, b, model.langs[k], float(np.mean(s))) for a, b, k, s in segments]
        out.append((sorted(model.langs[k] for k in counts), None if main is None else model.langs[main], sure, named))
    return out


def label_language(label: Column) -> Column:
    """The two-letter code that a label names in any known spelling, null if it names none of the languages."""
    bare = F.regexp_replace(F.lower(strip(label)), r"[-_].*$", "")
    code = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        code = F.when(bare.isin(names.split()), lang).otherwise(code)
    return code


SCHEMA = "doc_id long, label string, langs array<string>, lang string, confidence double, segments array<struct<start:int,stop:int,lang:string,confidence:double>>"


def document_languages(documents: DataFrame, samples: DataFrame, clusters: int = CLUSTERS, sample_bound: int = 100_000) -> DataFrame:
    """`(doc_id, label, langs, lang, confidence, segments)` of every document with text, in one narrow pass.

    The model is fitted on the driver on the labelled sentences, a fixed table of which at most `sample_bound` rows are
    read, an equal number of each language chosen by a hash of the text. Documents without letters and those farther from
    every language than its held-out sentences (rejected by distance) have no languages and a null `lang`; null texts
    have no row.
    """
    labelled = samples.select("lang", "text").filter("lang is not null and text is not null")
    langs = [r.lang for r in labelled.select("lang").distinct().collect()]
    chosen = [labelled.filter(F.col("lang") == x).orderBy(F.xxhash64("text"), "text").limit(max(1, sample_bound // len(langs))) for x in langs]
    rows = reduce(DataFrame.unionByName, chosen).collect() if chosen else []
    model = fit([(r.lang, r.text) for r in rows], clusters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "label", "langs", "lang", "confidence", "segments"]
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                found = label_documents(part["text"].tolist(), model)
                rows = [(i, label, langs, lang, sure, segs) for i, label, (langs, lang, sure, segs) in zip(part["doc_id"], part["label"], found, strict=True)]
                yield pd.DataFrame(rows, columns=names)

    usable = documents.select("doc_id", F.col("lang").alias("label"), "text").filter("text is not null")
    return usable.mapInPandas(run, SCHEMA)


def mislabelled(languages: DataFrame) -> DataFrame:
    """`(doc_id, lang)`: every language of the documents whose label is missing, wrong or one of several languages."""
    named = label_language(F.col("label"))
    right = (F.size("langs") == 1) & named.eqNullSafe(F.get("langs", F.lit(0)))
    return languages.filter((F.size("langs") > 0) & ~right).select("doc_id", F.explode("langs").alias("lang")).distinct()


def language_segments(languages: DataFrame) -> DataFrame:
    """`(doc_id, segment, start, stop, lang, confidence)` of the stretches of every document."""
    each = languages.select("doc_id", F.posexplode("segments").alias("segment", "s"))
    return each.select("doc_id", "segment", "s.start", "s.stop", "s.lang", F.round("s.confidence", 4).alias("confidence"))
