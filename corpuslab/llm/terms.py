"""How distinctive a term is of a record: divergence from randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.skew import current_rows, join_hot_cold

#: A term is a maximal run of at least four letters of any alphabet in the lower-cased text.
TERM = r"\p{L}{4,}"
#: Terms in more than this fraction of the records are broadcast; there are at most (mean distinct terms) / HOT of them.
HOT = 1 / 200


def term_frequencies(records: DataFrame) -> DataFrame:
    """`(doc_id, dl, term, tf)` of the current record of each `doc_id`, over title and text together.

    Null and empty titles and texts count as empty; a record without terms has no rows. The record's latest delivery is
    found with one exchange by `doc_id`, and the counting reuses that partitioning.
    """
    current = current_rows(records, F.col("doc_id"), ["title", "text"])
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "text")), F.lit(TERM), F.lit(0))
    listed = current.select("key", words.alias("words"))
    each = listed.select("key", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy("key", "dl", "term").agg(F.count("*").alias("tf")).withColumnRenamed("key", "doc_id")


def distinctive_terms(records: DataFrame, c: float = 1.0, min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """Score of each term of each record, `(doc_id, term, tf, df, score)`.

    Divergence from randomness: the information content of the length-normalised frequency
    `tfn = tf * log2(1 + c * avgdl / dl)` under a geometric collection model with mean `F / N`,
    `log2(1 + m) + tfn * log2((1 + m) / m)`, times the Laplace after-effect gain `1 / (1 + tfn)`. Collection statistics
    always cover all current records; `min_tf`, `min_df` and `max_df` only choose which scores come out.
    """
    pairs = term_frequencies(records)
    facts = pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    sizes = pairs.select("doc_id", "dl").distinct().agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    n, tokens = sizes.select("n").scalar(), sizes.select("tokens").scalar()
    facts = facts.filter((F.col("df") >= min_df) & (F.col("df") <= (max_df if max_df is not None else F.col("df"))))
    wanted = pairs.filter(F.col("tf") >= min_tf)
    if max_df is None:
        joined = join_hot_cold(wanted, facts, "term", F.col("df") > F.greatest(F.lit(1000.0), n * F.lit(HOT)))
    else:
        joined = wanted.join(facts, "term")  # no term has more than max_df rows here, so none is hot
    tfn = F.col("tf") * F.log2(1 + c * (tokens / n) / F.col("dl"))
    mean = F.col("cf") / n
    info = F.log2(1 + mean) + tfn * F.log2((1 + mean) / mean)
    return joined.select("doc_id", "term", "tf", "df", (info / (1 + tfn)).alias("score"))
