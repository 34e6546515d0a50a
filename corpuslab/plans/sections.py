"""Registered queries of segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import segments as sg
from corpuslab.sources.tables import table


def _docs(spark: SparkSession, root: str) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*#+ *", ""), r"(?m)^[-*>] +", "")
    return table(spark, root, "documents").select("doc_id", marked.alias("text"))


def document_lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the documents without marks."""
    return sg.lines_of(_docs(spark, root), "doc_id", "text")


def line_scores(spark: SparkSession, root: str) -> DataFrame:
    """Heading score of every line."""
    return document_lines(spark, root).select("doc_id", F.col("line_no").cast("long").alias("line_no"), sg.line_score(F.col("line"), F.col("next_line")).cast("long").alias("score"))


def headings(spark: SparkSession, root: str) -> DataFrame:
    """Lines that reach the threshold."""
    return line_scores(spark, root).filter("score >= 5").select("doc_id", "line_no")


def sections_merged(spark: SparkSession, root: str) -> DataFrame:
    """Sections of every document, short ones merged."""
    made = sg.sections(document_lines(spark, root), "doc_id")
    return made.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "title", F.md5("body").alias("body"))


def font_lines_of_documents(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the documents with font evidence made of marks and lengths."""
    raw = sg.lines_of(table(spark, root, "documents"), "doc_id", "text")
    bold = F.col("line").startswith("#") | (F.length("line") < 30)
    size = F.when(F.col("line").startswith("#"), 14.0).otherwise(10.0)
    return raw.filter("line <> ''").select("doc_id", "line_no", "line", "next_line", size.alias("size"), bold.alias("bold"))


def sections_by_font(spark: SparkSession, root: str) -> DataFrame:
    """Sections with emphasis as evidence: marked headings are large, short lines bold."""
    lines = font_lines_of_documents(spark, root)
    joined = lines.join(sg.body_size(lines, "doc_id", "size"), "doc_id")
    boost = sg.font_boost(F.col("size"), F.col("body_size"), F.col("bold"), F.col("line"))
    made = sg.sections(joined, "doc_id", boost=boost, font=True)
    return made.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.md5("title").alias("title"), F.md5("body").alias("body"))


def body_sizes(spark: SparkSession, root: str) -> DataFrame:
    """The body font size of every document."""
    return sg.body_size(font_lines_of_documents(spark, root), "doc_id", "size")


def heading_key_sets(spark: SparkSession, root: str) -> DataFrame:
    """Squashed heading lines of every document by font."""
    return sg.heading_keys(font_lines_of_documents(spark, root), "doc_id", "size", "bold").select("doc_id", F.array_join("keys", "|").alias("keys"))


def char_windows(spark: SparkSession, root: str) -> DataFrame:
    """Overlapping windows of every document."""
    made = sg.windows(table(spark, root, "documents"), "doc_id", "text")
    return made.select("doc_id", F.col("start").cast("long").alias("start"), F.md5("chunk").alias("chunk"))


def font_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines put together from runs (made of order lines here: order = page, line number = baseline)."""
    runs = table(spark, root, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % 500).cast("double").alias("across"),
        (F.col("l_linenumber") % 3 * 12.02).cast("double").alias("down"),
        F.concat("l_returnflag", F.lit(" "), F.col("l_suppkey").cast("string")).alias("text"),
        F.col("l_quantity").cast("double").alias("size"),
        (F.col("l_linenumber") % 2 == 0).alias("bold"),
        (F.col("l_orderkey") % 5 == 0).alias("rotated"),
    )
    made = sg.lines_from_runs(runs, "l_orderkey")
    return made.select("l_orderkey", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("chars"), "size", "bold")


def compose_matrices(spark: SparkSession, root: str) -> DataFrame:
    """Position and scale of matrices made of vector elements."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    made = table(spark, root, "embeddings").select("vec_id", sg.compose_scale(F.slice(wide, 1, 6), F.slice(wide, 7, 6)).alias("m"))
    return made.select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("x", "y", "scale")])


def split_long_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections with the long ones cut at sentence ends."""
    made = sg.split_long(sg.sections(document_lines(spark, root), "doc_id"), "doc_id")
    return made.select("doc_id", "section_no", F.col("part_no").cast("long").alias("part_no"), "title", F.md5("body").alias("body"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (line_scores, headings, sections_merged, sections_by_font, body_sizes, heading_key_sets, char_windows, font_lines, compose_matrices, split_long_sections)
}

_RX = {"furn": sg.FURNITURE, "data": sg.DATA_ROW, "num": sg.NUMBERED, "let": sg.LETTERED, "lab": sg.LABELLED}
_STARTERS = ", ".join(f"'{w}'" for w in sg.SENTENCE_STARTERS)
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _m(line: str, name: str) -> str:
    return f"regexp_matches({line}, '{_RX[name]}')"


_LINES = f"""
WITH docs AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^\\s*#+ *', '', 'g'), '(?m)^[-*>] +', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs),
raw AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, l FROM cut),
lines AS (SELECT doc_id, line_no, {_TRIM.format('l[line_no + 1]')} AS line, coalesce({_TRIM.format('l[line_no + 2]')}, '') AS nxt FROM raw),
feats AS (SELECT *, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS words, regexp_replace(line, '[^\\p{{L}}]+', '', 'g') AS letters FROM lines),
scored AS (SELECT doc_id, line_no, line, CASE WHEN line = '' THEN 0 WHEN {_m('line', 'furn')} THEN -99 ELSE
  CASE WHEN {_m('line', 'num')} THEN 4 WHEN {_m('line', 'let')} THEN 3 ELSE 0 END + CASE WHEN {_m('line', 'lab')} THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(letters, '^\\p{{Lu}}+$') AND len(words) >= 2 THEN 3 ELSE 0 END
  + CASE WHEN len(words) >= 2 AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(2, floor(len(words) * 0.7::DOUBLE)) THEN 2 ELSE 0 END
  + CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END - CASE WHEN length(line) > 90 THEN 3 ELSE 0 END
  + CASE WHEN NOT regexp_matches(line, '[.,;?!]$') THEN 1 WHEN NOT {_m('line', 'num')} THEN -2 ELSE 0 END
  + CASE WHEN line LIKE '%:' AND length(line) <= 60 THEN 1 ELSE 0 END - CASE WHEN {_m('line', 'data')} THEN 10 ELSE 0 END
  - CASE WHEN len(words) > 0 AND lower(words[1]) IN ({_STARTERS}) AND NOT {_m('line', 'num')} THEN 3 ELSE 0 END
  + CASE WHEN length(trim(nxt)) > 80 THEN 1 ELSE 0 END END AS score FROM feats)
"""
_FONT = _LINES.replace("regexp_replace(regexp_replace(text, '(?m)^\\s*#+ *', '', 'g'), '(?m)^[-*>] +', '', 'g')", "text") + """
, font AS (SELECT s.*, CASE WHEN s.line LIKE '#%' THEN 14.0 ELSE 10.0 END::DOUBLE AS size, s.line LIKE '#%' OR length(s.line) < 30 AS bold FROM scored s WHERE s.line <> ''),
sizes AS (SELECT doc_id, size AS body_size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(line_no)) AS nth FROM font GROUP BY doc_id, size) WHERE nth = 1),
boosted AS (SELECT f.doc_id, line_no, line, CASE WHEN length(line) <= 80 AND (size > body_size + 0.5 OR bold) THEN 4 ELSE 0 END AS boost, score FROM font f JOIN sizes USING (doc_id))
"""


def _sections(source: str, head: str, title: str, own: str) -> str:
    return f"""
, heads AS (SELECT *, {head} AS head, {_m('line', 'furn')} AS furn FROM {source}),
placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM heads),
secs AS (SELECT doc_id, s, max(line) FILTER (head) AS title, trim(regexp_replace(coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT head AND line <> '' AND NOT furn), ''), '[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x{{85}}]+', ' ', 'g')) AS body
  FROM placed WHERE s > 0 GROUP BY doc_id, s),
named AS (SELECT doc_id, s, {title} AS title, body, {own} OR row_number() OVER (PARTITION BY doc_id ORDER BY s) = 1 AS own FROM secs),
islands AS (SELECT *, sum(own::INT) OVER (PARTITION BY doc_id ORDER BY s) AS section_no FROM named),
merged AS (SELECT doc_id, section_no, arg_min(title, s) AS title, trim(string_agg(CASE WHEN own THEN body ELSE title || ' ' || body END, ' ' ORDER BY s)) AS body FROM islands GROUP BY ALL)
"""


def _rest(name: str) -> str:
    return f"CASE WHEN trim(regexp_extract(title, '{_RX[name]}', 2)) <> '' THEN trim(regexp_extract(title, '{_RX[name]}', 2)) ELSE title END"


_TITLE = f"CASE WHEN {_m('title', 'num')} THEN {_rest('num')} WHEN {_m('title', 'let')} THEN {_rest('let')} WHEN {_m('title', 'lab')} THEN {_rest('lab')} ELSE title END"

_PACKED = """, long AS (SELECT doc_id, section_no, title, regexp_split_to_array(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM merged WHERE length(body) > 1200),
walk AS (SELECT doc_id, section_no, 0 AS i, []::VARCHAR[] AS done, '' AS held FROM long
  UNION ALL SELECT w.doc_id, w.section_no, i + 1, CASE WHEN held <> '' AND length(held) + 1 + length(l[i + 1]) > 900 THEN list_append(done, trim(held)) ELSE done END,
    CASE WHEN held <> '' AND length(held) + 1 + length(l[i + 1]) > 900 THEN right(held, 160) || ' ' || l[i + 1] ELSE trim(held || ' ' || l[i + 1]) END
  FROM walk w JOIN long USING (doc_id, section_no) WHERE i < len(l)),
packed AS (SELECT w.doc_id, w.section_no, CASE WHEN trim(held) <> '' THEN list_append(done, trim(held)) ELSE done END AS parts FROM walk w JOIN long USING (doc_id, section_no) WHERE i = len(l)),
parted AS (SELECT m.doc_id, m.section_no, m.title, CASE WHEN len(parts) > 1 THEN parts ELSE [m.body] END AS parts FROM merged m LEFT JOIN packed USING (doc_id, section_no))
SELECT doc_id, section_no::BIGINT AS section_no, i AS part_no, CASE WHEN len(parts) = 1 THEN title ELSE title || ' (' || i || ' of ' || len(parts) || ')' END AS title, md5(parts[i]) AS body
FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parted)"""

ORACLES: dict[str, str] = {
    "line_scores": _LINES + "SELECT doc_id, line_no, score::BIGINT AS score FROM scored",
    "headings": _LINES + "SELECT doc_id, line_no FROM scored WHERE score >= 5",
    "sections_merged": _LINES + _sections("scored", "score >= 5", _TITLE, "(length(body) >= 40 OR body = '')") + "SELECT doc_id, section_no::BIGINT AS section_no, title, md5(body) AS body FROM merged",
    "split_long_sections": (_LINES + _sections("scored", "score >= 5", _TITLE, "(length(body) >= 40 OR body = '')") + _PACKED).replace("WITH docs AS", "WITH RECURSIVE docs AS"),
    "sections_by_font": _FONT + _sections("boosted", f"(score + boost >= 5 AND length(line) <= 90 AND NOT {_m('line', 'furn')})", "title", "length(body) >= 40") + "SELECT doc_id, section_no::BIGINT AS section_no, md5(title) AS title, md5(body) AS body FROM merged",
    "body_sizes": _FONT + "SELECT doc_id, body_size FROM sizes",
    "heading_key_sets": _FONT + "SELECT doc_id, array_to_string(list_sort(list(DISTINCT lower(regexp_replace(line, '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]+', '', 'g')))), '|') AS keys FROM boosted WHERE boost > 0 GROUP BY doc_id",
    "char_windows": """SELECT doc_id, start, md5(chunk) AS chunk FROM (SELECT doc_id, start, substr(text, start + 1, 420) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 1), 260)) AS start FROM documents WHERE text IS NOT NULL)) WHERE length(chunk) > 80""",
    "font_lines": """WITH runs AS (SELECT l_orderkey, (l_partkey % 500)::DOUBLE AS across, (l_linenumber % 3 * 12.02)::DOUBLE AS down, l_returnflag || ' ' || l_suppkey AS text, l_quantity::DOUBLE AS size, l_linenumber % 2 = 0 AS bold, l_orderkey % 5 = 0 AS rot FROM lineitem),
flat AS (SELECT l_orderkey, CASE WHEN rot THEN down ELSE across END AS x, CASE WHEN rot THEN round(across, 1) ELSE -round(down, 1) END AS y, text, size, bold FROM runs),
joined AS (SELECT l_orderkey, y, sum(length(text) + 1) - 1 AS chars, max(size) AS size, bool_and(bold) AS bold FROM flat GROUP BY ALL)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY y) - 1 AS line_no, chars::BIGINT AS chars, size, bold FROM joined""",
    "compose_matrices": """WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT vec_id, e[7] * e[1] + e[8] * e[3] AS a, e[7] * e[2] + e[8] * e[4] AS b, e[9] * e[1] + e[10] * e[3] AS c, e[9] * e[2] + e[10] * e[4] AS d,
  e[11] * e[1] + e[12] * e[3] + e[5] AS x, e[11] * e[2] + e[12] * e[4] + e[6] AS y FROM m)
SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(abs(a * d - b * c)), 6) AS scale FROM p""",
}
