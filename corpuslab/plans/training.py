"""Registered queries of the general training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.operators import announcements as ann
from corpuslab.operators import orphans
from corpuslab.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Children of announcements of both kinds of export, by level sequences."""
    return ann.announcement_children(*_exports(spark, root))


def _exports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "announcements"), table(spark, root, "announcements_raw")


def p1_announcements(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of announcements; `base` and `ann_no` link it to its children."""
    return ann.announcements_table(*_exports(spark, root))


def p1_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of paragraphs."""
    return ann.paragraphs_table(*_exports(spark, root))


def p1_tags(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of tags."""
    return ann.tags_table(*_exports(spark, root))


def p1_unread(spark: SparkSession, root: str) -> DataFrame:
    """JSON exports that yield nothing, with the reason."""
    return ann.unread_exports(table(spark, root, "announcements_raw"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """References without a live record behind them."""
    names = ("records", "token_counts", "metadata", "questions_public")
    return orphans.handbook_references(*[table(spark, root, x) for x in names])


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.orphan_report(p3_found(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_announcements, p1_paragraphs, p1_tags, p1_unread, p3_found, p3_report)
}

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+|[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]+$', '', 'g')"


def _norm(column: str) -> str:
    return f"nullif(lower({_STRIP.format(column)}), '')"


_P3 = f"""
WITH refs AS (
  SELECT 'doc' AS parent, {_norm('doc_id')} AS key, 'token_counts' AS ref_table, row_id, loaded_at FROM token_counts
  UNION ALL SELECT 'doc', {_norm('doc_id')}, 'metadata', row_id, loaded_at FROM metadata
  UNION ALL SELECT 'file', {_norm('document')}, 'questions_public', row_id, loaded_at FROM questions_public),
parents AS (
  SELECT parent, key, min(loaded_at) AS born, count(*) = count(deleted_at) AS gone, max(deleted_at) AS died FROM (
    SELECT 'doc' AS parent, {_norm('doc_id')} AS key, loaded_at, deleted_at FROM records
    UNION ALL SELECT 'file', {_norm("regexp_replace(source_file, '[.][^.]*$', '')")}, loaded_at, deleted_at FROM records)
  WHERE key IS NOT NULL GROUP BY parent, key),
found AS (
  SELECT ref_table, row_id, strftime(refs.loaded_at, '%Y-%m') AS ref_month,
    CASE WHEN parents.key IS NULL THEN 'missing' WHEN born > refs.loaded_at THEN 'late'
         WHEN gone AND died <= refs.loaded_at THEN 'deleted' END AS reason
  FROM refs LEFT JOIN parents ON refs.parent = parents.parent AND refs.key = parents.key WHERE refs.key IS NOT NULL)
"""

_MONTH = "lpad(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left({0}, 3)))::VARCHAR, 2, '0')"
_NAME = r"((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))"
_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)? *(?:(?i:z|utc|am|pm)|[+-]\d{2}:?\d{2})?)?"
_DATE_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", 1, 2, 3, False),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3, False),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}$", 3, 2, 1, False),
    (rf"^(\d{{1,2}})\.? +{_NAME}\.?,? +(\d{{4}})$", 3, 2, 1, True),
    (rf"^{_NAME}\.? +(\d{{1,2}}),? +(\d{{4}})$", 3, 1, 2, True),
)


def _date_sql(text: str) -> str:
    """The date that a text names, as a CASE over its notations."""
    cases = []
    for pattern, y, m, d, named in _DATE_FORMS:
        part = {i: f"regexp_extract({text}, '{pattern}', {i})" for i in (1, 2, 3)}
        month = _MONTH.format(part[m]) if named else f"lpad({part[m]}, 2, '0')"
        cases.append(f"WHEN regexp_matches({text}, '{pattern}') THEN {part[y]} || '-' || {month} || '-' || lpad({part[d]}, 2, '0')")
    return f"strftime(try_cast(CASE {' '.join(cases)} END AS DATE), '%Y-%m-%d')"


def _place_sql(paths: list[str]) -> str:
    return "CASE rest " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(paths)) + " END"


_SAID = r"[^\s\p{Z}\x0B\x1C-\x1F\x{85}]"
_ELEMENT = r"\$(?:.*)?\.announcements\[\d+\]|\$\[\d+\]"
P1_SQL = rf"""
WITH src AS (
  SELECT export_id, 'typed' AS source, to_json({{'announcements': announcements}}) AS j FROM announcements
  UNION ALL SELECT export_id, 'raw', payload::JSON FROM announcements_raw WHERE json_valid(payload)),
nodes AS (SELECT export_id, source, id, type, atom, fullkey FROM src, json_tree(j)),
places AS (
  SELECT export_id, source, fullkey AS spot, substr(regexp_replace(fullkey, '\[\d+\]', '[]', 'g'), 2) AS base,
    row_number() OVER (PARTITION BY export_id, source, regexp_replace(fullkey, '\[\d+\]', '[]', 'g') ORDER BY id) AS ann_no
  FROM nodes WHERE regexp_matches(fullkey, '^(?:{_ELEMENT})$')),
tree AS (
  SELECT export_id, source, id, type IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS num, atom ->> '$' AS v,
    regexp_extract(fullkey, '^({_ELEMENT})(.*)$', 1) AS spot, regexp_replace(regexp_extract(fullkey, '^({_ELEMENT})(.*)$', 2), '\[\d+\]', '[]', 'g') AS rest
  FROM nodes WHERE atom IS NOT NULL AND type <> 'NULL'),
known AS (SELECT *, regexp_matches(v, '{_SAID}') AS said, {_place_sql([f'.{x}' for x in ann.ID_NAMES])} AS ip, {_place_sql([f'.{x}' for x in ann.TITLE_NAMES])} AS tp,
  {_place_sql(ann.DATE_PATHS)} AS dp FROM tree WHERE spot <> ''),
own AS (
  SELECT export_id, source, spot, arg_min(v, ip) FILTER (said AND ip IS NOT NULL) AS iv, arg_min(v, tp) FILTER (said AND tp IS NOT NULL) AS title,
    arg_min(v, dp) FILTER (said AND dp IS NOT NULL) AS dv, arg_min(num, dp) FILTER (said AND dp IS NOT NULL) AS dn
  FROM known GROUP BY ALL),
named AS (SELECT export_id, source, spot, base, ann_no, {_STRIP.format('iv')} AS ann_id, title, {_STRIP.format('dv')} AS dt, dn FROM own JOIN places USING (export_id, source, spot)),
leaf AS (SELECT k.*, ann_id, base, ann_no FROM known k JOIN named USING (export_id, source, spot)),
tags AS (
  SELECT export_id, source, base, ann_no, ann_id, lower({_STRIP.format('t')}) AS tag FROM (
    SELECT *, unnest(CASE WHEN rest LIKE '%tags' THEN regexp_split_to_array(v, '[,;]') ELSE [v] END) AS t FROM leaf
    WHERE regexp_matches(rest, '^\.(?:(?:content|details)\.)?tags(?:\[\])*(?:\.(?:label|name))?$'))),
paras AS (
  SELECT export_id, source, base, ann_no, ann_id, row_number() OVER (PARTITION BY export_id, source, spot ORDER BY id, k) AS par_no, {_STRIP.format('t')} AS paragraph FROM (
    SELECT *, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS t FROM (
      SELECT *, regexp_split_to_array(v, '\r?\n[\s\p{{Z}}]*\n') AS l FROM leaf
      WHERE regexp_matches(rest, '^\.(?:(?:content|details)\.)?body(?:\[\]|\.sections|\.paragraphs|\.(?:text|message|body|content|description|summary))*$')))
  WHERE regexp_matches(t, '{_SAID}')),
anns AS (SELECT *, CASE WHEN dn THEN strftime(make_timestamp((try_cast(dt AS DOUBLE) * 1000000)::BIGINT), '%Y-%m-%d') ELSE {_date_sql('dt')} END AS posted FROM named)
"""
_P1_CHILDREN = """SELECT DISTINCT export_id, ann_id, 'posted' AS child, posted AS item FROM anns WHERE ann_id IS NOT NULL AND posted IS NOT NULL
UNION ALL SELECT DISTINCT export_id, ann_id, 'tag', tag FROM tags WHERE ann_id IS NOT NULL AND tag <> ''
UNION ALL SELECT DISTINCT export_id, ann_id, 'body', par_no::VARCHAR FROM paras WHERE ann_id IS NOT NULL"""

ORACLES: dict[str, str] = {
    "p1_found": P1_SQL + _P1_CHILDREN,
    "p1_announcements": P1_SQL + "SELECT export_id, source, base, ann_no, ann_id, title, posted FROM anns",
    "p1_tags": P1_SQL + "SELECT export_id, source, base, ann_no, ann_id, tag FROM tags WHERE tag <> ''",
    "p1_paragraphs": P1_SQL + "SELECT export_id, source, base, ann_no, ann_id, par_no, paragraph FROM paras",
    "p1_unread": P1_SQL
    + """SELECT export_id, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'no JSON' ELSE 'no announcements' END AS reason
FROM announcements_raw WHERE export_id NOT IN (SELECT export_id FROM anns WHERE source = 'raw')""",
    "p3_found": _P3 + "SELECT ref_table, row_id, ref_month, reason FROM found WHERE reason IS NOT NULL",
    "p3_report": _P3 + "SELECT ref_table, ref_month, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
