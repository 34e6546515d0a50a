"""Announcement exports as related flat tables, put together from level sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.dates import date_as_written
from corpuslab.operators.shredding import Levels, Table, rebuilt, rejected

#: The names under which exports give the same thing, in order of preference.
ID_NAMES = ("id", "announcement_id", "announcementId")
TITLE_NAMES = ("title", "headline")
META_NAMES = ("meta", "metadata", "info")
DATE_NAMES = ("posted", "published", "date", "timestamp", "updated")
CONTENT_NAMES = ("content", "details")
TEXT_NAMES = ("text", "message", "body", "content", "description", "summary")

DATE_PATHS = [f".{m}.{d}" for m in META_NAMES for d in DATE_NAMES] + [f".{d}" for d in DATE_NAMES]
_HOLDER = re.compile(r"(?:.*\.)?announcements\[\]|\[\]")
_TAG = re.compile(rf"\.(?:(?:{'|'.join(CONTENT_NAMES)})\.)?tags(?:\[\])*(?:\.(?:label|name))?")
_BODY = re.compile(rf"\.(?:(?:{'|'.join(CONTENT_NAMES)})\.)?body(?:\[\]|\.sections|\.paragraphs|\.(?:{'|'.join(TEXT_NAMES)}))*")
_GAP = re.compile(r"\r?\n\s*\n")
_LISTED = re.compile(r"[,;]")

LINK = "source string, base string, ann_no long, ann_id string"


def _first(table: Table, paths: list[str]) -> tuple[list[str | None], list[bool]]:
    """The first non-blank value of each row under any of the paths, and whether it is a number."""
    values: list[str | None] = [None] * len(table.rec)
    numbers = [False] * len(values)
    for path in reversed(paths):
        for i, v in enumerate(table.columns.get(path, ())):
            if v is not None and v.strip():
                values[i], numbers[i] = v, table.is_num[path][i]
    return values, numbers


def announcement_tables(levels: Levels) -> Iterator[tuple[Table, list[str | None]]]:
    """The table of every array of announcements of a batch with their identifiers, trimmed, null if blank."""
    for ancestor in levels.ancestors():
        if _HOLDER.fullmatch(ancestor) and not any(len(x) > len(ancestor) and x.startswith(ancestor) and _HOLDER.fullmatch(x) for x in levels.ancestors()):
            table = levels.table(ancestor)
            yield table, [None if v is None else v.strip() for v in _first(table, [f".{x}" for x in ID_NAMES])[0]]


def _values(levels: Levels, table: Table, wanted: re.Pattern[str]) -> Iterator[tuple[int, int, str]]:
    """`(row of the table, place in the walk, value)` of the leaves of announcements whose path is wanted."""
    row = {key: i for i, key in enumerate(zip(table.rec, table.number, strict=True))}
    for rest, s in levels.below(table.ancestor):
        if wanted.fullmatch(rest):
            numbers = s.numbers(table.ancestor)[0].tolist()
            for rec, n, seq, v in zip(s.rec, numbers, s.seq, s.v, strict=True):
                if v is not None:
                    yield row[int(rec), n], int(seq), (rest, v)


def tags_of(levels: Levels, table: Table) -> list[tuple[int, str]]:
    """`(row, tag)`, trimmed and lower-cased, blanks dropped; a single string is a list."""
    out = []
    for i, _, (rest, v) in _values(levels, table, _TAG):
        for t in _LISTED.split(v) if rest.endswith("tags") else (v,):
            if t := t.strip():
                out.append((i, t.lower()))
    return out


def paragraphs_of(levels: Levels, table: Table) -> list[tuple[int, int, str]]:
    """`(row, number, paragraph)` of the non-blank paragraphs in document order, numbered from 1 in each announcement.

    Blank lines divide strings; elements of arrays and of sections are paragraphs of their own; headings do not count.
    """
    out: list[tuple[int, int, str]] = []
    last, n = -1, 0
    for i, _, (_, v) in sorted(_values(levels, table, _BODY), key=lambda x: x[:2]):
        if i != last:
            last, n = i, 0
        for part in _GAP.split(v):
            if part := part.strip():
                n += 1
                out.append((i, n, part))
    return out


def _flat(exports: DataFrame, raw_exports: DataFrame, kind: str, schema: str) -> DataFrame:
    """One of the flat tables over exports of both kinds; every kind of export is shredded and rebuilt in one narrow pass."""

    def builder(source: str):  # noqa: ANN202
        def build(levels: Levels) -> tuple[list[int], dict[str, list]]:
            names = [x.split()[0] for x in schema.split(", ")]
            at: list[int] = []
            rows: list[tuple] = []
            for table, ids in announcement_tables(levels):
                link = [(source, table.ancestor, n, i) for n, i in zip(table.number, ids, strict=True)]
                if kind == "tag":
                    found = [(i, (*link[i], tag)) for i, tag in tags_of(levels, table)]
                elif kind == "paragraph":
                    found = [(i, (*link[i], n, text)) for i, n, text in paragraphs_of(levels, table)]
                elif kind == "announcement":
                    dates, numbers = _first(table, DATE_PATHS)
                    titles, _ = _first(table, [f".{x}" for x in TITLE_NAMES])
                    some = {i for i, *_ in _values(levels, table, re.compile(r".*"))}
                    found = [(i, (*link[i], titles[i], dates[i], numbers[i])) for i in sorted(some)]
                else:
                    dates, numbers = _first(table, DATE_PATHS)
                    children = [(i, "posted", v, n) for i, (v, n) in enumerate(zip(dates, numbers, strict=True)) if v is not None]
                    children += [(i, "tag", t, False) for i, t in tags_of(levels, table)]
                    children += [(i, "body", str(n), False) for i, n, _ in paragraphs_of(levels, table)]
                    found = [(i, (ids[i], *child)) for i, *child in children if ids[i] is not None]
                at.extend(table.rec[i] for i, _ in found)
                rows.extend(x for _, x in found)
            return at, dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {x: [] for x in names}

        return build

    typed = rebuilt(exports, ["export_id"], "announcements", builder("typed"), schema, root=".announcements")
    raw = rebuilt(raw_exports, ["export_id"], "payload", builder("raw"), schema)
    return typed.unionByName(raw)


def announcements_table(exports: DataFrame, raw_exports: DataFrame) -> DataFrame:
    """One row per announcement as delivered: export, `base` and `ann_no`, identifier (null if blank), title, date of posting.

    `base` is the path of its array and `ann_no` its number among the elements of that path in its export, empty and null
    elements counted; both link it to its children. Announcements without any value have no row.
    """
    flat = _flat(exports, raw_exports, "announcement", f"{LINK}, title string, _date string, _number boolean")
    return flat.select("export_id", "source", "base", "ann_no", "ann_id", "title", date_as_written(F.col("_date"), F.col("_number")).alias("posted"))


def tags_table(exports: DataFrame, raw_exports: DataFrame) -> DataFrame:
    """One row per tag of an announcement, repeated tags included."""
    return _flat(exports, raw_exports, "tag", f"{LINK}, tag string")


def paragraphs_table(exports: DataFrame, raw_exports: DataFrame) -> DataFrame:
    """One row per non-blank paragraph of a body, numbered from 1 in document order."""
    return _flat(exports, raw_exports, "paragraph", f"{LINK}, par_no long, paragraph string")


def announcement_children(exports: DataFrame, raw_exports: DataFrame) -> DataFrame:
    """Distinct children `(export_id, ann_id, child, item)` of identified announcements of both kinds of export.

    Announcements without a non-blank identifier have no rows; null arrays, null elements, blank tags and paragraphs,
    senseless dates and invalid JSON give none; repeated announcements of one export give each child once.
    """
    flat = _flat(exports, raw_exports, "child", "ann_id string, child string, _item string, _number boolean")
    item = F.when(F.col("child") == "posted", date_as_written(F.col("_item"), F.col("_number"))).otherwise(F.col("_item"))
    return flat.select("export_id", "ann_id", "child", item.alias("item")).filter("item is not null").distinct()


def unread_exports(raw_exports: DataFrame) -> DataFrame:
    """`(export_id, reason)` of JSON exports that yield nothing: unreadable ones and those without any announcement.

    'cleaned' marks exports that are read although they hold halves of surrogate pairs.
    """

    def build(levels: Levels) -> tuple[list[int], dict[str, list]]:
        held = {rec for table, _ in announcement_tables(levels) for rec in table.rec} | {i for i, _ in levels.rejects}
        none = [i for i in range(levels.records) if i not in held]
        return none, {"reason": ["no announcements"] * len(none)}

    return rejected(raw_exports, ["export_id"], "payload").unionByName(rebuilt(raw_exports, ["export_id"], "payload", build, "reason string"))
