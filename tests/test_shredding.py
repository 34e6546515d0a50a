import json
from collections import Counter
from datetime import datetime

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.operators.announcements import announcement_children, announcements_table, paragraphs_table, tags_table, unread_exports
from corpuslab.operators.shredding import arrow_levels, json_levels, shred

TYPED = (
    "export_id long, received_at timestamp_ntz, announcements array<struct<id:string,title:string,"
    "meta:struct<posted:string,author:string,audience:array<string>>,content:struct<body:string,tags:array<string>>>>, source string, rec string"
)
RAW = "export_id long, received_at timestamp_ntz, payload string, path string"


def children(spark, typed=(), raw=()):
    rows = announcement_children(spark.createDataFrame(list(typed), TYPED), spark.createDataFrame(list(raw), RAW)).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def ann(i="A-1", posted=None, body=None, tags=None):
    return {"id": i, "title": "t", "meta": {"posted": posted, "author": None, "audience": []}, "content": {"body": body, "tags": tags}}


def test_empty_tables(spark):
    assert children(spark) == set()


def test_nulls_at_every_level(spark):
    typed = [(1, None, None, None, None), (2, None, [], None, None), (None, None, [None, ann(None), ann(" "), {"id": "B", "title": None, "meta": None, "content": None}], "x", "y")]
    raw = [(7, None, None, None), (8, None, "not json", None), (9, None, "{}", "p"), (9, None, '{"announcements": null}', None), (9, None, '{"announcements": [null, {"id": null}]}', None), (3, None, "[" * 100_000, None)]
    assert children(spark, typed, raw) == set()


def test_typed_children_once(spark):
    a = ann("A-1 ", "05.04.2026", "one\n\n \n\ntwo\n \nthree", ["Kit ", " kit", "", None, "b, c"])
    want = {(1, "A-1", "posted", "2026-04-05"), (1, "A-1", "tag", "kit"), (1, "A-1", "tag", "b, c"), *((1, "A-1", "body", str(i)) for i in (1, 2, 3))}
    assert children(spark, [(1, datetime(2026, 1, 1), [a, a], None, None)]) == want


def test_dates(spark):
    dates = {
        "2026-04-11": "2026-04-11", "2025-08-05 00:04": "2025-08-05", "26/11/2025": "2025-11-26", "2025-08-04T23:59:00Z": "2025-08-04", "20251112": "2025-11-12",
        " 05.04.2026": "2026-04-05", "November 22, 2025": "2025-11-22", "12 May 2026": "2026-05-12", "soon": None, "": None, "31/02/2026": None, "1755944608": None,
        "2026-13-01": None, "99 May 2026": None, "5 Mud 2026": None, "Marble 3, 2024": None, "2026-04-11 or later": None, "3 Sept 2025": "2025-09-03", "2026-04-11 9:05 pm": "2026-04-11",
    }
    typed = [(i, None, [ann("A", d)], None, None) for i, d in enumerate(dates)]
    got = {r[0]: r[3] for r in children(spark, typed)}
    assert got == {i: v for i, v in enumerate(dates.values()) if v}


def test_json_variants(spark):
    one = {"announcement_id": "A", "info": {"timestamp": 86399}, "details": {"body": {"sections": [{"heading": "H", "paragraphs": [{"text": "x"}, {"text": " "}]}, {"paragraphs": ["y", None]}]}, "tags": "a; B,,c"}}
    two = {"announcementId": "B", "meta": {"date": "1755944608"}, "content": {"body": [{"type": "p", "text": "x"}, {"type": "p", "content": "y"}, None, ""], "tags": [["k"], []]}}
    three = {"id": "C", "metadata": {"published": 1.5e9}, "content": {"body": {"message": "p\n\nq"}, "tags": [{"label": "L", "weight": 3}, {"name": "N"}]}}
    raw = [(1, None, json.dumps({"data": {"announcements": [one]}}), None), (2, None, json.dumps({"pages": [{"announcements": [two]}, {"announcements": []}, {"announcements": [three]}]}), None), (3, None, json.dumps([two]), None)]
    got = children(spark, (), raw)
    assert {r for r in got if r[0] == 1} == {(1, "A", "posted", "1970-01-01"), (1, "A", "tag", "a"), (1, "A", "tag", "b"), (1, "A", "tag", "c"), (1, "A", "body", "1"), (1, "A", "body", "2")}
    assert {r for r in got if r[0] == 2} == {(2, "B", "tag", "k"), (2, "B", "body", "1"), (2, "B", "body", "2"), (2, "C", "posted", "2017-07-14"), (2, "C", "tag", "l"), (2, "C", "tag", "n"), (2, "C", "body", "1"), (2, "C", "body", "2")}
    assert {r[1:] for r in got if r[0] == 3} == {r[1:] for r in got if r[1] == "B"}


def test_very_long_body(spark):
    body = "\n\n".join(f"p{i}" for i in range(5000))
    assert len(children(spark, [(1, None, [ann("A", None, body)], None, None)])) == 5000


def test_links_of_flat_tables(spark):
    typed = spark.createDataFrame([(1, None, [ann("A", None, "x\n\ny", ["k"]), None, ann("B", None, "z", ["l", "m"])], None, None)], TYPED)
    paged = {"pages": [{"announcements": [None, {"id": "C", "tags": ["n"]}]}, {"announcements": []}, {"announcements": [{"id": " ", "title": "T", "body": "p"}]}]}
    raw = spark.createDataFrame([(2, None, json.dumps(paged), None)], RAW)
    rows = announcements_table(typed, raw).orderBy("export_id", "ann_no").collect()
    assert [(r.export_id, r.base, r.ann_no, r.ann_id) for r in rows] == [
        (1, ".announcements[]", 1, "A"), (1, ".announcements[]", 3, "B"), (2, ".pages[].announcements[]", 2, "C"), (2, ".pages[].announcements[]", 3, ""),
    ][:3] + [(2, ".pages[].announcements[]", 3, None)]
    assert sorted((r.export_id, r.ann_no, r.tag) for r in tags_table(typed, raw).collect()) == [(1, 1, "k"), (1, 3, "l"), (1, 3, "m"), (2, 2, "n")]
    assert sorted((r.export_id, r.ann_no, r.par_no, r.paragraph) for r in paragraphs_table(typed, raw).collect()) == [(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 3, 1, "z"), (2, 3, 1, "p")]


def test_dirty_payloads_end_no_job_and_leave_a_row(spark):
    deep = '{"announcements": [{"id": "D"}], "x": ' + "[" * 100_000 + "]" * 100_000 + "}"
    half = '{"announcements": [{"id": "S", "body": "a\\ud800b", "tags": ["\\ud83d\\ude00"]}]}'
    other = '{"announcements": [{"id": "E", "a.b": {"c": 1}, "a": {"b": {"c": 2}}, "a[]": 3, "body": "x"}], "deep": ' + "[" * 50 + "1" + "]" * 50 + "}"
    raw = [(1, None, deep, None), (2, None, half, None), (3, None, other, None), (4, None, '{"items": [1]}', None), (5, None, "nope", None), (6, None, None, None)]
    assert children(spark, (), raw) == {(2, "S", "body", "1"), (2, "S", "tag", "😀"), (3, "E", "body", "1")}
    got = {tuple(r) for r in unread_exports(spark.createDataFrame(raw, RAW)).collect()}
    assert got == {(1, "nested too deep"), (2, "cleaned"), (4, "no announcements"), (5, "no JSON"), (6, "null")}


VALUES = st.recursive(st.none() | st.integers(0, 9).map(str), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "a.b"]), x, max_size=3), max_leaves=12)


def elements(value, path=""):
    """Every element of every array with its path and what stands in it directly."""
    if isinstance(value, dict):
        for k, x in value.items():
            yield from elements(x, f"{path}.{k.replace('.', '%2E')}")
    elif isinstance(value, list):
        for x in value:
            yield f"{path}[]", x
            yield from elements(x, f"{path}[]")


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=3))
def test_tables_of_every_ancestor(values):
    """The tables put together from levels hold each element of each array once, with what stands in it."""
    levels = json_levels([json.dumps(v) for v in values])
    for ancestor in levels.ancestors():
        table = levels.table(ancestor)
        want = Counter()
        for rec, value in enumerate(values):
            with_leaf = {p for p, s in levels.sequences.items() if rec in s.rec and p.startswith(ancestor)}
            for n, (_, x) in enumerate(((p, x) for p, x in elements(value) if p == ancestor), 1):
                if with_leaf:
                    want[rec, n, x if isinstance(x, str) else None, x.get("a") if isinstance(x, dict) and isinstance(x.get("a"), str) else None] += 1
        own, a = table.columns.get("", [None] * len(table.rec)), table.columns.get(".a", [None] * len(table.rec))
        assert Counter(zip(table.rec, table.number, own, a, strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(st.none() | st.fixed_dictionaries({"a": st.none() | st.lists(st.none() | st.integers(0, 9), max_size=3), "b": st.none() | st.text("xy", max_size=2)}), max_size=3), max_size=4))
def test_both_front_ends_agree(values):
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int64())), ("b", pa.string())]))
    typed = arrow_levels(pa.array([None, *values], kind).slice(1))
    other = json_levels([json.dumps(v) for v in values])
    for path in (".a", "[].a[]", "[].b"):
        s, o = typed.sequences.get(path), other.sequences.get(path)
        if o is not None:
            for rec in set(o.rec):  # a path that no element of a record has is unknown to JSON
                got = [(int(r), int(d), v) for x, r, d, v in zip(s.rec, s.r, s.d, s.v, strict=True) if x == rec]
                assert got == [(r, d, v) for x, r, d, v in zip(o.rec, o.r, o.d, o.v, strict=True) if x == rec]


def test_levels_as_rows(spark):
    df = spark.createDataFrame([(1, '{"a": [1, "x"], "b": null}', "c"), (2, "oops", "c"), (3, None, "c")], "k long, v string, rec string")
    got = sorted((r.k, r.path, r.r, r.d, r.v, r.is_num) for r in shred(df.drop("rec"), ["k"], "v").collect())
    assert got == [(1, ".a[]", 0, 4, "1", True), (1, ".a[]", 1, 4, "x", False)]
    assert shred(df.limit(0).drop("rec"), ["k"], "v").count() == 0


def test_maps_and_binary_values():
    kind = pa.struct([("m", pa.map_(pa.string(), pa.list_(pa.int64()))), ("b", pa.binary())])
    levels = arrow_levels(pa.array([{"m": [("x", [1, 2]), ("y", [])], "b": b"\xff"}, {"m": None, "b": None}, None], kind))
    table = levels.table(".m[]")
    assert (table.rec, table.number, table.columns[".key"]) == ([0, 0], [1, 2], ["x", "y"])
    inner = levels.table(".m[].value[]")
    assert inner.columns[""] == ["1", "2"] and levels.sequences[".b"].v == ["ff", None, None]
