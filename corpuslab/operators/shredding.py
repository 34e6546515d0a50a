"""Columnar shredding of nested records with repetition and definition levels, and its inverse.

A nested record becomes one *level sequence* per leaf path: entries `(rec, seq, r, d, v, is_num)`. `r` is the repetition
level (the array depth at which this entry starts a new element, 0 for the first entry of a record), `d` the definition
level (how many nodes of the path are there: 1 for every object, array and value that is not null and 1 for every
element of an array), `v` the value as text, null where the path breaks off early, and `seq` the entry's place in the
record's walk. Absent branches leave an entry too, so the sequences of all leaves below one array stay aligned, and the
table of any repeated ancestor can be put together again from the sequences alone (`Levels.table`).

Two front ends give the same sequences, a batch of records at a time: `arrow_levels` for typed columns (array arithmetic
on the offsets and validity of the Arrow column, no value is touched) and `json_levels` for JSON text of varying shape.
`shred` makes them a DataFrame; `rebuilt` puts tables together in the same narrow pass, so that levels never move.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\[\]|\.[^.\[]*")


def field_step(name: str) -> str:
    """A field's step of a path; characters that mean something in paths are written as in addresses."""
    return "." + (name.replace("%", "%25").replace(".", "%2E").replace("[", "%5B") if re.search(r"[%.\[]", name) else name)


def depth_of(path: str) -> int:
    """How many arrays a path goes through."""
    return path.count("[]")


def slot_level(path: str) -> int:
    """The least definition level at which the element exists that a path ending in `[]` leads to."""
    return sum(2 if step == "[]" else 1 for step in _STEP.findall(path))


@dataclass
class Sequence:
    """The level sequence of one leaf path over a batch of records, in order of record."""

    path: str
    rec: list[int] | np.ndarray = field(default_factory=list)
    seq: list[int] | np.ndarray = field(default_factory=list)
    r: list[int] | np.ndarray = field(default_factory=list)
    d: list[int] | np.ndarray = field(default_factory=list)
    v: list[str | None] = field(default_factory=list)
    is_num: list[bool] = field(default_factory=list)

    def numbers(self, ancestor: str) -> tuple[np.ndarray, np.ndarray]:
        """`(number, exists)` of each entry: the place of its element of the ancestor among those of its record, from 1.

        An entry opens an element where `r` is at most the ancestor's depth and `d` says that the element exists.
        """
        exists = np.asarray(self.d) >= slot_level(ancestor)
        opened = np.cumsum((np.asarray(self.r) <= depth_of(ancestor)) & exists)
        rec = np.asarray(self.rec)
        first = np.flatnonzero(np.diff(rec, prepend=-1))
        before = np.where(first > 0, opened[first - 1], 0)
        return opened - np.repeat(before, np.diff(np.append(first, len(rec)))), exists


@dataclass
class Table:
    """The flat table of a repeated ancestor: one row per element, `columns` by the rest of the leaf's path."""

    ancestor: str
    rec: list[int]
    number: list[int]
    columns: dict[str, list[str | None]]
    is_num: dict[str, list[bool]]


@dataclass
class Levels:
    """The level sequences of a batch of records by leaf path, and the records that could not be read."""

    records: int
    sequences: dict[str, Sequence] = field(default_factory=dict)
    rejects: list[tuple[int, str]] = field(default_factory=list)
    cleaned: list[int] = field(default_factory=list)

    def ancestors(self) -> list[str]:
        """Every repeated ancestor of a leaf, as a path that ends in `[]`."""
        return list(dict.fromkeys(path[: m.end()] for path in self.sequences for m in re.finditer(r"\[\]", path)))

    def below(self, ancestor: str) -> list[tuple[str, Sequence]]:
        """`(rest of the path, sequence)` of the leaves below an ancestor."""
        n = len(ancestor)
        return [(p[n:], s) for p, s in self.sequences.items() if p.startswith(ancestor) and (len(p) == n or p[n] in ".[")]

    def table(self, ancestor: str) -> Table:
        """The table of an ancestor, from the levels alone; `number` links it to the tables of the arrays below.

        Elements are those of any leaf below; leaves without a further array make its columns, null where absent.
        """
        own = self.below(ancestor)
        keys, found = [], []
        for rest, s in own:
            number, exists = s.numbers(ancestor)
            at = np.flatnonzero(exists & (np.asarray(s.r) <= depth_of(ancestor)))
            keys.append(np.asarray(s.rec)[at].astype(np.int64) << 32 | number[at])
            if "[]" not in rest:
                found.append((rest, s, at, keys[-1]))
        every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        columns, is_num = {}, {}
        for rest, s, at, key in found:
            values, numbers = [None] * len(every), [False] * len(every)
            for to, i in zip(np.searchsorted(every, key).tolist(), at.tolist(), strict=True):
                values[to], numbers[to] = s.v[i], s.is_num[i]
            columns[rest], is_num[rest] = values, numbers
        return Table(ancestor, (every >> 32).tolist(), (every & 0xFFFFFFFF).tolist(), columns, is_num)


def _arrow(out: Levels, value: pa.Array, path: str, rec: np.ndarray, r: np.ndarray, d: np.ndarray, at: np.ndarray, depth: int) -> None:
    """Add the sequences below `value`; entry i looks at place `at[i]` of it, at none if that is negative."""
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    known = np.append(np.asarray(value.is_valid()), False)
    there = known[np.where(at < 0, len(value), at)]
    here = d + there
    at = np.where(there, at, -1)
    if pa.types.is_struct(value.type):
        for i in range(value.type.num_fields):
            _arrow(out, pc.struct_field(value, [i]), path + field_step(value.type.field(i).name), rec, r, here, at, depth)
    elif pa.types.is_list(value.type) or pa.types.is_large_list(value.type) or pa.types.is_map(value.type):
        entries = pa.StructArray.from_arrays([value.keys, value.items], ["key", "value"]) if pa.types.is_map(value.type) else value.values
        offsets = np.asarray(value.offsets).astype(np.int64)
        size = np.append(np.diff(offsets), 0)[at]
        times = np.maximum(size, 1)
        of = np.repeat(np.arange(len(at)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        filled = size[of] > 0
        inner = np.where(filled, offsets[:-1][at[of]] + nth if len(value) else -1, -1)
        _arrow(out, entries, f"{path}[]", rec[of], np.where(nth > 0, depth + 1, r[of]), here[of] + filled, inner, depth + 1)
    else:
        raw = pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type)
        text = [None if x is None else x.hex() for x in value.to_pylist()] if raw else pc.cast(value, pa.string()).to_pylist()
        number = pa.types.is_integer(value.type) or pa.types.is_floating(value.type) or pa.types.is_decimal(value.type)
        v = [text[i] if i >= 0 else None for i in at.tolist()]
        out.sequences[path] = Sequence(path, rec, np.arange(len(rec)), r, here, v, [number] * len(v))


def arrow_levels(column: pa.Array, root: str = "") -> Levels:
    """Level sequences of a typed nested column; `root` is the path of the column itself, whose parents are there.

    A map is an array of `key` and `value`; binary values are written in hexadecimal.
    """
    n = len(column)
    out = Levels(n)
    zero = np.zeros(n, np.int64)
    _arrow(out, column, root, np.arange(n), zero, zero + root.count("."), np.arange(n), 0)
    return out


class _Node:
    """The shape of one place in a record: it may hold scalars, objects and arrays side by side."""

    __slots__ = ("elem", "fields", "leaf")

    def __init__(self) -> None:
        self.leaf: Sequence | bool = False
        self.fields: dict[str, _Node] = {}
        self.elem: _Node | None = None

    def see(self, value: object) -> None:
        if isinstance(value, dict):
            for name, x in value.items():
                self.fields.setdefault(name, _Node()).see(x)
        elif isinstance(value, list):
            self.elem = self.elem or _Node()
            for x in value:
                self.elem.see(x)
        elif value is not None:
            self.leaf = True

    def name(self, path: str, sequences: dict[str, Sequence]) -> None:
        if self.leaf:
            self.leaf = sequences[path] = Sequence(path)
        for name, node in self.fields.items():
            node.name(path + field_step(name), sequences)
        if self.elem is not None:
            self.elem.name(f"{path}[]", sequences)


def _walk(node: _Node, value: object, rec: int, seq: int, r: int, d: int, depth: int) -> int:
    """Append the entries below a node and return the next place in the record's walk."""
    if node.leaf:
        s = node.leaf
        s.rec.append(rec)
        s.seq.append(seq)
        s.r.append(r)
        if value is None or isinstance(value, dict | list):
            s.d.append(d)
            s.v.append(None)
            s.is_num.append(False)
        else:
            s.d.append(d + 1)
            s.v.append(value if isinstance(value, str) else json.dumps(value))
            s.is_num.append(isinstance(value, int | float) and not isinstance(value, bool))
        seq += 1
    if node.fields:
        held = value if isinstance(value, dict) else None
        for name, sub in node.fields.items():
            seq = _walk(sub, None if held is None else held.get(name), rec, seq, r, d + (held is not None), depth)
    if node.elem is not None:
        items = value if isinstance(value, list) else None
        if items:
            for i, x in enumerate(items):
                seq = _walk(node.elem, x, rec, seq, depth + 1 if i else r, d + 2, depth + 1)
        else:
            seq = _walk(node.elem, None, rec, seq, r, d + (items is not None), depth + 1)
    return seq


def _without_surrogates(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def json_levels(payloads: list[str | None]) -> Levels:
    """Level sequences of JSON texts, each with a schema of its own.

    Texts that are null, no JSON or nested beyond what the parser takes give no entries but a reject with the reason.
    Halves of surrogate pairs, which no text can hold, become question marks; `cleaned` lists those records.
    """
    out = Levels(len(payloads))
    for rec, payload in enumerate(payloads):
        if payload is None:
            out.rejects.append((rec, "null"))
            continue
        try:
            if "\\ud" in payload or "\\uD" in payload:
                value = json.loads(payload)
                text = json.dumps(value, ensure_ascii=False)
                if (clean := _without_surrogates(text)) != text:
                    value = json.loads(clean)
                    out.cleaned.append(rec)
            else:
                value = json.loads(payload)
            root = _Node()
            root.see(value)
            names: dict[str, Sequence] = {}
            root.name("", names)
            _walk(root, value, rec, 0, 0, 0, 0)
        except ValueError:
            out.rejects.append((rec, "no JSON"))
            continue
        except RecursionError:
            out.rejects.append((rec, "nested too deep"))
            continue
        for path, s in names.items():
            whole = out.sequences.setdefault(path, Sequence(path))
            for part, more in ((whole.rec, s.rec), (whole.seq, s.seq), (whole.r, s.r), (whole.d, s.d), (whole.v, s.v), (whole.is_num, s.is_num)):
                part.extend(more)
    return out


def levels_of(column: pa.Array, root: str = "") -> Levels:
    """Level sequences of a column of a batch, JSON if it is text."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return json_levels(column.to_pylist())
    return arrow_levels(column, root)


def rebuilt(df: DataFrame, keys: list[str], column: str, build: Callable[[Levels], tuple[list[int], dict[str, list]]], schema: str, root: str = "", rows: int = 1000) -> DataFrame:
    """Shred a nested column and put tables together from its levels, in one narrow pass: `(*keys, *schema)`.

    `build` turns the levels of at most `rows` records into the record number of each row and the row's columns. Nothing
    but the finished rows leaves the pass.
    """
    fields = T._parse_datatype_string(schema).fields  # noqa: SLF001
    base = df.select(*keys, F.col(column).alias("_nested"))
    made = T.StructType([*[f for f in base.schema.fields if f.name != "_nested"], *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                nested = part.column(part.num_columns - 1)
                at, columns = build(levels_of(nested, root))
                taken = [part.column(i).take(pa.array(at, pa.int64())) for i in range(part.num_columns - 1)]
                built = [pa.array(columns[f.name], arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip([*taken, *built], arrow, strict=True)], schema=arrow)

    return base.mapInArrow(run, made)


LEVEL_SCHEMA = "rec long, path string, seq int, r int, d int, v string, is_num boolean"


def shred(df: DataFrame, keys: list[str], column: str, root: str = "") -> DataFrame:
    """The level sequences of a nested or JSON column as rows `(*keys, rec, path, seq, r, d, v, is_num)`.

    `rec` numbers the records of the table. A null typed column gives one entry per leaf; unreadable JSON gives none
    (see `rejected`), an empty table no rows.
    """

    def build(levels: Levels) -> tuple[list[int], dict[str, list]]:
        out: dict[str, list] = {x.split()[0]: [] for x in LEVEL_SCHEMA.split(", ") if not x.startswith("rec")}
        at: list[int] = []
        for path, s in levels.sequences.items():
            at.extend(map(int, s.rec))
            out["path"].extend([path] * len(s.v))
            for name in ("seq", "r", "d"):
                out[name].extend(map(int, getattr(s, name)))
            out["v"].extend(s.v)
            out["is_num"].extend(s.is_num)
        return at, out

    numbered = df.select(*keys, column).withColumn("rec", F.monotonically_increasing_id())
    return rebuilt(numbered, [*keys, "rec"], column, build, LEVEL_SCHEMA.split(", ", 1)[1], root)


def rejected(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`(*keys, reason)` of the JSON texts that give no entries, and 'cleaned' for those with halves of surrogate pairs."""

    def build(levels: Levels) -> tuple[list[int], dict[str, list]]:
        rows = [*levels.rejects, *((i, "cleaned") for i in levels.cleaned)]
        return [i for i, _ in rows], {"reason": [x for _, x in rows]}

    return rebuilt(df, keys, column, build, "reason string")
