from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import orphans

REC = "doc_id string, source_file string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string, parent string"
TC = "row_id long, doc_id string, loaded_at timestamp_ntz, key string, salt long"
Q = "row_id long, document string, loaded_at timestamp_ntz"


def run(spark, records=(), counts=(), questions=(), metadata=()):
    make = spark.createDataFrame
    out = orphans.handbook_references(make(list(records), REC), make(list(counts), TC), make(list(metadata), TC), make(list(questions), Q))
    return sorted(tuple(r) for r in out.collect())


def test_reasons(spark):
    records = [
        ("A", "f1.pdf", dt(2025, 1, 1), None, None, None), ("A", "f1.pdf", dt(2025, 1, 5), dt(2025, 2, 1), None, None),
        ("B", "f2.pdf", dt(2025, 3, 1), dt(2025, 4, 1), None, None), ("B", "f2.pdf", dt(2025, 3, 2), dt(2025, 4, 2), None, None), (None, None, None, None, None, None),
    ]
    counts = [
        (1, " a ", dt(2025, 3, 1), "x", 1), (2, "b", dt(2025, 2, 1), None, None), (3, "B", dt(2025, 4, 2), None, None), (4, "B", dt(2025, 4, 1), None, None),
        (5, "c", dt(2025, 5, 1), None, None), (5, "c", dt(2025, 5, 1), None, None), (6, None, dt(2025, 5, 1), None, None), (7, "  ", dt(2025, 5, 1), None, None), (8, "c", None, None, None), (9, "a", None, None, None),
    ]
    questions = [(1, "F2", dt(2025, 1, 1)), (2, "f1", dt(2025, 1, 1)), (3, "f1.pdf", dt(2025, 6, 1)), (4, "", dt(2025, 6, 1))]
    got = run(spark, records, counts, questions)
    assert got == sorted(
        [
            ("token_counts", 2, "2025-02", "late"), ("token_counts", 3, "2025-04", "deleted"), ("token_counts", 5, "2025-05", "missing"), ("token_counts", 5, "2025-05", "missing"),
            ("token_counts", 8, None, "missing"), ("questions_public", 1, "2025-01", "late"), ("questions_public", 3, "2025-06", "missing"),
        ],
        key=lambda r: (r[0], r[1], r[2] or ""),
    )


def test_empty(spark):
    assert run(spark) == []
    assert run(spark, [("A", "f", dt(2025, 1, 1), None, None, None)]) == []


@pytest.mark.parametrize("hot", [1 / 1000, 1 / 10])
def test_hot_key_is_salted_and_whole(spark, hot):
    n = 9000
    at = dt(2025, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", at) for i in range(n)]
    children = orphans.child_rows(spark.createDataFrame(rows, "row_id long, doc_id string, loaded_at timestamp_ntz"), "t", "doc_id", "doc")
    parents = orphans.parent_rows(spark.createDataFrame([(f"k{i}", at, None) for i in range(1, n, 3)], "doc_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"), F.col("doc_id"), "doc")
    found = orphans.orphan_references(children, parents, n, hot=hot, salts=8)
    got = sorted(r.row_id for r in found.collect())
    assert got == sorted(i for i in range(n) if i % 3 == 0 or i % 3 == 2)
    report = orphans.orphan_report(found).collect()
    assert [(r.ref_month, r.reason, r.n) for r in report] == [("2025-01", "missing", 6000)]
