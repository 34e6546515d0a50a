import math
from collections import Counter
from datetime import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import terms, tokens

REC = "doc_id string, source_file string, source_type string, title string, text string, lang string, topic string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string, unit string, term string, tf string, df string, n string, tokens string"


def rec(doc_id, title, text, day=1, source_type="faq", lang="en", topic="kit"):
    return (doc_id, "f", source_type, title, text, lang, topic, dt(2025, 1, day) if day else None, None, *["clash"] * 7)


ROWS = [
    rec("a", "Boat shed", "boat Boat boats, the boat: Éléphant éléphant", 1), rec("a", "Old", "zebra zebra zebra", None), rec("a", "Old", "zebra zebra zebra", 0),
    rec("b", "Boat", "boat boat and shed", 2), rec("b", "Boat", "boat boat and shed", 2), rec("c", None, None), rec("d", "", ""), rec(None, "boat boat boat", "boat"), rec("e", "x", "lonely lonely lonely"),
]


def test_scores_against_formula(frame):
    got = {(r.doc_id, r.term): r for r in terms.distinctive_terms(frame(ROWS, REC)).collect()}
    docs = {"a": Counter(["boat", "shed", "boat", "boat", "boats", "boat", "éléphant", "éléphant"]), "b": Counter(["boat", "boat", "boat", "shed"]), "e": Counter(["lonely"] * 3)}
    assert {k: r.tf for k, r in got.items()} == {(d, t): n for d, c in docs.items() for t, n in c.items()}
    n, total = len(docs), sum(sum(c.values()) for c in docs.values())
    for (d, t), r in got.items():
        tfn = r.tf * math.log2(1 + total / n / sum(docs[d].values()))
        mean = sum(c[t] for c in docs.values()) / n
        assert r.score == pytest.approx((math.log2(1 + mean) + tfn * math.log2((1 + mean) / mean)) / (1 + tfn))
    found = terms.distinctive_terms(frame(ROWS, REC), min_tf=3, min_df=2, max_df=6)
    assert {(r.doc_id, r.term) for r in found.collect()} == {("a", "boat"), ("b", "boat")}
    assert terms.distinctive_terms(frame([], REC)).count() == 0


def test_hot_terms_are_whole(frame, monkeypatch):
    rows = [rec(f"d{i}", "common", "common " * (i % 3) + f"only{'abcdefghij'[i % 10]}x") for i in range(60)]
    plain = sorted(tuple(r) for r in terms.distinctive_terms(frame(rows, REC)).collect())
    monkeypatch.setattr(terms, "HOT", 1e-9)
    assert len(plain) == 120 and plain == sorted(tuple(r) for r in terms.distinctive_terms(frame(rows, REC)).collect())


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.sets(st.text("abc", min_size=1, max_size=4)))
def test_greedy_pieces(unit, vocabulary):
    pieces, longest = frozenset(vocabulary), max(map(len, vocabulary), default=1)
    n, rest = 0, unit
    while rest:
        best = max((p for p in pieces if rest.startswith(p)), key=len, default=rest[0])
        rest, n = rest[len(best) :], n + 1
    assert tokens.piece_count(unit, pieces, longest) == n


def test_token_counts_and_checks(frame):
    vocab = frame([(1, "boat"), (2, "bo"), (3, None), (4, "ü")], "piece_id long, piece string")
    rows = [rec("A ", "t", "Boat bobo, x_1 Ü  é!😀", 1, " FAQ"), rec("b", "t", "boat", 1, None, None, None), rec("c", "t", None), rec("d", "t", ""), rec("e", "t", "boat " * 20_000)]
    totals = tokens.record_tokens(frame(rows, REC), vocab)
    got = {r.key: r.tokens for r in totals.collect()}
    assert got == {"a": 1 + 2 + 1 + 3 + 1 + 1 + 1 + 1, "b": 1, "c": 0, "d": 0, "e": 20_000}
    published = [(1, "a", 11), (2, "A", 13), (3, " a", 14), (4, "a", None), (5, "a", 0), (6, "a", -3), (7, "zz", None), (8, None, 1), (9, " ", 1), (10, "c", 1), (11, "d", 0), (12, "e", 20_001), (12, "e", 90)]
    counts = frame([(i, d, s, "x") for i, d, s in published], "row_id long, doc_id string, subword long, tokens string")
    assert sorted(r.row_id for r in tokens.unusable_counts(counts, totals).collect()) == [3, 4, 5, 6, 10, 11, 12]
    official = frame([("faq", 1)], "source_type string, docs long")
    report = {(r.source_type, r.lang, r.topic): (r.docs, r.tokens) for r in tokens.token_totals(totals, official).collect()}
    assert report == {("faq", "en", "kit"): (4, 20_011), ("unknown", "unknown", "unknown"): (1, 1)}
    assert tokens.record_tokens(frame([], REC), vocab).count() == 0
    assert tokens.unusable_counts(counts.limit(0), totals).count() == 0
    assert {r.key: r.tokens for r in tokens.record_tokens(frame(rows, REC), vocab.limit(0)).collect()}["b"] == 4


def test_hot_and_cold_units_give_the_same_total(frame, monkeypatch):
    vocab = frame([(1, "boat")], "piece_id long, piece string")
    rows = [rec(f"d{i}", "t", "boat shed " + f"rare{i} " * (i % 4)) for i in range(50)]
    plain = sorted((r.key, r.tokens) for r in tokens.record_tokens(frame(rows, REC), vocab).collect())
    monkeypatch.setattr(tokens, "HOT", 0.05)
    assert plain == sorted((r.key, r.tokens) for r in tokens.record_tokens(frame(rows, REC), vocab).collect())
