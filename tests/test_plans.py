from datetime import datetime

import pytest

import __spark_entry__ as entry


@pytest.fixture
def run(spark, tmp_path):
    """Runs a registered query over tables given as `name=(rows, schema)`."""

    def made(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return entry.queries()[query](spark, str(tmp_path)).collect()

    return made


def test_evidence_takes_the_whole_passage(run):
    start = "Members meet beside the pavilion every morning. " * 3
    item = start + "Defibrillator cabinets hang behind reception."
    docs = [(1, "The defibrillator is kept behind the reception desk."), (2, "Nothing of that kind is written in this document.")]
    got = run("evidence_top3", eval_items=([(7, "safety", item)], "item_id long, category string, text string"), documents=(docs, "doc_id long, text string"))
    assert len(start) > 120 and [(r.qid, r.place, r.doc_id) for r in got] == [(7, 1, 1)]


DOCUMENTS = "doc_id long, title string, text string, source string"
ITEMS = "item_id long, category string, text string"
PASSAGE = "Orange lanterns guide boats home. They hang along the eastern pier until the last sailor returns"


def test_passages_are_asked_whole(run):
    items = ([(7, "safety", PASSAGE)], ITEMS)
    documents = ([(1, None, "orange lanterns", "a"), (2, None, "eastern boats and orange lanterns", "b"), (3, None, "nothing of the kind", "c")], DOCUMENTS)
    got = {r.doc_id: r.score for r in run("bm25_top5", eval_items=items, documents=documents)}
    assert got[2] > got[1] > got[3] == 0


def test_keys_are_proposed_for_whole_passages(run):
    documents = ([(1, None, "At the eastern pier 12 places are kept for visitors.", "a")], DOCUMENTS)
    got = run("proposed_keys", eval_items=([(7, "safety", PASSAGE)], ITEMS), documents=documents)
    assert [r.doc_id for r in got] == [1]


def test_titles_are_indexed(run):
    documents = ([(1, "Lanterns", "lie in the boathouse", "a"), (2, None, "lanterns", "b"), (3, "Lanterns", None, "c"), (4, None, None, "d")], DOCUMENTS)
    assert {r.term: (r.df, r.cf) for r in run("term_df", documents=documents)}["lanterns"] == (3, 3)
    lengths = {r.doc_id: r.dl for r in run("doc_len", documents=documents)}
    assert (lengths[1], lengths[2], lengths[3], lengths[4]) == (3, 1, 1, 0)
    got = {r.doc_id: r.score for r in run("bm25_top5", eval_items=([(7, "safety", "lanterns")], ITEMS), documents=documents)}
    assert {k for k, v in got.items() if v > 0} == {1, 2, 3}


def test_answers_without_a_record_are_judged(run):
    faq = [(f"F000000{i}", "When is the levy due?", "The levy is due in March every year.") for i in (1, 2, 3)]
    records = [("faq-F0000002", "The levy is due in March every year. Pay at the gate.", "2025-01-01")]
    tables = {"faq_export": (faq, "faq_id string, question string, answer string"), "records": (records, "doc_id string, text string, loaded_at string")}
    assert {r.qid: r.grounding for r in run("grounding", **tables)} == {"F0000001": 1.0, "F0000002": 0.0, "F0000003": 0.0}
    assert {r.qid: r.reason for r in run("guard_reason", **tables)} == {"F0000001": "", "F0000002": "grounding", "F0000003": "grounding"}
    assert {(r.run, r.verdict): r.n for r in run("run_totals", **tables)} == {("a", "SUPPORTED"): 1, ("a", "UNSUPPORTED"): 2, ("b", "SUPPORTED"): 1, ("b", "UNSUPPORTED"): 2}
    assert {r.qid: r.change for r in run("run_diff", **tables)} == {"F0000001": "FIXED", "F0000002": "BROKE"}


def test_coverage_has_every_category(run):
    questions = [("kit", "answerable"), ("kit", "refuse"), ("media", "refuse"), (None, "answerable")]
    got = {r.category: (r.n, r.refuse) for r in run("coverage", questions_public=(questions, "category string, expect string"))}
    assert got == {"kit": (2, 1), "media": (1, 1), None: (1, 0), "fees": (0, 0), "safety": (0, 0), "travel": (0, 0), "weather": (0, 0), "total": (4, 2)}


def test_open_windows_come_out(run):
    events = [(datetime(2025, 1, 1, 10, m), "click", 1.5) for m in (0, 1, 30, 31, 32)]
    got = run("event_window_stream", events=(events, "ts timestamp, event_type string, value double"))
    assert sorted((r.n, r.total) for r in got) == [(2, 3.0), (3, 4.5)]
