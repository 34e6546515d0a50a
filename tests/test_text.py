import re

from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.keys import is_blank, norm_key


def values(spark, kind, rows, *cols):
    df = spark.createDataFrame([(r,) for r in rows], f"t {kind}")
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_tokenizers(spark):
    t = "The £38 fee, per-player: U9's 1/2 Ére rúgbi x"
    got = values(spark, "string", [t], *[tx.tokens(F.col("t"), n) for n in tx.TOKENIZERS])[0]
    by = dict(zip(tx.TOKENIZERS, got, strict=True))
    assert by["rank"][:3] == ["£38", "fee", "per-player"]
    assert by["guard"][:3] == ["fee", "per", "player"]
    assert by["word"][-3:] == ["Ére", "rúgbi", "x"]
    assert by["char"] == list(t)
    assert by["leak"][0] == "The"


def test_null_and_empty(spark):
    cols = [tx.collapse(F.col("t")), tx.squash(F.col("t")), tx.squash_alnum(F.col("t")), tx.numbers(F.col("t")), tx.sentences(F.col("t")), tx.verdict_of(F.col("t")), is_blank(F.col("t")), norm_key(F.col("t"))]
    rows = values(spark, "string", [None, "", "   \n"], *cols)
    assert rows[0] == (None, None, None, None, None, "UNPARSED", True, None)
    assert rows[1] == ("", "", "", [], [], "UNPARSED", True, None)
    assert rows[2][:2] == ("", "") and rows[2][-2:] == (True, None)


def test_numbers(spark):
    assert values(spark, "string", ["It is $240. At 9:00 am or 1,234.50 £ 7pm"], tx.numbers(F.col("t"))) == [["$240", "9:00 am", "1234.50", "7pm"]]


def test_contains_all(spark):
    keys = F.array(F.lit("Orange Flag"), F.lit("2 OARS"))
    assert values(spark, "string", ["the orangeflag and 2  oars", "orange flag"], tx.contains_all(F.col("t"), keys)) == [True, False]
    assert values(spark, "string", ["x"], tx.contains_all(F.col("t"), F.array().cast("array<string>"))) == [True]


def test_whole_words(spark):
    assert values(spark, "string", ["re reé reş re-re", "fees fee feed Fee's"], tx.whole_word_count(F.col("t"), "re")) == [3, 0]
    assert values(spark, "string", ["tickets ticket ticketing"], tx.whole_word_count(F.col("t"), "ticket")) == [2]
    assert values(spark, "string", ["pay £38 now"], tx.whole_word_count(F.col("t"), "£38")) == [1]


def test_sentences_match_python(spark):
    t = "One. Two?  Three!\nFour\n\nFive 6.5 x."
    want = [s for s in re.split(r"(?<=[.!?])\s+|\n", t) if s.strip()]
    assert values(spark, "string", [t], tx.sentences(F.col("t"))) == [want]
    spans = values(spark, "string", ["A b. C d • E"], tx.bounded_sentences(F.col("t")))[0]
    assert [s.start for s in spans] == [0, 5, 11][: len(spans)] or spans[0].start == 0
    assert "".join(s.sentence for s in spans).startswith("A b. C d")


def test_squash_offsets(spark):
    assert values(spark, "string", ["a b\n c", ""], tx.squash_offsets(F.col("t"))) == [[1, 3, 6], []]


def test_parsers(spark):
    rows = ["That is not covered in the club documents.", "is covered in the club documents", "x" * 95 + " covered in the club documents", "The claim is UNSUPPORTED", "supported", "MISSING or covered", ""]
    got = values(spark, "string", rows, tx.refusal_kind(F.col("t")), tx.verdict_of(F.col("t")), tx.gate_of(F.col("t")))
    assert [g[0] for g in got] == ["clean", "corrupt", None, None, None, None, None]
    assert [g[1] for g in got][3:5] == ["UNSUPPORTED", "SUPPORTED"]
    assert got[5][2] == "MISSING" and got[6][1:] == ("UNPARSED", "UNPARSED")


def test_key_verdicts(spark):
    df = spark.createDataFrame([(0, "abc"), (3, "abc"), (3, "£38"), (16, "long phrase"), (15, "long phrase")], "n int, k string")
    assert [r[0] for r in df.select(tx.key_verdict(F.col("n"), F.col("k"))).collect()] == ["MISSING", "too vague", "ok", "too common", "ok"]


def test_json_and_labels(spark):
    assert values(spark, "string", ['```json\n{"k": 1}\n```', '{"k": 1, "j": 2}', "no", None, "[1]"], tx.json_complies(F.col("t"), ("k",))) == [True, False, False, False, False]
    assert values(spark, "string", [" Positive. ", "maybe", None], tx.label_complies(F.col("t"), ("positive", "negative"))) == [True, False, False]


def test_windows_and_small_functions(spark):
    w = values(spark, "string", ["x" * 700, "x" * 80, "", None], tx.char_windows(F.col("t")))
    assert [(x.start, len(x.chunk)) for x in w[0]] == [(0, 420), (260, 420), (520, 180)] and w[1] == [] and w[2] == [] and w[3] == []
    assert values(spark, "string", ["club-0004-s240", "x"], tx.id_prefix(F.col("t"))) == ["club-0004", "x"]
    assert values(spark, "string", ["players", "bus", None], tx.stem(F.col("t"))) == ["player", "bus", None]
    assert values(spark, "string", ["abcab", ""], tx.substring_count(F.col("t"), F.lit("ab"))) == [2, 0]
    assert values(spark, "string", ["abcdefghij"], tx.elide(F.col("t"), 4)) == ["ab … [6 more] … ij"]


def test_secrets(spark):
    key = "-----BEGIN " + "RSA PRIVATE KEY"
    tok = "gh" + "p_" + "a" * 24
    rows = ["me@club.org", "(555) 010-1234", key, tok, "nothing", None]
    got = values(spark, "string", rows, *[c for c in tx.secret_flags(F.col("t")).values()])
    assert [g.index(True) if True in g else None for g in got] == [0, 1, 2, 3, None, None]
