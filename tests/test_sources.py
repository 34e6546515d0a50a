import json

from pyspark.sql import functions as F

from corpuslab.operators import records
from corpuslab.sources import readers, sinks
from corpuslab.streaming import questions as st


def test_faq_csv(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('faq_id,category,question,answer,updated\nF1,kit,"Who, me?","Line one\nline ""two""",2025-01-01\nF2,kit,Blank?,,2025-01-01\n')
    got = {r.doc_id: r.text for r in readers.faq_csv_records(spark, str(tmp_path / "faq.csv")).collect()}
    assert got == {"faq-F1": 'Who, me? Line one line "two"', "faq-F2": ""}


def test_announcement_json(spark, tmp_path):
    export = {"announcements": [{"id": "A-1", "title": "T", "meta": {"posted": "2025-01-02"}, "content": {"body": "one\n\ntwo", "tags": []}}, {"id": "A-2", "headline": "Only", "content": {"body": ""}}, {"title": "no id"}]}
    (tmp_path / "a.json").write_text(json.dumps(export, indent=1))
    got = {r.doc_id: (r.title, r.text, r.updated) for r in readers.announcement_json_records(spark, str(tmp_path)).collect()}
    assert got == {"ann-A-1": ("T", "T one two", "2025-01-02"), "ann-A-2": ("Only", "Only", "")}
    bad = records.checked(readers.announcement_json_records(spark, str(tmp_path)), "doc_id").filter("doc_id = 'ann-A-2'").first()
    assert bad.problems == ["text adds nothing beyond the title"]


def test_text_dir_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "notes_01.txt").write_text("a\nb")
    assert [tuple(r) for r in readers.read_text_dir(spark, str(tmp_path / "d")).collect()] == [("notes_01", "a\nb")]
    rows = spark.createDataFrame([("1", "f", "t", "é–£", "x", "")], readers.RECORD_SCHEMA)
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    sinks.append_jsonl(rows, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    assert "é–£" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    sinks.write_csv(spark.createDataFrame([('a "q"\nb',)], "t string"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').first()[0] == 'a "q"\nb'


def test_paths_reports_and_redaction(spark):
    assert sinks.run_path("out/", limit=5, gate=None, prompt="v2") == "out/limit=5/prompt=v2" and sinks.run_path("out") == "out/full"
    df = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert sinks.markdown_table(df).splitlines()[-1] == "| a\\|b |  |"
    assert sinks.redacted(df, ["y"]).first().y == ""


def test_pdf_runs_and_joined_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def decode(content):
        if content == b"bad":
            raise ValueError("no")
        return [(1, 1.0, 700.0, "Hello", 12.0, True, False), (1, 2.0, 700.0, "you", 12.0, True, False)]

    got = sorted((r.page or 0, r.text) for r in readers.pdf_runs(spark, str(tmp_path), decode).collect())
    assert got == [(0, "ValueError: no"), (1, "Hello"), (1, "you")]
    pages = spark.createDataFrame([("f", 2, "b  c"), ("f", 1, "a")], "file string, page int, text string")
    assert readers.joined_pages(pages, "file", "page", "text").first().text == "a b c"
    sections = spark.createDataFrame([("club", 1, "T", "body"), ("club", 2, "U", " "), ("club", 3, "V", "x")], "club string, section_no int, title string, body string")
    assert [r.doc_id for r in readers.section_records(sections, "club", "f").orderBy("doc_id").collect()] == ["club-s1", "club-s3"]
    listing = spark.createDataFrame([('{"models": [{"name": "m", "size": 1320000000}]}',)], "value string")
    assert tuple(readers.model_sizes(listing).first()) == ("m", 1.32)


def test_question_stream(spark, tmp_path):
    rows = [("q1", "2025-01-01 00:00:00"), ("q1", "2025-01-02 00:00:00"), ("q2", "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "qid string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in" / "questions.parquet"))
    stream = st.new_questions(st.stream_table(spark, str(tmp_path / "in"), "questions"))
    st.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    st.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.qid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["q1", "q2"]


def test_record_and_chat_streams(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"doc_id":"1","source_file":"f","source_type":"t","title":"T","text":" x  y ","updated":""}\n{"doc_id":"2","title":"T","text":""}\n')
    schema = ", ".join(f"{f} string" for f in records.FIELDS)
    st.run_to_end(st.ingest_records(spark, str(tmp_path / "r"), schema), str(tmp_path / "o"), str(tmp_path / "s"))
    assert [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("1", "x y")]
    spark.createDataFrame([(1, t, 10) for t in range(9)], "conv_id long, turn long, tokens long").write.parquet(str(tmp_path / "c" / "chats.parquet"))
    chats = st.trimmed_chats(st.stream_table(spark, str(tmp_path / "c"), "chats"), 50)
    q = chats.writeStream.format("memory").queryName("chats_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cs")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.turn for r in spark.sql("select * from chats_out").collect()) == [0, 5, 6, 7, 8]


def test_sinks_keep_null_keys_and_plain_cells(spark, tmp_path):
    rows = spark.createDataFrame([("é", None), ("a,b", "x")], "t string, u string")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    lines = sorted(x for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines())
    assert lines == ['{"t":"a,b","u":"x"}', '{"t":"é","u":null}']
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "c"), quoted=False)
    assert sorted(x for f in (tmp_path / "c").glob("*.csv") for x in f.read_text().splitlines()) == ['"a,b",x', "t,u", "é,"]
