"""Readers of exports and document folders, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.keys import is_blank
from corpuslab.functions.text import collapse
from corpuslab.operators.announcements import announcements_table, paragraphs_table
from corpuslab.operators.records import FIELDS, faq_records, shape

RECORD_SCHEMA = T.StructType([T.StructField(f, T.StringType(), False) for f in FIELDS])
FAQ_SCHEMA = "faq_id string, category string, question string, answer string, updated string"
QUESTION_SCHEMA = "qid string, category string, question string, expect string, answer string, keys array<string>, document string, note string"


def read_faq_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of a question and answer export: header, quotes doubled inside quotes, line breaks inside cells."""
    return spark.read.schema(FAQ_SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"')


def faq_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a question and answer export."""
    return faq_records(read_faq_csv(spark, path))


def read_json_payloads(spark: SparkSession, path: str) -> DataFrame:
    """`(export_id, payload)`: one row per JSON file, whatever its shape; the id is a hash of the file's name."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.xxhash64(F.col("_metadata.file_path")).alias("export_id"), F.col("value").alias("payload"))


def announcement_json_records(spark: SparkSession, path: str, source_file: str = "announcements.json") -> DataFrame:
    """Records of a folder of JSON announcement exports of varying shape."""
    return announcement_payload_records(read_json_payloads(spark, path), source_file)


def announcement_payload_records(payloads: DataFrame, source_file: str = "announcements.json") -> DataFrame:
    """Records of `(export_id, payload)` of JSON announcement exports: title and all paragraphs make the text.

    Announcements without an identifier are left out; one without a body has its title as its text, so that checking
    rejects it.
    """
    none = payloads.sparkSession.createDataFrame([], "export_id long, announcements array<struct<id string>>")
    own = ["export_id", "source", "base", "ann_no"]
    body = paragraphs_table(none, payloads).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("par_no", "paragraph"))).alias("p"))
    joined = announcements_table(none, payloads).filter("ann_id is not null").join(body, own, "left")
    text = F.concat_ws(" ", "title", F.concat_ws(" ", F.transform("p", lambda x: x["paragraph"])))
    return shape(
        joined.select(
            F.concat(F.lit("ann-"), "ann_id").alias("doc_id"), F.lit(source_file).alias("source_file"), F.lit("announcement").alias("source_type"),
            "title", text.alias("text"), F.col("posted").alias("updated"),
        )
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = RECORD_SCHEMA, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, and a line that is no JSON raises if `strict`, else gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, text)` of a folder of text files; the id is the file's name without its extension."""
    whole = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return whole.select(name.alias("doc_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the lines of a text file, for line-oriented formats."""
    return spark.read.text(path)


def joined_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """`(key, text)`: the pages of one file as one text with single spaces; a file's pages are a bounded group."""
    part = F.struct(order, text)
    whole = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x[text]))
    return pages.groupBy(key).agg(collapse(whole).alias("text"))


def pdf_runs(spark: SparkSession, path: str, decode: Callable[[bytes], list[tuple[int, float, float, str, float, bool, bool]]]) -> DataFrame:
    """`(file, page, across, down, text, size, bold, rotated)` of a folder of PDF files.

    The decoder is given by the caller, since no PDF library is part of this engine: it turns a file's bytes into text
    runs. A file it fails on gives one row with a null page and the error as its text, and the others go on.
    """
    schema = "file string, page int, across double, down double, text string, size double, bold boolean, rotated boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    rows = [(file, *r) for r in decode(content)]
                except Exception as e:  # noqa: BLE001
                    rows = [(file, None, None, None, f"{type(e).__name__}: {e}", None, None, None)]
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def section_records(sectioned: DataFrame, key: str, source_file: str, source_type: str = "handbook") -> DataFrame:
    """Records of sections; numbering keeps counting over sections with an empty body, which give no record."""
    numbered = sectioned.filter(~is_blank(F.col("body")))
    return shape(
        numbered.select(
            F.concat(F.col(key).cast("string"), F.lit("-s"), F.col("section_no").cast("string")).alias("doc_id"), F.lit(source_file).alias("source_file"),
            F.lit(source_type).alias("source_type"), "title", F.col("body").alias("text"), F.lit("").alias("updated"),
        )
    )


def model_sizes(listing: DataFrame, column: str = "value") -> DataFrame:
    """`(model, gb)` of the JSON listing of a model server, fetched by the caller."""
    parsed = F.from_json(column, "models array<struct<name string, size bigint>>")
    return listing.select(F.explode(parsed["models"]).alias("m")).select(F.col("m.name").alias("model"), F.round(F.col("m.size") / 1e9, 2).alias("gb"))
