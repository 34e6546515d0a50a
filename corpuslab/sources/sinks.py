"""Sinks: JSON lines, CSV, suffixed run folders and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line with every key, nulls as null, text unescaped."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows; every commit writes files of its own, so no line can run into another."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quoted: bool = True) -> None:
    """CSV with a header; quotes are doubled inside quotes and line breaks inside cells kept in quotes.

    With `quoted` false only cells that need quotes have them, so that plain cells read as if joined by commas.
    """
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", quoted).csv(path)


def run_path(base: str, **parts: object) -> str:
    """The folder of a run by its settings, so that a partial run never takes the place of a full one."""
    kept = [f"{k}={v}" for k, v in sorted(parts.items()) if v not in (None, False, "")]
    return "/".join([base.rstrip("/"), *(kept or ["full"])])


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; raises if it has more than `most` rows, since a report is made on the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(lines)


def redacted(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the named columns, null texts as empty ones."""
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in keep])
