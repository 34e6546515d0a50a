"""Extension: the batch operators that make sense on streams. The systems this engine replaces have no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslab.operators.records import shape


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream, file or folder, with the schema of what is there."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{root}/{name[:-1]}[{name[-1]}].parquet")


def new_questions(stream: DataFrame, lateness: str = "3650 days") -> DataFrame:
    """Questions as they come in, each id once; ids older than `lateness` behind the newest row are forgotten."""
    timed = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["qid"])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available to a Parquet folder and stop; a restart goes on where the last one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write the changed rows of every batch to a Parquet folder `batch=...` of its own and stop, open windows included."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of JSON-lines files as they arrive, in the six-field form, empty texts and titles left out."""
    raw = spark.readStream.schema(schema).json(folder)
    made = shape(raw)
    return made.filter((F.trim("text") != "") & (F.trim("title") != "") & (F.trim("text") != F.trim("title")))


def trimmed_chats(stream: DataFrame, budget: int) -> DataFrame:
    """After each batch the messages `(conv_id, turn, tokens)` each chat of it still holds within its budget.

    The state of a chat is its first message and the newest ones that fit, so it is bounded by the budget.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(int(a), int(b)) for a, b in zip(*state.get, strict=True)] if state.exists else []
        for batch in batches:
            held += list(batch[["turn", "tokens"]].itertuples(index=False, name=None))
        held = sorted(set(held))
        while len(held) > 3 and sum(n for _, n in held) > budget:
            del held[1:3]
        state.update(([t for t, _ in held], [n for _, n in held]))
        yield pd.DataFrame([(key[0], t, n) for t, n in held], columns=["conv_id", "turn", "tokens"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, tokens long", "turns array<long>, sizes array<long>", "update", GroupStateTimeout.NoTimeout)


def event_windows(stream: DataFrame, time: str, kind: str, value: str, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per kind and window of time, late rows up to `lateness` included."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
