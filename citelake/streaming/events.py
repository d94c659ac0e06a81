"""Streams: the progress log of runs, running tallies, and overrides kept as state.

The log is append-only; a client sees each event once and in order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

# Stages of a run, in their order.
STAGES = ("parse", "citations", "references", "plan", "check", "done", "error", "closed")


def read_events(spark: SparkSession, path: str, schema: StructType | str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (run_id, seq) once, however often it is sent within the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


def progress(events: DataFrame) -> DataFrame:
    """run_id, n, last stage and percent so far: a running tally for update mode."""
    last = F.max_by(F.struct("stage", "percent"), "seq")
    return events.groupBy("run_id").agg(F.count("*").alias("n"), last.alias("last"), F.bool_or(F.col("stage").isin("done", "error")).alias("ended"))


def windowed(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events and mean value of each type in tumbling windows, late ones within the watermark included."""
    marked = events.withWatermark("at", delay).groupBy(F.window("at", width), "stage")
    return marked.agg(F.count("*").alias("n"), F.sum("percent").alias("total")).select(F.col("window.start").alias("start"), "stage", "n", "total")


def collect_into(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into Parquet below ``folder`` (shared), and returns the table.

    A batch that is run again writes its own folder again.  In complete mode the last batch is the whole table.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    kept = spark.read.schema(stream.schema.add("batch", "long")).parquet(folder)
    newest = kept.where(F.col("batch") == kept.agg(F.max("batch")).first()[0]) if mode == "complete" else kept
    return newest.drop("batch")


class Overrides(StatefulProcessor):
    """The standing override of each (run_id, key): the action with the highest number wins, a clear removes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType().add("action_no", LongType()).add("verdict", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, verdict = self.last.get() if self.last.exists() else (-1, "")
        for frame in rows:
            newest = frame.loc[frame["action_no"].idxmax()]
            if int(newest["action_no"]) > number:
                number, verdict = int(newest["action_no"]), newest["verdict"] if newest["kind"] == "set" else ""
        self.last.update((number, verdict))
        yield pd.DataFrame({"run_id": [key[0]], "key": [key[1]], "action_no": [number], "override": [verdict]})

    def close(self) -> None:
        pass


def overrides(actions: DataFrame) -> DataFrame:
    """run_id, key, action_no, override after each batch of set and clear actions (update mode, state kept in RocksDB)."""
    return (
        actions.where("kind in ('set', 'clear')")
        .groupBy("run_id", "key")
        .transformWithStateInPandas(Overrides(), "run_id string, key string, action_no long, override string", "Update", "none")
    )
