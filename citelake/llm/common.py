"""Small helpers that the corpus operators share: shared-folder staging, sizing, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a run on one machine (tests) gets a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="citelake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What the plan shuffled is no longer needed then, and its files are given free.  ``unstage`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citelake-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    free_shuffles(spark)
    staged = spark.read.schema(schema).parquet(path)
    staged.staged_paths = [path]
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete the tables behind staged frames, once nothing reads them any more."""
    for frame in frames:
        jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
        for path in getattr(frame, "staged_paths", []):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, for sizing partitions in proportion to the input."""
    return docs.select(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def parts_for(n_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // per_part))


#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 1024


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows (views, not copies), without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of an Arrow batch between the JVM and a worker.  Both sides hold a batch more than once, so Spark's usual 64 MB
#: would take some hundred MB of each executor.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ``BATCH_BYTES``; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = SLICE_ROWS
) -> DataFrame:
    """``mapInArrow`` with a function of one slice of a batch; slices without rows are skipped.

    All maps of the corpus operators go through here, so that all have small batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def empty_if_null(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The fields ``keep`` of ``df`` as they are, whatever their names, and the fields of ``more`` behind them."""
    return StructType([df.schema[c] for c in keep] + _parse_datatype_string(more).fields)
