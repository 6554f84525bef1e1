"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The largest table that an operator broadcasts, after having counted its rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A local session that names none, as in tests, gets one here; on a cluster
    it has to be set, as no local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/checkpoints/panelforge"
    return f"{found.rstrip('/')}/panelforge-{spark.sparkContext.applicationId}"


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """What an application has written to the shared folder goes when its driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_exit(spark, shared_dir(spark))
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    jvm = spark._jvm
    root = shared_dir(spark).rpartition("/")[2]
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array.

    Other gaps become spaces first: splitting at one plain character needs no regular expression.
    """
    t = F.coalesce(text, F.lit(""))
    for gap in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows; free memory goes back to the system at the end."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    give_back()


def give_back() -> None:
    """Free memory of a worker, which lives on for later tasks, goes back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with a written side of `rows` rows: broadcast while that is small, else a sort-merge join (AQE splits skew)."""
    side = F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")
    return big.join(side, on, how)


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column _row, so that no column added beside it can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
