"""Structured Streaming twins: bars from ticks, an upserting price feed, running cash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators.quality import violations
from panelforge.sources.prices import upserted

KEYS = ["code", "trade_date", "adjust"]


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Tumbling bars of ticks (event_type, ts, event_id, value); with a watermark on a stream, rows later than it are dropped."""
    if late:
        ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    key = F.struct("ts", "event_id")
    bars = ticks.groupBy(F.col("event_type").alias("code"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("n"))
    return bars.select("code", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_batch(batch: DataFrame, number: int, table: str, run: str, max_return: float = 0.5) -> None:
    """Upsert a batch of price rows into a table partitioned by adjust and month; a batch that comes again changes nothing.

    Only months with rows in the batch are read and written. They are staged
    whole before the table is touched: a batch that failed in between is finished
    from the stage. Rows of codes with a violation go to <table>_rejected, in a
    folder of the run and batch that is written anew when the batch comes again.
    """
    spark = batch.sparkSession
    columns = batch.columns
    staged = f"{table}_staged/run={run}/batch={number}"
    fs, done = _path(spark, f"{staged}/_SUCCESS")
    if not fs.exists(done):
        batch = batch.dropDuplicates(KEYS).persist()
        bad = violations(batch, max_return=max_return).select("code").distinct()
        batch.join(bad.hint("merge"), "code", "left_semi").write.mode("overwrite").parquet(f"{table}_rejected/run={run}/batch={number}")
        month = (F.year("trade_date") * 100 + F.month("trade_date")).alias("month")
        good = batch.join(bad.hint("merge"), "code", "left_anti").select(*columns, month)
        touched = good.select("adjust", "month").distinct().collect()  # months of a batch's files
        old = good.limit(0)
        if fs.exists(_path(spark, table)[1]):
            here = F.struct("adjust", "month").isin(*[F.struct(F.lit(r["adjust"]), F.lit(r["month"])) for r in touched]) if touched else F.lit(False)
            one = F.col("month").isin(*{r["month"] for r in touched}) & F.col("adjust").isin(*{r["adjust"] for r in touched}) if touched else F.lit(False)  # reaches the partitions
            old = spark.read.schema(good.schema).parquet(table).where(one & here).select(*good.columns)
        upserted(old, good, KEYS).write.mode("overwrite").parquet(staged)
        batch.unpersist()
    rows = spark.read.parquet(staged)
    if rows.limit(1).count():
        rows.drop("run", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("adjust", "month").parquet(table)
    fs.delete(_path(spark, staged)[1], True)


def price_feed(spark: SparkSession, source: str, schema, table: str, checkpoint: str, max_return: float = 0.5) -> StreamingQuery:
    """Files of price rows upserted by put_batch(); batches go in only without violations of their codes. Read the table with its schema's columns: month is a partition."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: put_batch(batch, number, table, run, max_return)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
