"""Streams give what the batch operators give."""

import datetime as dt

from panelforge.sources.prices import PRICE_SCHEMA
from panelforge.streaming import feeds


def test_price_feed_upserts_and_rejects(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    d = dt.date(2024, 1, 2)
    row = lambda code, k, px: (code, d + dt.timedelta(days=k), "none", px, px, px, px, 1.0, px)
    write = lambda rows: spark.createDataFrame(rows, PRICE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    write([row("A", 0, 10.0), row("A", 1, 11.0), row("B", 0, 5.0), row("B", 1, 50.0)])
    for _ in range(2):
        feeds.price_feed(spark, source, PRICE_SCHEMA, table, str(tmp_path / "cp")).awaitTermination()
        write([row("A", 1, 12.0), row("A", 2, 12.5)])
    got = {(r["code"], r["trade_date"].day): r["close"] for r in spark.read.schema(PRICE_SCHEMA).parquet(table).collect()}
    assert got == {("A", 2): 10.0, ("A", 3): 12.0, ("A", 4): 12.5}
    assert {r["code"] for r in spark.read.parquet(f"{table}_rejected").collect()} == {"B"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    row = lambda code, m, d, px: (code, dt.date(2024, m, d), "none", px, px, px, px, 1.0, px)
    first = spark.createDataFrame([row("A", 1, 30, 10.0), row("A", 2, 1, 10.5), row("C", 3, 1, 7.0), row("B", 1, 2, 5.0), row("B", 1, 3, 50.0)], PRICE_SCHEMA)
    second = spark.createDataFrame([row("A", 2, 1, 10.4), row("A", 2, 2, 10.6)], PRICE_SCHEMA)
    held = lambda: sorted((r["code"], r["trade_date"], r["close"], r["month"]) for r in spark.read.parquet(table).collect())
    feeds.put_batch(first, 0, table, "r")
    parts = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("month=20240[13]/*.parquet")}
    feeds.put_batch(second, 1, table, "r")
    want = held()
    assert [x[:3] for x in want] == [("A", dt.date(2024, 1, 30), 10.0), ("A", dt.date(2024, 2, 1), 10.4), ("A", dt.date(2024, 2, 2), 10.6), ("C", dt.date(2024, 3, 1), 7.0)]
    assert parts and all(p.exists() and p.stat().st_mtime_ns == t for p, t in parts.items())  # other months stay untouched
    feeds.put_batch(second, 1, table, "r")
    feeds.put_batch(first.where("code = 'B'"), 2, table, "r")
    assert held() == want
    assert spark.read.parquet(f"{table}_rejected").where("batch = 0").count() == 2


def test_a_failed_batch_is_finished_from_its_stage(spark, tmp_path):
    table = str(tmp_path / "table")
    px = (10.0,) * 4
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 2), "none", *px, 1.0, 1.0)], PRICE_SCHEMA)
    rows.selectExpr("*", "202401 AS month").write.parquet(f"{table}_staged/run=r/batch=5")  # staged whole, then the driver was lost
    feeds.put_batch(rows.limit(0), 5, table, "r")
    assert spark.read.parquet(table).count() == 1 and not (tmp_path / "table_staged/run=r/batch=5").exists()


def test_tick_bars_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(ticks.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = feeds.tick_bars(stream, late="30 days").writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["code"], r["open"], r["high"], r["low"], r["close"], r["n"]) for r in df.collect())
    assert key(spark.table("bars")) == key(feeds.tick_bars(ticks))
