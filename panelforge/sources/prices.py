"""Reading, normalising and storing price tables (code, trade_date, adjust, OHLCV, ingested_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("trade_date", T.DateType()), T.StructField("adjust", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")],
])

#: Column names by field, in the order in which they are tried (fixed values: names that vendors use).
KEYWORDS = {"trade_date": ["date", "日期", "time"], "open": ["open", "开盘"], "high": ["high", "最高"], "low": ["low", "最低"], "close": ["close", "收盘"], "volume": ["volume", "成交量", "vol"], "amount": ["amount", "成交额", "turnover"], "settle": ["settle", "结算"], "hold": ["hold", "持仓", "open_interest"]}


def load(prices: DataFrame, fields: list[str], codes: list[str] | None = None, start: str | None = None, end: str | None = None, adjust: str | None = None) -> DataFrame:
    """(code, trade_date, fields): filters reach the scan; of rows with one key the last ingested wins."""
    df = prices
    if adjust is not None:
        df = df.where(F.col("adjust") == adjust)
    if codes is not None:
        df = df.where(F.col("code").isin(codes))
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.lit(end).cast("date"))
    if "ingested_at" not in df.columns:
        return df.select("code", "trade_date", *fields)
    return df.groupBy("code", "trade_date").agg(*[F.max_by(f, "ingested_at").alias(f) for f in fields])


def resolved(df: DataFrame, keywords: dict[str, list[str]] = KEYWORDS, text: set[str] = frozenset()) -> DataFrame:
    """A vendor's frame under our names: columns found by keyword, values cast where they can be (but for those of `text`), rows without a date dropped."""
    out: list[Column] = []
    for field, words in keywords.items():
        found = next((c for w in words for c in df.columns if w in c.lower()), None)
        if found is None:
            continue
        x = F.col(f"`{found}`").cast("string")
        if field in text:
            out.append(F.col(f"`{found}`").alias(field))
        elif field == "trade_date":
            out.append(F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(x, F.lit("yyyyMMdd"))).cast("date").alias(field))
        else:
            out.append(x.try_cast("double").alias(field))
    return df.select(*out).where(F.col("trade_date").isNotNull())


def from_arrays(df: DataFrame, body: str, arrays: dict[str, str], keys: list[str], keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Rows of array-shaped JSON (one array a column, name -> element type) beside keys, under our names.

    Arrays of unlike length leave nulls; a body that is no JSON gives no row.
    """
    schema = T.StructType([T.StructField(n, T.ArrayType(T.StringType() if t == "string" else T.DoubleType())) for n, t in arrays.items()])
    zipped = F.arrays_zip(*[F.col(f"_j.`{n}`") for n in arrays])
    fields = [f"_{k}" for k in range(len(arrays))]
    rows = df.withColumn("_j", F.from_json(body, schema)).select(*keys, F.explode(F.transform(zipped, lambda x: F.struct(*[x[n].alias(f) for n, f in zip(arrays, fields, strict=True)]))).alias("_r"))
    flat = rows.select(*keys, *[F.col(f"_r.{f}").alias(n) for n, f in zip(arrays, fields, strict=True)])
    return resolved(flat, {k: [k] for k in keys} | keywords, text=set(keys))


def first_source(df: DataFrame, rank: str = "source_rank") -> DataFrame:
    """Rows of each code's first source that has any."""
    best = df.groupBy("code").agg(F.min(rank).alias("_best"))
    return df.join(best.hint("merge"), "code").where(F.col(rank) == F.col("_best")).drop("_best")


def best_source(df: DataFrame, latency_ms: float = 0.0) -> DataFrame:
    """(code, source, score): days plus 120 times continuity minus latency / 200; the best by score, ties by name."""
    span = F.datediff(F.max("trade_date"), F.min("trade_date")) + 1
    days = F.count_distinct("trade_date")
    scored = df.groupBy("code", "source").agg((days + 120 * days / span - latency_ms / 200).alias("score"))
    w = Window.partitionBy("code").orderBy(F.desc("score"), "source")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: new rows replace old ones of equal key."""
    return old.join(new.select(keys).distinct().hint("merge"), keys, "left_anti").unionByName(new)


def classified(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New rows with their action (insert, update, same) and the value they replace."""
    before = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_had"))
    joined = new.join(before.hint("merge"), keys, "left")
    action = F.when(F.col("_had").isNull(), "insert").when(F.col("old_value").eqNullSafe(F.col(value)), "same").otherwise("update")
    return joined.withColumn("action", action).drop("_had")


def rolled_back(table: DataFrame, audit: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table before a batch: inserted keys go, updated values return."""
    a = audit.select(*keys, "action", "old_value")
    joined = table.join(a.hint("merge"), keys, "left").where("action IS NULL OR action <> 'insert'")
    return joined.withColumn(value, F.when(F.col("action") == "update", F.col("old_value")).otherwise(F.col(value))).drop("action", "old_value")


def fingerprint(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """SHA-256 of each key's rows: a hash of each row, and of the sum of row hashes, so that no group is gathered."""
    text = F.concat_ws("|", F.col(order).cast("string"), *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    digest = F.md5(text)
    parts = [F.conv(F.substring(digest, a, 8), 16, 10).cast("decimal(20,0)") for a in (1, 9, 17, 25)]
    sums = df.select(*keys, *[p.alias(f"_p{k}") for k, p in enumerate(parts)]).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"_p{k}").cast("string").alias(f"_s{k}") for k in range(4)])
    return sums.select(*keys, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"_s{k}") for k in range(4)]), 256).alias("fingerprint"))


def coverage(df: DataFrame, pool: DataFrame) -> DataFrame:
    """Pool rows with the first and last stored date and the number of days."""
    c = df.groupBy("code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count_distinct("trade_date").alias("days"))
    return pool.join(c.hint("merge"), "code", "left")


def fetch_plan(pool: DataFrame, stored: DataFrame, start: str, end: str, full: bool = False) -> DataFrame:
    """(code, start, end) to fetch: from the day after the last stored one; codes that are up to date are left out."""
    last = stored.groupBy("code").agg(F.max("trade_date").alias("_last"))
    begin = F.lit(start).cast("date") if full else F.greatest(F.lit(start).cast("date"), F.date_add("_last", 1))
    out = pool.select("code").join(last.hint("merge"), "code", "left").select("code", F.coalesce(begin, F.lit(start).cast("date")).alias("start"), F.lit(end).cast("date").alias("end"))
    return out.where("start <= end")


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
