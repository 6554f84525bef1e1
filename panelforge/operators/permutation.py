"""Sums over many random subsets or sign flips of the same rows, without a row a draw.

A task goes through its rows once and keeps a vector of sums, one number a
trial; only those vectors are shuffled. Draws are the MD5 digests of draws.py,
so SQL draws the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS
from panelforge.operators.draws import BITS, many_draws

#: Standard deviations around k / size within which draws are sorted; a trial whose cut lies outside is drawn again in full.
SIGMAS = 5.0
#: Rows of a group up to which one task holds it; larger groups are dealt over the tasks.
GROUP_ROWS = 4096
_TOP = float((1 << 32) - 1)


def _seeded(seed: int, *names: str) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in names])


def _words(prefix: str, trials: int) -> np.ndarray:
    """The draws of many_draws() as numbers."""
    digests = b"".join(hashlib.md5(f"{prefix}:{b}".encode()).digest() for b in range(-(-trials // 4)))
    return np.frombuffer(digests, ">u4")[:trials].astype(np.int64)


def _bits(prefix: str, trials: int) -> np.ndarray:
    """The draws of many_bits()."""
    heads = b"".join(hashlib.md5(f"{prefix}:{b}".encode()).digest()[:8] for b in range(-(-trials // BITS)))
    x = np.frombuffer(heads, ">u8").astype(np.uint64) >> np.uint64(64 - BITS)
    return ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int8).ravel()[:trials]


def subset_sums(pool: DataFrame, wanted: DataFrame, value: str, ident: str, trials: int, seed: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, trial, total): in each trial the sum of value over the k rows of a group with the smallest draws.

    pool has (keys, ident, value), ident unique in a group and the order of equal
    draws; wanted has (keys, k), 0 < k <= rows of the group. Draws well below
    k / size are in, those well above it are out: both go into the task's vectors
    as they come. Only those between (some square root of the group) become rows
    and are sorted. Where the cut is not among them the trial is drawn again, so
    every subset has exactly k rows. A group of at most GROUP_ROWS rows is held by
    one task instead, and leaves it as its sums.
    """
    size = pool.groupBy(*keys).agg(F.count("*").alias("_size"))
    share = F.col("k") / F.col("_size")
    slack = SIGMAS * F.sqrt(share * (1 - share) / F.col("_size")) + 2 / F.col("_size")
    asked = wanted.select(*keys, "k").join(size.hint("merge"), list(keys))
    asked = asked.select(*keys, "k", "_size", F.floor(F.greatest(F.lit(0.0), share - slack) * _TOP).cast("long").alias("_low"), F.floor(F.least(F.lit(1.0), share + slack) * _TOP).cast("long").alias("_high"))
    rows = pool.select(*keys, ident, F.col(value).cast("double").alias("_v")).join(asked.hint("merge"), list(keys))
    rows = rows.withColumn("_seed", _seeded(seed, *keys, ident))
    small, rows = rows.where(F.col("_size") <= GROUP_ROWS), rows.where(F.col("_size") > GROUP_ROWS)
    return _held_sums(small, ident, trials, keys).unionByName(_dealt_sums(rows, asked.where(F.col("_size") > GROUP_ROWS), ident, trials, seed, keys))


def _held_sums(rows: DataFrame, ident: str, trials: int, keys: tuple[str, ...]) -> DataFrame:
    """subset_sums() of small groups, each in one task."""
    m = len(keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def sums(v: list[float], prefixes: list[str], k: int) -> np.ndarray:
        u = np.stack([_words(p, trials) for p in prefixes]) * len(v) + np.arange(len(v))[:, None]  # equal draws by place
        value, out = np.array(v), np.empty(trials)
        for t in range(0, trials, 250):
            part = u[:, t : t + 250]
            out[t : t + 250] = value @ (part <= np.partition(part, k - 1, axis=0)[k - 1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def every() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for g, own in groupby(every(), key=lambda r: r[:m]):
            _, v, k, prefixes = zip(*(r[m:] for r in own), strict=True)
            held = [pa.array([x], schema.field(i).type).take(pa.array(np.zeros(trials, np.int64))) for i, x in enumerate(g)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.arange(trials)), pa.array(sums(v, prefixes, k[0]))], [*keys, "trial", "total"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.select(*keys).schema)
    return rows.select(*keys, ident, "_v", "k", "_seed").repartition(*keys).sortWithinPartitions(*keys, ident).mapInArrow(run, f"{types}, trial long, total double")


def _dealt_sums(rows: DataFrame, asked: DataFrame, ident: str, trials: int, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """subset_sums() of large groups, dealt over the tasks."""
    rows = rows.repartition(*keys, ident)
    m = len(keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, ident).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            group = list(zip(*(b.column(k).to_pylist() for k in range(m)), strict=True))
            v, low, high, prefix = (b.column(m + k).to_pylist() for k in (1, 3, 4, 5))
            at, trial, draw = [], [], []
            for i, g in enumerate(group):
                u = _words(prefix[i], trials)
                n, total = sums.setdefault(g, (np.zeros(trials, np.int64), np.zeros(trials)))
                sure = u <= low[i]
                n += sure
                total += np.where(sure, v[i], 0.0)
                near = np.flatnonzero(~sure & (u <= high[i]))
                at.append(np.full(len(near), i))
                trial.append(near)
                draw.append(u[near])
            own = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in range(m + 1)), pa.array(np.concatenate(trial)), pa.array(np.concatenate(draw)), b.column(m + 1).take(own), pa.array(np.ones(len(own), np.int64))], names)
        for g, (n, total) in sums.items():
            held = [pa.array([x], schema.field(k).type).take(pa.array(np.zeros(trials, np.int64))) for k, x in enumerate(g)]
            yield pa.RecordBatch.from_arrays([*held, pa.nulls(trials, schema.field(m).type), pa.array(np.arange(trials)), pa.nulls(trials, pa.int64()), pa.array(total), pa.array(n)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    names = [*keys, ident, "trial", "_draw", "_v", "_n"]
    schema = to_arrow_schema(rows.select(*keys, ident).schema)
    parts = rows.select(*keys, ident, "_v", "k", "_low", "_high", "_seed").mapInArrow(run, f"{types}, trial long, _draw long, _v double, _n long")
    far = F.col("_draw").isNull()
    between = F.filter(F.array_sort(F.collect_list(F.when(~far, F.struct("_draw", F.col(ident).alias("_id"), "_v")))), lambda x: x.isNotNull())
    g = parts.groupBy(*keys, "trial").agg(F.sum(F.when(far, F.col("_n")).otherwise(0)).alias("_in"), F.sum(F.when(far, F.col("_v")).otherwise(0.0)).alias("_sum"), between.alias("_between"))
    g = g.join(asked.select(*keys, "k").hint("merge"), list(keys)).withColumn("_more", F.col("k") - F.col("_in"))
    fits = (F.col("_more") >= 0) & (F.col("_more") <= F.size("_between"))
    added = F.aggregate(F.slice("_between", 1, F.greatest(F.lit(0), F.col("_more")).cast("int")), F.lit(0.0), lambda acc, x: acc + x["_v"])
    g = g.select(*keys, "trial", F.when(fits, F.col("_sum") + added).alias("total"))
    short = g.where("total IS NULL").select(*keys, "trial")
    w = Window.partitionBy(*keys, "trial").orderBy("_u", ident)
    again = rows.join(short.groupBy(*keys).agg(F.collect_list("trial").alias("_t")).hint("merge"), list(keys)).select(*keys, ident, "_v", "k", F.explode("_t").alias("trial"), many_draws(seed, *keys, ident, n=trials).alias("_all"))
    again = again.withColumn("_u", F.get("_all", F.col("trial").cast("int"))).withColumn("_k", F.row_number().over(w)).where("_k <= k").groupBy(*keys, "trial").agg(F.sum("_v").alias("total"))
    return g.where("total IS NOT NULL").unionByName(again)


def flip_sums(rows: DataFrame, value: str, unit: str, trials: int, seed: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, trial, total): sums of value with random signs; rows of one unit share their signs."""
    m = len(keys)
    own = rows.select(*keys, F.col(value).cast("double").alias("_v"), _seeded(seed, unit).alias("_seed"), unit).repartition(*keys, unit).select(*keys, "_v", "_seed")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *g, v, prefix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = sums.setdefault(tuple(g), np.zeros(trials))
                total += np.where(_bits(prefix, trials) == 1, -v, v)
        for g, total in sums.items():
            held = [pa.array([x], schema.field(k).type).take(pa.array(np.zeros(trials, np.int64))) for k, x in enumerate(g)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.arange(trials)), pa.array(total)], [*keys, "trial", "_v"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(own.select(*keys).schema)
    return own.mapInArrow(run, f"{types}, trial long, _v double").groupBy(*keys, "trial").agg(F.sum("_v").alias("total"))


def stratified_p(df: DataFrame, value: str, inside: str, stratum: str, ident: str, trials: int, seed: int = 7, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n_in, n_out, diff, p): difference of means of value inside and outside a condition, and the share of label shuffles within strata with one as large.

    Every shuffle keeps the number of labels of each stratum; strata with none or
    all of their rows inside stay as they are. p = (exceeding + 1) / (trials + 1);
    null where one side is empty.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(inside).isNotNull()).select(*keys, F.coalesce(F.col(stratum).cast("string"), F.lit("NA")).alias("_stratum"), ident, F.col(value).cast("double").alias("_x"), F.col(inside).cast("long").alias("_label"))
    strata = rows.groupBy(*keys, "_stratum").agg(F.sum("_label").alias("k"), F.count("*").alias("_n"), F.sum("_x").alias("_all"), F.sum(F.col("_x") * F.col("_label")).alias("_own"))
    mixed = strata.where("k > 0 AND k < _n").select(*keys, "_stratum", "k")
    real = strata.groupBy(*keys).agg(F.sum("k").alias("n_in"), F.sum(F.col("_n") - F.col("k")).alias("n_out"), F.sum("_all").alias("_all"), F.sum("_own").alias("_own"), F.sum(F.when(F.col("k") == F.col("_n"), F.col("_all")).otherwise(0.0)).alias("_fixed"))
    mean = lambda s: F.try_divide(s, F.col("n_in")) - F.try_divide(F.col("_all") - s, F.col("n_out"))
    drawn = subset_sums(rows.join(mixed.select(*keys, "_stratum").hint("merge"), [*keys, "_stratum"], "left_semi"), mixed, "_x", ident, trials, seed, (*keys, "_stratum"))
    drawn = drawn.groupBy(*keys, "trial").agg(F.sum("total").alias("_drawn"))
    met = drawn.join(real.hint("merge"), list(keys)).withColumn("_exceeds", F.abs(mean(F.col("_fixed") + F.col("_drawn"))) >= F.abs(mean(F.col("_own"))) - 1e-12)
    counted = met.groupBy(*keys).agg(F.sum(F.col("_exceeds").cast("int")).alias("_e"))
    out = real.join(counted.hint("merge"), list(keys), "left")
    p = F.when((F.col("n_in") > 0) & (F.col("n_out") > 0), (F.coalesce("_e", F.lit(trials)) + 1) / (trials + 1))  # nothing to shuffle: every shuffle is the real one
    return out.select(*keys, "n_in", "n_out", mean(F.col("_own")).alias("diff"), p.alias("p"))
