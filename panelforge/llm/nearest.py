"""Exact nearest neighbours by a block matrix join of int8 product tiles.

Vectors are packed into blocks: one row of the block table holds the ids of up
to some thousand vectors, their float values, and their values as int8 with a
scale and the length of the rounding error. Candidate blocks are dealt into
parts that stay together; every query block goes to every part, so that what
moves is the query set (by contract a hundredth of the rows) once a part, and
the candidates once. A tile of a query and a candidate block multiplies the
int8 values (in float32, which is exact for such whole numbers) and so gives
each distance with an error bound. Candidates whose lower bound passes a
query's k-th smallest upper bound are out, the rest are computed again in
float64 from the original vectors; their k best merge into the query's heap.
A task holds the heaps of one query block at a time; the heaps of all parts
meet in a last ranking.

Edge cases: vectors that are null, empty, zero, or hold nulls or non-finite
components take no part, as query or candidate; so do rows with a null id.
Vectors of other lengths than a query's are no candidates of it. Repeated
vectors tie by id. Rows are rows of their own, whatever their ids: a query leaves
out one row of its own id and vector, and rows that repeat the id of a query are
candidates of it and queries with results of their own. Distances beyond the
range of squares (components above 1e154 or below 1e-162) are computed scaled.
Other columns are not read, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import table, written


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0))


BLOCK = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vals", pa.binary()), ("low", pa.binary()), ("scale", pa.binary()), ("off", pa.binary())])


#: Bytes of float and int8 values in a block.
BLOCK_BYTES = 2_400_000


def packed(vectors: DataFrame, rows: int, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (dim, ids, vals, low, scale, off) of up to `rows` vectors of equal length and `most_bytes` of values (or one vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            dims = lists.value_lengths().to_numpy()
            flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                step = max(1, min(rows, most_bytes // (9 * int(dim))))
                for k in range(0, len(at), step):
                    own = at[k : k + step]
                    values = flat[starts[own][:, None] + np.arange(dim)]
                    parts = ids[own].astype("<i8"), values.astype("<f8"), *quantised(values)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], schema=BLOCK)

    return vectors.mapInArrow(run, "dim int, ids binary, vals binary, low binary, scale binary, off binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and length of the rounding error of each vector."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale < 1e-300] = 1.0  # too small to divide by: all error
    low = np.rint(x / scale[:, None]).astype(np.int8)
    return low, scale, lengths(x - low * scale[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; where squares leave the range of doubles, of scaled rows."""
    with np.errstate(over="ignore"):
        out = np.sqrt((x**2).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
    if len(odd):
        most = np.abs(x[odd]).max(axis=1)
        with np.errstate(over="ignore"):
            out[odd] = np.where(most > 0, most * np.sqrt(((x[odd] / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1)), 0.0)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 tile product; slices of 1,024 dimensions stay below 2**24 and so exact in float32."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


class Block:
    """A block as arrays over its row's buffers."""

    def __init__(self, dim: int, ids, vals, low, scale, off):
        self.ids, self.values = np.frombuffer(ids, "<i8"), np.frombuffer(vals, "<f8").reshape(-1, dim)
        self.low, self.scale, self.off = np.frombuffer(low, np.int8).reshape(-1, dim), np.frombuffer(scale, "<f8"), np.frombuffer(off, "<f8")

    def norms(self) -> np.ndarray:
        return (self.low.astype(np.float64) ** 2).sum(axis=1) * self.scale**2


class Heaps:
    """The k smallest (score, id) of each query of a block so far."""

    def __init__(self, asked: Block, k: int):
        self.asked, self.k, self.norms = asked, k, asked.norms()
        self.best: list[list[tuple[float, int]]] = [[] for _ in asked.ids]
        self.most = np.full(len(asked.ids), np.inf)

    def tile(self, c: Block) -> None:
        q, k = self.asked, self.k
        with np.errstate(over="ignore", invalid="ignore"):
            norm = self.norms[:, None] + c.norms()[None, :]
            dist = np.sqrt(np.maximum(norm - 2 * products(q.low, c.low) * q.scale[:, None] * c.scale[None, :], 0))
            slack = q.off[:, None] + c.off[None, :] + 1e-7 * np.sqrt(norm)
            low, high = dist - slack, dist + slack
        unsure = ~np.isfinite(low)  # out of range: no bound
        low[unsure], high[unsure] = -np.inf, np.inf
        most = self.most
        if len(c.ids) >= k:
            most = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1])
        at, near = np.nonzero(low <= most[:, None])
        exact = np.empty(len(at))
        for j in range(0, len(at), 100_000):
            s = slice(j, j + 100_000)
            exact[s] = lengths(q.values[at[s]] - c.values[near[s]])
        order = np.lexsort((c.ids[near], exact, at))
        at, score, ids = at[order], exact[order], c.ids[near][order]
        first = np.searchsorted(at, np.arange(len(q.ids) + 1))
        for i in np.flatnonzero(np.diff(first)):
            s = slice(first[i], min(first[i] + k, first[i + 1]))
            own = self.best[i] = list(islice(merge(self.best[i], zip(score[s].tolist(), ids[s].tolist(), strict=True)), k))
            if len(own) == k:
                self.most[i] = own[-1][0]

    def rows(self, block: int) -> pa.RecordBatch:
        sizes = [len(x) for x in self.best]
        flat = [x for own in self.best for x in own]
        place = np.repeat(np.arange(len(sizes)), sizes)
        cols = [pa.array(np.full(len(place), block)), pa.array(place), pa.array(self.asked.ids[place]), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[0] for x in flat], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, ["asked", "place", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = 1024, block_rows: int = 4096, part_blocks: int = 64, spread: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by Euclidean distance, its own row left out.

    Tasks look for k + 1; the first of a query's own id at distance zero is its own row.

    A part holds up to `part_blocks` candidate blocks, fewer while there are
    fewer parts than `spread` (by default the number of shuffle partitions).
    """
    spark = vectors.sparkSession
    spread = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(packed(usable(vectors), block_rows).withColumn("block", F.xxhash64("ids", F.monotonically_increasing_id())), "nn-blocks")
    asked = usable(queries)
    groups = max(1, -(-asked.count() // query_rows))
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).repartition(groups, "group").drop("group")
    asked = written(packed(grouped, query_rows).withColumn("asked", F.monotonically_increasing_id()), "nn-queries")
    n = blocks.count()
    if not n or not asked.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, -(-n // max(1, min(part_blocks, n // spread))))
    held = blocks.withColumn("part", F.pmod("block", F.lit(parts))).select("part", "dim", *[F.col(c).alias(f"c_{c}") for c in BLOCK.names[1:]])
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # the streamed side is that of the queries: all candidates of a part pass by one query block, then by the next
    tiles = sent.join(held.hint("merge"), ["part", "dim"]).select("asked", "part", "dim", *BLOCK.names[1:], *[f"c_{c}" for c in BLOCK.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heaps = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, dim = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
                if key != now:
                    if heaps:
                        yield heaps.rows(now[0])
                    now, heaps = key, Heaps(Block(dim, *(b.column(c)[i].as_py() for c in range(3, 8))), k + 1)
                heaps.tile(Block(dim, *(b.column(c)[i].as_buffer() for c in range(8, 13))))
        if heaps:
            yield heaps.rows(now[0])

    found = tiles.mapInArrow(run, "asked long, place long, query_id long, vec_id long, score double")
    w = W.partitionBy("asked", "place").orderBy("score", "vec_id")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    found = found.withColumn("_own", F.min(F.when(own, F.col("rank"))).over(W.partitionBy("asked", "place"))).where(F.col("_own").isNull() | (F.col("rank") != F.col("_own")))
    return found.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("_own"), 1).otherwise(0)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row of embeddings whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             sqrt(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: (q.e[i]::DOUBLE - c.e[i]::DOUBLE) * (q.e[i]::DOUBLE - c.e[i]::DOUBLE)))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
