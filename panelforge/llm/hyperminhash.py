"""Near-duplicates by HyperMinHash sketches, confirmed on full shingle sets.

A document is the set of its distinct `width`-word shingles. A hash deals the
shingles to `bands * rows` buckets; of each bucket the smallest value of a second
hash stays as a register of 16 bits: its leading zeros (6 bits) and the 10 bits
behind its first one, which is a float of that value. An empty bucket borrows
the register of the first filled one in an order of its own, so that a register
agrees between two sets as often as their Jaccard similarity says, for small
sets too.

`rows` registers make a band's key; sets that share one of `bands` keys are
candidates. At 0.85 a pair shares none with a chance of 7 in 10^9. A candidate's
similarity is estimated from the registers that agree, less those that agree by
chance: two different minima fall into one float cell with a chance of about
phi / (8 ln 2 2^10), phi = 4 n m / (n + m)^2. Pairs whose estimate lies more than
`SLACK` standard deviations below the threshold go; all others are confirmed by
the exact similarity of their full sets.

Not all pairs of a key meet: first each set meets the key's most central one
(see near_texts.py), then the sets of a key that still stand in different groups
meet by prefixes of rare shingles, which loses no pair.

Edge cases: null texts and texts without words have no set, link with nothing
and are components of their own; equal sets are one node; a text of fewer words
than `width` is one shingle; repeated rows share a component, and a row that
repeats the smallest doc_id is kept with it; a null doc_id is the component_id
only where no other is reachable; other columns are not read; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.alignment import portions
from panelforge.llm.common import checked_join, forget, table, written
from panelforge.llm.components import components
from panelforge.llm.near_texts import confirmed, prefix_pairs
from panelforge.llm.simhash import shingle_hashes

MANTISSA = 10
SLACK = 7.0
_EMPTY = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit hashes: multiply, shift, multiply."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


def compressed(low: np.ndarray) -> np.ndarray:
    """16-bit registers of 64-bit minima: leading zeros, then the bits behind the first one."""
    zeros = np.zeros(low.shape, np.uint64)
    x = low.copy()
    for k in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - k))
        zeros += np.where(small, np.uint64(k), np.uint64(0))
        x = np.where(small, x << np.uint64(k), x)
    behind = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | behind).astype(np.uint16)


def lenders(buckets: int) -> np.ndarray:
    """For each bucket the order in which it asks the others, itself first."""
    rng = np.random.default_rng(11)
    own = np.arange(buckets)[:, None]
    return np.concatenate([own, np.stack([rng.permutation(np.delete(np.arange(buckets), k)) for k in range(buckets)])], axis=1)


def sketches(sets: list[np.ndarray], buckets: int, order: np.ndarray) -> np.ndarray:
    """Registers (set, bucket) of sets of 64-bit hashes; those of an empty set are all ones."""
    low = np.full((len(sets), buckets), _EMPTY)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate([*sets, np.empty(0, np.uint64)])
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low, (owner, bucket), _mixed(h))
    filled = low != _EMPTY
    at, want = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = low.copy()
    for k in range(1, buckets):
        if not len(at):
            break
        lender = order[want, k]
        has = filled[at, lender]
        out[at[has], want[has]] = low[at[has], lender[has]]
        at, want = at[~has], want[~has]
    return compressed(out)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key (set, band) of each band's registers and its number."""
    parts = registers.reshape(len(registers), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def similarity(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of registers (pair, bucket) of sets of n and m shingles, less the agreement by chance."""
    agree = (x == y).mean(axis=1)
    phi = 4.0 * n * m / (n + m).astype(float) ** 2
    chance = phi / (8 * np.log(2) * 2**MANTISSA)
    return (agree - chance) / (1 - chance)


def _set_of(text: str | None, width: int) -> tuple[np.ndarray, int | None]:
    """Sorted distinct shingle hashes and a signed hash of them (none for an empty set)."""
    own = np.unique(shingle_hashes(text or "", width))
    return own, int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]) if len(own) else None


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, hash, n, registers) of each row; hash names the shingle set, null for an empty one."""
    order = lenders(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 2):
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = [_set_of(t, width) for t in part.column(2).to_pylist()]
                sets = [s for s, _ in found]
                registers = sketches(sets, bands * rows, order).astype("<u2")
                cols = [pa.array([h for _, h in found], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in registers], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "text_hash", "hash", "n", "registers"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, hash long, n long, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def keyed_by_band(sets: DataFrame, bands: int) -> DataFrame:
    """(hash, n, key): each set once a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(_registers(b.column(2)), bands).view(np.int64)
                own = pa.array(np.repeat(np.arange(b.num_rows), bands))
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(keys.ravel())], ["hash", "n", "key"])

    return sets.select("hash", "n", "registers").mapInArrow(run, "hash long, n long, key long")


def estimated(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that their registers do not rule out."""
    side = lambda p, q: sets.select(F.col("hash").alias(p), F.col("n").alias(f"n{q}"), F.col("registers").alias(q))
    met = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").select("a", "b", "nx", "ny", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                n, m = (t.column(k).to_numpy() for k in (2, 3))
                x, y = _registers(t.column(4)), _registers(t.column(5))
                own = np.minimum(np.minimum(n, m), x.shape[1])  # what a set has no shingles for is borrowed, not drawn
                low = least - SLACK * np.sqrt(least * (1 - least) / own)
                yield t.select(["a", "b"]).filter(pa.array(similarity(x, y, n, m) >= low))

    return met.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(hash, shingles) of each distinct set among the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 0):
            found = [(h, s) for s, h in (_set_of(t, width) for t in b.column(0).to_pylist()) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["hash", "shingles"])

    return docs.select("text").mapInArrow(run, "hash long, shingles array<long>").groupBy("hash").agg(F.first("shingles").alias("shingles"))


def near_sets(docs: DataFrame, width: int = 3, least: float = 0.85, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, hash, component_id) of each row of docs; hash names its shingle set, null if empty."""
    spark = docs.sparkSession
    every = written(sketched(docs, width, bands, rows), "hmh-sketches")
    sets = every.where("hash IS NOT NULL").groupBy("hash").agg(*[F.first(c).alias(c) for c in ("n", "registers", "text_hash")], F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    sets = written(sets, "hmh-sets")
    keyed = written(keyed_by_band(sets, bands), "hmh-keyed")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "hmh-shared")
    members = written(checked_join(keyed, shared, ["key"], "inner", shared.count()), "hmh-members")
    forget(spark, keyed)
    central = written(members.groupBy("hash").agg(F.sum("m").alias("central")), "hmh-central")
    n_central = central.count()
    pivots = checked_join(members, central, ["hash"], "inner", n_central).groupBy("key").agg(F.max(F.struct("central", "hash", "n")).alias("pivot"))
    pivots = written(pivots.select("key", F.col("pivot.hash").alias("p"), F.col("pivot.n").alias("pn")), "hmh-pivots")
    stars = checked_join(members, pivots, ["key"], "inner", pivots.count()).where(F.col("hash") != F.col("p")).where(F.least("n", "pn") >= F.lit(least) * F.greatest("n", "pn") - 1e-9)
    stars = written(stars.select(F.greatest("hash", "p").alias("a"), F.least("hash", "p").alias("b")).distinct(), "hmh-stars")
    texts = checked_join(sets.select("hash", "text_hash"), central, ["hash"], "left_semi", n_central).select("text_hash").distinct()
    held = checked_join(docs.select("text").withColumn("text_hash", F.xxhash64("text")), written(texts, "hmh-texts"), ["text_hash"], "left_semi", n_central)
    full = written(full_sets(held, width), "hmh-full")
    found = written(confirmed(estimated(stars, sets, least), full, least), "hmh-found")
    labels = components(found)
    own = members.select("key", "hash").join(labels.hint("merge"), F.col("hash") == F.col("node"), "left").select("key", "hash", F.coalesce("label", "hash").alias("label"))
    own = written(own, "hmh-own")
    mixed = written(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "hmh-mixed")
    open_ = written(checked_join(own, mixed, ["key"], "left_semi", mixed.count()).select("hash", "label").distinct(), "hmh-open")
    rest = written(prefix_pairs(open_, full, least).join(stars.hint("merge"), ["a", "b"], "left_anti"), "hmh-rest")
    more = written(confirmed(estimated(rest, sets, least), full, least), "hmh-more")
    if more.limit(1).count():
        labels = components(found.unionByName(more))
    for t in (members, own, open_, rest, full, stars):
        forget(spark, t)
    linked = written(sets.select("hash", "first").join(labels.hint("merge"), F.col("hash") == F.col("node")).select("hash", "first", "label"), "hmh-linked")
    tops = written(linked.groupBy("label").agg(F.min("first").alias("top")), "hmh-tops")
    linked = checked_join(linked, tops, ["label"], "inner", tops.count()).select("hash", F.col("top").alias("component_id"))
    alone = sets.where("copies > 1").join(linked.hint("merge"), "hash", "left_anti").select("hash", F.col("first").alias("component_id"))
    known = written(linked.unionByName(alone), "hmh-known")
    out = checked_join(every.select("doc_id", F.col("n").alias("n_shingles"), "hash"), known, ["hash"], "left", known.count())
    return out.select("doc_id", "n_shingles", "hash", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document; the one with the component's id is kept."""
    out = near_sets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
