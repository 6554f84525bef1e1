"""Groups of near-duplicate texts by the Jaccard similarity of their word shingles.

A text is the set of its `width`-word shingles (a text of fewer words is one
shingle). `bands` keys of `rows` minima each propose pairs: two texts of
similarity s share a key with probability 1 - (1 - s^rows)^bands, at the
defaults and s = 0.8 all but 3 in a million. Every proposed pair is then
confirmed by its exact similarity, so that no pair below `least` links.

First the fingerprints of the texts' shingles go through the Gray-order index of
simhash.py: whatever it links at three bits is proposed. Close copies often lie
further apart than that, so keys propose too. Each text of a key meets the key's pivot, the text whose keys are the
most common ones: in a group of edited copies that is one close to what was
copied, to which most link. Texts of a key that are still in different groups
meet by prefixes: with a text's shingles in order of rarity among those texts,
two texts of similarity `least` share one of their first n - ceil(least n) + 1,
and from the first that they share on have room for all that they must share.
This loses no pair, and a text with more shingles of its own than that meets
none; so heavily edited copies of one text are not compared with each other.
Equal texts meet before, as one hash; texts without words are alike.

Edge cases: null and empty text have one hash each and no shingle, and are
alike; a null doc_id takes part like any other; repeated rows share a label;
only doc_id and text are read, whatever other columns are called; an empty
table gives no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checked_join, forget, slices, written
from panelforge.llm.components import components
from panelforge.llm.simhash import fingerprint, links, shingle_hashes


def minima(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each of several orders of the hashes."""
    out = np.full(len(factors), 2**32 - 1, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 4096):  # a very long text in bounded memory
        out = np.minimum(out, (h[k : k + 4096, None] * factors + shifts).min(axis=0))
    return out


def with_keys(docs: DataFrame, width: int = 5, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, hash, fp, n, keys) of each row: a hash of the text, its SimHash, its distinct shingles and its keys; whole texts are read."""
    rng = np.random.default_rng(7)
    factors, shifts = (rng.integers(0, 2**32, bands * rows, dtype=np.uint32) for _ in range(2))
    factors |= np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, n, keys = [], [], []
            for text in b.column(2).to_pylist():
                own = shingle_hashes(text or "", width)
                fps.append(fingerprint(own))
                own = np.unique(own)
                n.append(len(own))
                low = minima(own, factors, shifts).reshape(bands, rows)
                keys.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "hash", "fp", "n", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long, n long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(hash, shingles) of each row: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [np.unique(shingle_hashes(t or "", width)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["hash", "shingles"])

    return docs.select(F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "hash long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `least` or more."""
    left, right = sets.select(F.col("hash").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("hash").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                x, y = (t.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= least * (len(x) + len(y) - both) - 1e-9
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return met.mapInArrow(run, "a long, b long")


def index_pairs(texts: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b), a > b, of texts (hash, fp) that the Gray-order index of their fingerprints links; equal fingerprints by their smallest hash."""
    first = written(texts.groupBy("fp").agg(F.min("hash").alias("p")), "near-prints")
    same = texts.join(first.hint("merge"), "fp").where("hash <> p").select(F.col("hash").alias("a"), F.col("p").alias("b"))
    ends = lambda c: first.select(F.col("fp").alias(c), F.col("p").alias(f"h{c}"))
    near = links(first.select("fp"), most).join(ends("a").hint("merge"), "a").join(ends("b").hint("merge"), "b")
    return same.unionByName(near.select(F.greatest("ha", "hb").alias("a"), F.least("ha", "hb").alias("b"))).distinct()


def prefix_pairs(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of texts (hash, label) of different labels that share a shingle of both prefixes."""
    held = open_.join(sets.hint("merge"), "hash").select("hash", "label", F.size("shingles").alias("n"), "shingles")
    each = written(held.select("hash", "label", "n", F.explode("shingles").alias("s")), "near-each")
    known = written(each.groupBy("s").count().where("count > 1"), "near-shared")
    met = checked_join(each, known, ["s"], "inner", known.count())
    own = F.col("n") - F.count("*")  # shingles that no other one has come first
    room = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - own
    texts = met.groupBy("hash", "label", "n").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("by"), own.alias("own"), room.cast("int").alias("room")).where("room > 0")
    keys = texts.select("hash", "label", "n", "own", F.posexplode(F.slice("by", 1, F.col("room"))).alias("at", "k"))
    keys = written(keys.select("k.s", "hash", "label", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left")), "near-prefixes")  # left: shingles from this one on
    sizes = keys.groupBy("s", "label").count().groupBy("s").agg(F.max_by("label", "count").alias("big"), F.count("*").alias("labels")).where("labels > 1").select("s", "big")
    mixed = written(sizes, "near-mixed")
    keys = checked_join(keys, mixed, ["s"], "inner", mixed.count())
    x, y = keys.where("label <> big").alias("x"), keys.alias("y")  # the largest group of a shingle does not meet itself
    once = (F.col("y.label") == F.col("y.big")) | (F.col("x.hash") > F.col("y.hash"))
    enough = F.least("x.left", "y.left") >= F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-9  # what can still be shared, if this is the first
    pairs = x.join(y.hint("merge"), (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & once & enough)
    return pairs.select(F.greatest("x.hash", "y.hash").alias("a"), F.least("x.hash", "y.hash").alias("b")).distinct()


def _close(x: Column, y: Column, least: float) -> Column:
    """Else the sizes alone rule a pair out."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, hash, label) of each row of docs; label: the smallest text hash of the group."""
    spark = docs.sparkSession
    texts = written(with_keys(docs, width, bands, rows), "near-keys")
    worded = texts.where("n > 0").select("hash", "fp").distinct()
    indexed = written(index_pairs(worded), "near-indexed")
    keyed = written(texts.dropDuplicates(["hash"]).select("hash", "n", F.explode(F.array_distinct("keys")).alias("key")), "near-keyed")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-common")
    members = written(checked_join(keyed, shared, ["key"], "inner", shared.count()), "near-members")
    forget(spark, keyed)
    central = written(members.groupBy("hash").agg(F.sum("m").alias("central")), "near-central")
    n_central = central.count()
    pivots = checked_join(members, central, ["hash"], "inner", n_central).groupBy("key").agg(F.max(F.struct("central", "hash", "n")).alias("pivot")).select("key", F.col("pivot.hash").alias("p"), F.col("pivot.n").alias("pn"))
    pivots = written(pivots, "near-pivots")
    stars = checked_join(members, pivots, ["key"], "inner", pivots.count()).where(F.col("hash") != F.col("p")).where(_close(F.col("n"), F.col("pn"), least))
    stars = written(stars.select(F.greatest("hash", "p").alias("a"), F.least("hash", "p").alias("b")).distinct(), "near-stars")
    asked = written(central.select("hash").union(indexed.select("a")).union(indexed.select("b")).distinct(), "near-asked")
    held = checked_join(docs.select("text").withColumn("hash", F.xxhash64("text")), asked, ["hash"], "left_semi", asked.count()).select("text")
    sets = written(shingle_sets(held, width).groupBy("hash").agg(F.first("shingles").alias("shingles")), "near-sets")
    stars = written(indexed.union(stars).distinct(), "near-proposed")
    found = written(confirmed(stars, sets, least), "near-found")
    labels = components(found)
    own = written(members.select("key", "hash").join(labels.hint("merge"), F.col("hash") == F.col("node"), "left").select("key", "hash", F.coalesce("label", "hash").alias("label")), "near-own")
    mixed = written(own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "near-open-keys")
    open_ = written(checked_join(own, mixed, ["key"], "left_semi", mixed.count()).select("hash", "label").distinct(), "near-open")
    rest = written(prefix_pairs(open_, sets, least).join(stars.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    more = written(confirmed(rest, sets, least), "near-more")
    if more.limit(1).count():
        labels = components(found.unionByName(more))
    for t in (members, own, open_, rest):
        forget(spark, t)
    return texts.select("doc_id", "hash").join(labels.hint("merge"), F.col("hash") == F.col("node"), "left").select("doc_id", "hash", F.coalesce("label", "hash").alias("label"))
