"""SimHash near-duplicates through a Gray-order hierarchical index.

Two fingerprints within d bits agree on one of d + 1 blocks of bits (for d = 3:
four blocks of 16), so each distinct fingerprint goes to d + 1 groups, one for
each block and its value. In a group, fingerprints stand in the order of their
Gray rank, where neighbours share long bit patterns. Runs of them are leaves;
a node holds the bits that all below it share (mask and pattern), and a child
only the bits that its parent lacks. A search adds up, from the root down, the
bits in which a query differs from the patterns, and leaves a whole subtree
when the sum passes d.

Groups above `group_rows` are cut into runs of that length. The shared bits of
two runs tell whether a pair of them can hold any link; only such pairs meet,
each in a task of its own. A task gives links that span its components, never
all pairs. Equal texts meet before, as one fingerprint.

Edge cases: a text without words (or null) has fingerprint zero and links like
any other; repeated rows share a component; null doc_id takes part with its
fingerprint, and is the component_id only if no other id is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import BROADCAST_ROWS, checked_join, slices, table, whole_rows, written
from panelforge.llm.components import components

LEAF = 32
FAN = 16


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the 64-bit hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # a very long text in bounded memory
        ones += np.unpackbits(hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = _lower(text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(" ".join(words).encode("utf-8", "surrogatepass"), 42)], np.uint64)
    cut = [words[k:] for k in range(width)]
    return np.array([digest(" ".join(s), 42) for s in zip(*cut, strict=False)], np.uint64)


_UPPER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower() takes A-Z alone


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, hash, fp) of each row: a hash of the text, and the fingerprint; whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(shingle_hashes(t, width)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long")


def gray_rank(c: Column) -> Column:
    """Place of a bit pattern in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def rotated(c: Column, bits: int) -> Column:
    return c if bits == 0 else F.shiftleft(c, bits).bitwiseOR(F.shiftrightunsigned(c, 64 - bits))


class GrayIndex:
    """Levels of (residual mask, pattern) over fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        masks, pats = [], []
        ones, zeros, step = fps, ~fps, LEAF
        while True:
            cut = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            masks.append(ones | zeros)
            pats.append(ones)
            step = FAN
            if len(ones) == 1:
                break
        self.levels = []  # from the root down
        for k in range(len(masks) - 1, -1, -1):
            residual = masks[k] if k == len(masks) - 1 else masks[k] & ~masks[k + 1][np.arange(len(masks[k])) // FAN]
            self.levels.append((residual, pats[k]))
        self.leaf_mask = masks[0]

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, fingerprint) of all pairs within `most` bits."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        acc = np.zeros(len(queries), np.int64)
        for depth, (residual, pat) in enumerate(self.levels):
            if depth:
                q, acc = np.repeat(q, FAN), np.repeat(acc, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(pat)
                q, acc, node = q[inside], acc[inside], node[inside]
            acc = acc + np.bitwise_count((queries[q] ^ pat[node]) & residual[node])
            near = acc <= most
            q, acc, node = q[near], acc[near], node[near]
        at = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        q, acc, own = np.repeat(q, LEAF), np.repeat(acc, LEAF), np.repeat(self.leaf_mask[node], LEAF)
        inside = at < len(self.fps)
        q, acc, at, own = q[inside], acc[inside], at[inside], own[inside]
        near = acc + np.bitwise_count((queries[q] ^ self.fps[at]) & ~own) <= most
        return q[near], at[near]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links that join what lies within `most` bits: inside left, or between left and right; both in Gray order."""
    if right is None and len(left) <= LEAF:  # one leaf
        near = np.bitwise_count(left[:, None] ^ left) <= most
        first = near.argmax(axis=1)
        if (near[first] == near).all():  # groups of mutual neighbours
            return [(int(left[i]), int(left[p])) for i, p in enumerate(first) if i != p]
    every = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(every))
    shift = 0 if right is None else len(left)
    index = GrayIndex(left if right is None else right)
    block = max(1, 2_000_000 // max(LEAF, len(index.fps)))
    for k in range(0, len(left), block):
        q, at = index.search(left[k : k + block], most)
        q, at = q + k, at + shift
        a, b = parent[q], parent[at]
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0) if apart.any() else ():
            x, y = _find(parent, x), _find(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while (parent != (up := parent[parent])).any():
            parent = up
    return [(int(every[i]), int(every[p])) for i, p in enumerate(parent) if i != p and every[i] != every[p]]


def links(fps: DataFrame, most: int = 3, group_rows: int = 20_000) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) at `most` or fewer differing bits."""
    blocks = most + 1
    width = 64 // blocks
    turned = [F.struct(F.lit(k).alias("turn"), rotated(F.col("fp"), k * width).alias("x")) for k in range(blocks)]
    keyed = fps.select(F.explode(F.array(*turned)).alias("t")).select("t.turn", "t.x")
    keyed = keyed.withColumns({"key": F.shiftrightunsigned("x", 64 - width), "rank": gray_rank(F.col("x"))})
    sizes = keyed.groupBy("turn", "key").count().where("count > 1")
    hot = written(sizes.where(F.col("count") > group_rows), "simhash-hot")
    few = hot.count()
    near = keyed.join(sizes.select("turn", "key").hint("merge"), ["turn", "key"], "left_semi")
    if few:
        near = checked_join(near, hot, ["turn", "key"], "left_anti", few)
    cold = near.select("turn", "key", F.lit(0).alias("cell"), F.lit(0).alias("side"), "rank", "x")
    if few:
        cold = cold.unionByName(_run_pairs(checked_join(keyed, hot.select("turn", "key"), ["turn", "key"], "inner", few), most, group_rows))
    ordered = cold.repartition("turn", "key", "cell").sortWithinPartitions("turn", "key", "cell", "side", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.table([b.column(k) for k in range(5)], ["turn", "key", "cell", "side", "x"])
            rest = t if rest is None else pa.concat_tables([rest, t])
            cols = [rest.column(k).to_numpy() for k in range(3)]
            ends = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            if len(ends):
                yield from _links_of(rest.slice(0, ends[-1]), ends, most, width)
                rest = rest.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield from _links_of(rest, np.array([rest.num_rows]), most, width)

    return ordered.select("turn", "key", "cell", "side", "x").mapInArrow(run, "a long, b long")


def _links_of(t: pa.Table, ends: np.ndarray, most: int, width: int) -> Iterator[pa.RecordBatch]:
    turn, side, x = (t.column(k).to_numpy() for k in (0, 3, 4))
    x = x.view(np.uint64)
    a, b = [], []
    begin = 0
    for end in ends:
        s, fp = side[begin:end], x[begin:end]
        found = spanning_links(fp, None, most) if s[-1] == 0 else spanning_links(fp[s == 0], fp[s == 1], most)
        if found:
            pair = np.array(found, np.uint64)
            bits = np.uint64(int(turn[begin]) * width)
            back = pair if bits == 0 else (pair >> bits) | (pair << (np.uint64(64) - bits))
            a.append(back[:, 0])
            b.append(back[:, 1])
        begin = end
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], ["a", "b"])


def _run_pairs(hot: DataFrame, most: int, group_rows: int) -> DataFrame:
    """Rows of large groups, once for each pair of runs that can hold links."""
    part = F.shiftrightunsigned("rank", 64 - 64 // (most + 1) - 6).bitwiseAND(F.lit(63))  # 64 ranges of a group's ranks
    w = W.partitionBy("turn", "key", "part").orderBy("rank")
    runs = hot.withColumn("part", part).withColumn("run", (F.row_number().over(w) - 1) / F.lit(group_rows)).withColumn("run", F.col("part") * F.lit(1 << 24) + F.floor("run"))
    runs = written(runs.select("turn", "key", "run", "rank", "x"), "simhash-runs")
    tops = runs.groupBy("turn", "key", "run").agg(F.bit_and("x").alias("ones"), F.bit_and(F.bitwise_not("x")).alias("zeros"))
    tops = written(tops.select("turn", "key", "run", F.col("ones").bitwiseOR(F.col("zeros")).alias("mask"), "ones"), "simhash-tops")
    a, b = tops.alias("a"), tops.alias("b")
    apart = F.bit_count(F.col("a.ones").bitwiseXOR(F.col("b.ones")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
    pairs = a.join(b.hint("merge"), (F.col("a.turn") == F.col("b.turn")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.run") <= F.col("b.run")) & (apart <= most))
    pairs = pairs.select("a.turn", "a.key", F.col("a.run").alias("left"), F.col("b.run").alias("right"))
    pairs = pairs.withColumn("cell", F.xxhash64("left", "right"))
    ends = pairs.select("turn", "key", F.col("left").alias("run"), "cell", F.lit(0).alias("side")).union(pairs.where("left <> right").select("turn", "key", "right", "cell", F.lit(1)))
    return runs.join(ends.hint("merge"), ["turn", "key", "run"]).select("turn", "key", "cell", "side", "rank", "x")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, hash, fp, label, component_id) of each row of docs; label: the component's smallest fingerprint."""
    prints = written(with_fingerprint(docs, width), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(distinct.select("fp"), most, group_rows))
    labelled = distinct.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = written(labelled.select("fp", "label", "first"), "simhash-labelled")
    alone = F.col("label") == F.col("fp")  # a label of one fingerprint needs no sum
    many = labelled.where(~alone).select("label").distinct()
    tops = written(labelled.join(many.hint("merge"), "label", "left_semi").groupBy("label").agg(F.min("first").alias("top")), "simhash-tops")
    member = checked_join(labelled, tops, ["label"], "left", tops.count()).select("fp", "label", F.coalesce("top", "first").alias("component_id"))
    member = written(member, "simhash-members")
    # a hot fingerprint is one row on this side; AQE splits its rows on the other
    return checked_join(prints, member, ["fp"], "inner", member.count()).select("doc_id", "hash", "fp", "label", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row of each group (doc_id, hash, label; by default those of the fingerprints): that with the smallest doc_id (null last), of several the one with the smallest text hash.

    What goes is named, not what stays: that is the smaller set, and while it
    is small enough to be broadcast no text is shuffled. Of rows with equal
    doc_id and text the first by their other columns (as JSON) stays.
    """
    texts = written((near_duplicates(docs) if groups is None else groups).groupBy("label", "doc_id", "hash").count(), "simhash-texts")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("hash").alias("hash"))
    first = texts.groupBy("label").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("count").alias("most"))
    first = written(first.where("first <> last OR most > 1").select("label", "first"), "simhash-first")
    gone = checked_join(texts, first, ["label"], "inner", first.count()).withColumn("stays", key == F.col("first")).where("NOT stays OR count > 1")
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "stays"), "simhash-gone")
    rows = gone.count()
    side = F.broadcast(gone) if rows <= BROADCAST_ROWS else gone.hint("merge")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash"))
    out = whole_rows(docs).join(side, same, "left_anti").select("_row.*")
    again = gone.where("stays")
    if again.limit(1).count():  # rows that repeat both doc_id and text: one of them stays
        side = F.broadcast(again) if rows <= BROADCAST_ROWS else again.hint("merge")
        one = whole_rows(docs).join(side, same).groupBy("_id", "_hash").agg(F.min_by("_row", F.to_json("_row", {"ignoreNullFields": "false"})).alias("_row"))
        out = out.unionByName(one.select("_row.*"))
    return out


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
