"""Line dedup by pairwise alignment.

Lines of at least `rare_words` words propose pairs: each document that holds
such a line is paired with the first document (smallest id) that holds it, so a
line that n documents share gives n - 1 pairs, never all pairs, and the first
copy of every line stays somewhere. Every shortest run of consecutive lines that
holds `block_words` words, from each of its first and each of its last lines,
proposes the same way: those runs cover each block that an earlier document has,
whichever documents hold its lines first and however short they are. Each pair
is aligned by patience diff:
lines that are unique in both, in their longest common order, are anchors, and
equal neighbours grow from them. Runs of aligned lines with at least
`block_words` words are deleted from the later document. Shorter lines between
a run's ends count if they are equal too. An alignment finds no anchor among lines
that all repeat, and no block that stands in another order: so what it leaves is
searched for shortest runs that the earlier document holds at any place.

Edge cases: null and empty texts have no lines and stay as they are; a text
that was a copy throughout becomes empty; rows with equal doc_id and text are
one document and are edited alike; of rows that share a doc_id alone, and of
null ids (after all others), the smaller text hash is the earlier; an empty
table stays empty.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_ROWS, GAP, n_words_of, table, whole_rows, written

#: An odd factor for the hashes of runs, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
#: The most line places that are broadcast in all.
BROADCAST_PLACES = 2_000_000


def anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Patience diff: places (in a, in b) of lines unique in both, as the longest sequence that rises in both."""
    in_a, in_b = Counter(a.tolist()), Counter(b.tolist())
    place = {x: j for j, x in enumerate(b.tolist()) if in_b[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a.tolist()) if in_a[x] == 1 and x in place]
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of equal lines, grown from the anchors; lines repeated in a text align between them."""
    runs: list[tuple[int, int, int]] = []
    pending = [(0, len(a), 0, len(b))]
    while pending:
        a0, a1, b0, b1 = pending.pop()
        found = anchors(a[a0:a1], b[b0:b1])
        last_a, last_b = a0, b0
        for i, j in [(i + a0, j + b0) for i, j in found]:
            if i < last_a or j < last_b:
                continue
            s, t = i, j
            while s > last_a and t > last_b and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            e, u = i + 1, j + 1
            while e < a1 and u < b1 and a[e] == b[u]:
                e, u = e + 1, u + 1
            if found and (s > last_a and t > last_b):
                pending.append((last_a, s, last_b, t))
            runs.append((s, t, e - s))
            last_a, last_b = e, u
        if found and last_a < a1 and last_b < b1:
            pending.append((last_a, a1, last_b, b1))
    return sorted(runs)


def held_runs(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, words_earlier: np.ndarray, block_words: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs that the earlier document holds at any place, but for those inside `found`."""
    start, end, key = run_keys(later, words, block_words)
    known = np.zeros(len(later) + 1, np.int64)
    for s, e in found:
        known[s + 1 : e + 1] = 1
    known = np.cumsum(known)
    at = np.flatnonzero(known[end] - known[start] < end - start)
    if not len(at):
        return []
    place, _, keys = run_keys(earlier, words_earlier, block_words)
    order = np.argsort(keys, kind="stable")
    near = np.searchsorted(keys[order], key[at])
    out = []
    for k, i in zip(at, near, strict=True):
        if i == len(keys) or keys[order[i]] != key[k]:
            continue
        s, e, p = int(start[k]), int(end[k]), int(place[order[i]])
        if np.array_equal(later[s:e], earlier[p : p + e - s]):
            out.append((s, e))
    return out


def common_blocks(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, words_earlier: np.ndarray, block_words: int) -> list[tuple[int, int]]:
    """[start, end) of the later document's lines to delete."""
    out = []
    for s, _, n in aligned(later, earlier):
        if words[s : s + n].sum() >= block_words:
            out.append((s, s + n))
    return sorted(out + held_runs(later, words, earlier, words_earlier, block_words, out))


def run_keys(lines: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key) of the shortest runs with block_words words, from each first and from each last line that has any."""
    total = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
    at = np.flatnonzero(words > 0)
    ahead = np.searchsorted(total, total[at] + block_words)
    back = np.searchsorted(total, total[at + 1] - block_words, "right") - 1
    start, end = np.concatenate([at[ahead < len(total)], back[back >= 0]]), np.concatenate([ahead[ahead < len(total)], (at + 1)[back >= 0]])
    power, turn = np.full(len(lines) + 1, _BASE, np.uint64), np.full(len(lines) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = turn[0] = 1
    power, turn = np.multiply.accumulate(power), np.multiply.accumulate(turn)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * power[:-1], dtype=np.uint64)])
    return start, end, ((sums[end] - sums[start]) * turn[start]).view(np.int64)  # the same wherever the run stands


def line_rows(docs: DataFrame) -> DataFrame:
    """(id, hash, lines, words) of each document: 64-bit hashes of its lines without outer gaps, and their words."""
    split = F.split(F.col("text"), "\n", -1)
    trimmed = F.transform(split, lambda x: F.trim(F.regexp_replace(x, GAP, " ")))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), trimmed.alias("_l"))
    return rows.select("id", "hash", F.transform("_l", lambda x: F.xxhash64(x)).alias("lines"), F.transform("_l", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)).alias("words"))


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}id").isNull().alias("none"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}hash").alias("hash"))


def _proposing_runs(rows: DataFrame, block_words: int) -> DataFrame:
    """(doc, line): the distinct run keys of each document, as further lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keys = [np.unique(run_keys(*(t.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3)), block_words)[2]) for k in range(t.num_rows)]
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            own = pa.array(np.repeat(np.arange(t.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([t.column(0).take(own), t.column(1).take(own), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))], ["id", "hash", "line"])

    found = rows.select("id", "hash", "lines", "words").mapInArrow(run, "id long, hash long, line long")
    return found.select(_order().alias("doc"), "line")


def removals(docs: DataFrame, rare_words: int = 5, block_words: int = 40) -> DataFrame:
    """(id, hash, gone): places of the lines to delete, for each document that loses some."""
    rows = written(line_rows(docs), "lines-docs").where(F.exists("words", lambda x: x > 0))
    long = rows.select(_order().alias("doc"), F.explode(F.array_distinct(F.transform(F.filter(F.arrays_zip("lines", "words"), lambda x: x["words"] >= rare_words), lambda x: x["lines"]))).alias("line"))
    long = written(long.unionByName(_proposing_runs(rows, block_words)), "lines-long")
    first = written(long.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("line", "first"), "lines-first")
    n = first.count()
    side = F.broadcast(first) if n <= BROADCAST_ROWS else first.hint("merge")
    pairs = written(long.join(side, "line").where("doc <> first").select("doc", "first").distinct(), "lines-pairs")
    own = rows.withColumn("doc", _order()).dropDuplicates(["doc"])
    a = own.select("doc", F.col("lines").alias("a"), F.col("words").alias("w"))
    b = own.select(F.col("doc").alias("first"), F.col("lines").alias("b"), F.col("words").alias("v"))
    met = pairs.join(b.hint("merge"), "first").join(a.hint("merge"), "doc").select("doc.id", "doc.hash", "a", "w", "b", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out: dict[str, list] = {"id": [], "hash": [], "gone": []}
            lists = [t.column(k) for k in (2, 3, 4, 5)]
            for k in range(t.num_rows):
                a_, w_, b_, v_ = (x[k].values.to_numpy(zero_copy_only=False) for x in lists)
                gone = [p for s, e in common_blocks(a_, w_, b_, v_, block_words) for p in range(s, e)]
                if gone:
                    for name, x in zip(out, (t.column(0)[k].as_py(), t.column(1)[k].as_py(), gone), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("gone", pa.list_(pa.int32()))]))

    found = met.mapInArrow(run, "id long, hash long, gone array<int>")
    return found.groupBy("id", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def with_removals(docs: DataFrame, rare_words: int = 5, block_words: int = 40) -> DataFrame:
    """(_row, _gone): the rows of docs and the places of their lines to delete, or null."""
    gone = written(removals(docs, rare_words, block_words), "lines-gone")
    side = gone.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("gone").alias("_gone"))
    rows, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    side = F.broadcast(side) if rows <= BROADCAST_ROWS and places <= BROADCAST_PLACES else side.hint("merge")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_row.text") == F.col("_hash"))
    return whole_rows(docs).join(side, same, "left").drop("_id", "_hash")


def text_left() -> Column:
    """The text of a row of with_removals() without the lines to delete."""
    lines = F.filter(F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    return F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(lines, "\n"))


def deduplicated(docs: DataFrame, rare_words: int = 5, block_words: int = 40) -> DataFrame:
    """docs with the repeated blocks deleted from later documents; every row stays."""
    left = with_removals(docs, rare_words, block_words)
    return left.select(F.col("_row").withField("text", text_left()).alias("_row")).select("_row.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines deleted, words left, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone"))
    text = F.col("_row.text")
    out = with_removals(docs).select("_row.doc_id", F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"), text_left().alias("text"))
    return out.select("doc_id", "n_lines", "n_deleted", n_words_of(F.col("text")).alias("n_words_left"), "text")
