"""Ranked lexical search of many queries at once, through what their items share.

Weights and scores are integers (see `weights` and `Block.scores`), so that
sums agree in any order. One pass over the documents keeps, of each, its number
of terms and the counts of the items' terms; document frequencies follow from
that table. The items' term sets are mined for shared subsets: the pair of nodes
that most items hold together becomes a node of its own, again and again, until
no pair stands in two items. The result is a DAG whose leaves are terms (with
their repeats in an item). A task takes a block of documents and fills each
node's partial accumulator once, level by level; an item's scores are the sums
of its few top nodes. Each task keeps the best rows of every item.

Items come to the driver in blocks of `block_items`, each a stated set of
queries against all documents: memory holds one block's terms, and more items
mean more passes.

Edge cases: null and empty texts have no term and neither count nor rank; an
item without terms, or whose terms no document holds, has no row; repeated rows
of documents rank each on its own, repeated items are items of their own; equal
scores stand by doc_id, null last; other columns are not read; empty tables give
no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.llm.alignment import portions
from panelforge.llm.common import forget, table, written

#: Terms are runs of ASCII digits and letters and of all other code points beyond ASCII; A-Z are lower-cased.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Terms of an item that are mined together; a longer item is mined in parts of so many.
PART = 128
#: Documents whose accumulators a task holds at once.
BLOCK_DOCS = 256


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


@dataclass(frozen=True)
class Sharing:
    """A query-sharing DAG: leaves are (term, repeats), inner nodes sums of two earlier nodes, items sums of top nodes."""

    leaves: list[tuple[int, int]]
    inner: list[tuple[int, int]]
    tops: list[list[int]]

    def levels(self) -> list[np.ndarray]:
        """Inner nodes (node, left, right) by depth: a level needs only earlier ones."""
        depth = [0] * len(self.leaves)
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (x, y) in enumerate(self.inner):
            depth.append(1 + max(depth[x], depth[y]))
            by[depth[-1]].append((len(self.leaves) + k, x, y))
        return [np.array(by[d]).T for d in sorted(by)]


def shared_sets(items: list[dict[int, int]]) -> Sharing:
    """Mine items (term -> repeats): the most common pair of nodes becomes a node until none stands in two items."""
    leaf: dict[tuple[int, int], int] = {}
    own = [[leaf.setdefault(t, len(leaf)) for t in sorted(i.items())] for i in items]
    uses = Counter(x for nodes in own for x in nodes)
    parts, of = [], []
    for k, nodes in enumerate(own):
        often = sorted((x for x in nodes if uses[x] > 1), key=lambda x: (-uses[x], x))
        for s in range(0, len(often), PART):
            parts.append(set(often[s : s + PART]))
            of.append(k)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, nodes in enumerate(parts):
        for pair in combinations(sorted(nodes), 2):
            holders[pair].add(p)
    heap = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
    heapq.heapify(heap)
    inner: list[tuple[int, int]] = []
    while heap:
        n, pair = heapq.heappop(heap)
        now = len(holders[pair])
        if now < 2:
            continue
        if now != -n:  # fewer than when it was noted
            heapq.heappush(heap, (-now, pair))
            continue
        node = len(leaf) + len(inner)
        inner.append(pair)
        new: dict[int, set[int]] = defaultdict(set)
        for p in sorted(holders.pop(pair)):
            parts[p] -= set(pair)
            for x in parts[p]:
                for y in pair:
                    holders[(x, y) if x < y else (y, x)].discard(p)
                new[x].add(p)
            parts[p].add(node)
        for x, h in new.items():
            holders[(x, node)] = h
            if len(h) > 1:
                heapq.heappush(heap, (-len(h), (x, node)))
    tops = [[x for x in nodes if uses[x] == 1] for nodes in own]
    for p, nodes in enumerate(parts):
        tops[of[p]] += sorted(nodes)
    return Sharing(list(leaf), inner, tops)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Block:
    """Scores of all items over a block of documents."""

    def __init__(self, sharing: Sharing, weight: np.ndarray, n_docs: int, n_terms: int):
        self.term, self.repeats = (np.array([t[k] for t in sharing.leaves], np.int64) for k in (0, 1))
        self.levels = sharing.levels()
        self.nodes = len(sharing.leaves) + len(sharing.inner)
        self.items = np.array([k for k, t in enumerate(sharing.tops) if t], np.int64)
        self.tops = [np.array(sharing.tops[k]) for k in self.items]
        self.weight, self.n_docs, self.n_terms = weight, n_docs, n_terms

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """(item, document) sums of weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + (25 n N) div L."""
        m = 75 + 25 * n * self.n_docs // self.n_terms
        single = np.zeros((len(self.weight), len(n)), np.int64)
        single[term, doc] = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        acc = np.empty((self.nodes, len(n)), np.int64)
        acc[: len(self.term)] = single[self.term] * self.repeats[:, None]
        for node, x, y in self.levels:
            acc[node] = acc[x] + acc[y]
        return np.stack([acc[t].sum(axis=0) for t in self.tops]) if self.tops else np.empty((0, len(n)), np.int64)


class Best:
    """The `most` best rows of each item, by score and then doc_id (null last)."""

    def __init__(self, n_items: int, most: int):
        self.most, self.bar = most, np.ones(n_items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, null, doc_id

    def add(self, scores: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.bar[:, None])
        new = (item, scores[item, at], null[at], doc_id[at])
        item, score, none, doc = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((doc, none, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.bar)))
        rank = np.arange(len(order)) - first[item[order]]
        order = order[rank < self.most]
        self.rows = [x[order] for x in (item, score, none, doc)]
        last = np.append(np.flatnonzero(np.diff(self.rows[0])), len(order) - 1) if len(order) else []
        full = [k for k in last if rank[rank < self.most][k] == self.most - 1]
        self.bar[self.rows[0][full]] = self.rows[1][full]


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term; terms: those of the vocabulary that it holds."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for b in portions(batches, 1):
            keep, n, terms, tfs, ends = [], [], [], [], [0]
            for k, text in enumerate(b.column(1).to_pylist()):
                found = counted(text)
                if not found:
                    continue
                keep.append(k)
                n.append(found.total())
                held = [(i, c) for w, c in found.items() if (i := known.get(w)) is not None]
                terms += [i for i, _ in held]
                tfs += [c for _, c in held]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def best_of(rows: DataFrame, sharing: Sharing, weight: np.ndarray, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each item in each task."""
    shared = rows.sparkSession.sparkContext.broadcast((sharing, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shared.value, n_docs, n_terms)
        best = Best(len(block.items), most)
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK_DOCS):
                b = whole.slice(s, BLOCK_DOCS)
                sizes = b.column(2).value_lengths().to_numpy()
                doc = np.repeat(np.arange(b.num_rows), sizes)
                term, tf = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.add(block.scores(b.column(1).to_numpy(), doc, term, tf), null, b.column(0).fill_null(0).to_numpy())
        item, score, none, doc_id = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(block.items[item]), pa.array(doc_id, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _block(spark: SparkSession, docs: DataFrame, items: list[tuple], id_type: str, most: int) -> DataFrame:
    counts = [counted(text) for _, text in items]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
    sharing = shared_sets([{vocabulary[w]: c for w, c in found.items()} for found in counts])
    rows = written(term_counts(docs, vocabulary), "lexical-terms")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row a term of the block
        df[r["t"]] = r["count"]
    found = best_of(rows, sharing, weights(df, n_docs), n_docs, max(1, n_terms), most)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))  # an item's rows from all tasks meet in parts first
    part = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= most)
    top = part.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    top = written(top.select("item", "rank", "doc_id", "score"), "lexical-top")
    forget(spark, rows)
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"item long, item_id {id_type}")  # one row an item of the block
    return top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = 20, block_items: int = 1000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` documents of the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    stream = ((r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator())
    id_type = items.schema["item_id"].dataType.simpleString()
    out = []
    while block := list(islice(stream, block_items)):
        out.append(_block(spark, docs, block, id_type, most))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP12_SQL = rf"""
WITH held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
