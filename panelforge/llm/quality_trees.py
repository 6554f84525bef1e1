"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of all documents are DataFrame expressions. Trees are grown
depth by depth on histograms of at most 64 bins a feature, from a sample of at
most `sample_rows` labelled rows that the driver holds as numbers (picked by a
hash of the id). All trees lie in flat arrays; a batch of documents walks down
all of them together in numpy.

Edge cases: null or empty texts have zero statistics and are scored as such;
without labels of both kinds the score is the share of label 1 (0.5 if there
is no label); labels that repeat a doc_id count as the smallest; repeated rows
get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import table, written
from panelforge.llm.text_stats import FEATURES, with_counts, with_features

INPUTS = [*FEATURES, "word_chars", "n_dup_lines", "n_lines"]


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth: node k of a tree has children 2k + 1 and 2k + 2; below are leaves."""

    prior: float
    depth: int
    feature: np.ndarray  # (tree, inner node)
    threshold: np.ndarray  # (tree, inner node): left if value <= threshold
    leaf: np.ndarray  # (tree, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.feature):
            return out
        trees = np.arange(len(self.feature))
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[k : k + 4096] += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees of the logistic loss; splits by histograms of gradient and curvature."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(np.unique(y)) < 2:
        return Forest(prior, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: value <= cuts[b]
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(len(y), prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            place = node - first
            best = np.full(width, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = place * (bins + 1) + binned[:, f]
                hist = [np.bincount(key, w, width * (bins + 1)).reshape(width, -1) for w in (g, h)]
                (gl, hl), (ga, ha) = (np.cumsum(q, axis=1)[:, : len(c)] for q in hist), (q.sum(axis=1, keepdims=True) for q in hist)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                won = top > best
                best[won] = top[won]
                feature[t, first : first + width][won] = f
                threshold[t, first : first + width][won] = c[k[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        place = node - inner
        leaf[t] = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        margin += leaf[t, place]
    return Forest(prior, depth, feature, threshold, leaf)


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Forest:
    """Trees from at most sample_rows rows of stats (doc_id, features) with a label."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = stats.join(marked.hint("merge"), "doc_id").select(F.xxhash64(F.lit("trees"), "doc_id").alias("u"), "y", *INPUTS)
    got = rows.orderBy("u", *INPUTS).limit(sample_rows).collect()
    x = np.array([[float(r[c]) for c in INPUTS] for r in got]).reshape(len(got), len(INPUTS))
    return grow(x, np.array([float(r["y"]) for r in got]))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score) of every row of docs; rows where `learn` holds may be learned from."""
    stats = written(with_features(with_counts(docs.select("doc_id", "text"))).select("doc_id", *INPUTS), "trees-stats")
    forest = fit(stats.where(learn), labels, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # trees x nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[2:]], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.predict(x))], ["doc_id", "held_out", "score"])

    return stats.select("doc_id", (~learn).alias("held_out"), *INPUTS).mapInArrow(run, "doc_id long, held_out boolean, score double")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, learned from labels of those that are not held out."""
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, F.lit(True))
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), learn)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
