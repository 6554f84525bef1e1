"""Language ID by nearest centroids of TF-IDF character n-grams.

A text becomes a vector of hashed 1- to 3-grams of its lower-cased letters
(other characters are one gap), with (1 + log tf) * idf weights and length 1.
Each language has several centroids, found by spherical k-means; a text takes
the language of the centroid with the largest cosine. A text that lies further
from it than texts of its length did in training, with a margin, is rejected.

The model is fitted on at most `per_lang` labelled texts a language (whole
texts, the first by a hash of the id) and at most `most` in all, but on one of
each language, however many languages there are. All texts are then scored, in
batches, by one product with the centroids.

A letter is what str.isalpha() says it is, so numbers of any script are none.

Edge cases: null text and text without a letter are `und`, score 0, rejected;
without any labelled text every text is; null lang is not learned from; very
long texts are counted in slices; repeated rows get the same answer; other
columns are not read by op6 and carried whole by keep_identified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import forget, slices, table, written

BITS = 12
_MAYBE = re.compile(r"[^\W\d_]")  # letters, and numbers that are no decimal digits


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _MAYBE.finditer(text))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroid, feature), length 1
    lang_of: np.ndarray  # place in langs of each centroid
    floor: np.ndarray  # least cosine by length (log2 of letters)


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> np.ndarray:
    """n-grams of a text by bin."""
    out = np.zeros(1 << BITS, np.int64)
    for k in range(0, max(1, len(text)), 1 << 20):
        part = text[max(0, k - 2) : k + (1 << 20)] if k else text[: 1 << 20]
        c = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_is_letter()[c], c, np.uint32(32))
        c = c[(c != 32) | np.concatenate([[True], c[:-1] != 32])] if len(c) else c
        for h in (c * np.uint32(2654435761), (c[:-1] * np.uint32(31) + c[1:]) * np.uint32(2246822519), ((c[:-2] * np.uint32(31) + c[1:-1]) * np.uint32(31) + c[2:]) * np.uint32(3266489917)):
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf)


def _length(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(tf.sum(axis=-1), 1)).astype(int), 20)


def fit(docs: DataFrame, per_lang: int = 300, most: int = 3000, clusters: int = 3, rounds: int = 12, margin: float = 0.7) -> Model:
    """A model from rows (doc_id, text, lang); the sample comes to the driver as counts."""
    have = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in have.groupBy("lang").count().collect()}  # one row a language
    per = max(1, min(per_lang, most // max(1, len(sizes))))
    u = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_003))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1_000_003 * min(1.0, (4 * per + 20) / n)))]), F.col("lang")) if sizes else F.lit(0)
    order = Window.partitionBy("lang").orderBy("u", "doc_id", F.xxhash64("text"))  # over some times `per` texts a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counts(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], ["lang", "tf", "u"])

    drawn = have.withColumn("u", u).where(F.col("u") < share).where(F.col("text").rlike(r"\p{L}"))
    drawn = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per)
    sample = written(drawn.select("lang", "text", "u").mapInArrow(run, "lang string, tf binary, u long"), "lang-sample")
    rows = sample.orderBy("u", "lang", "tf").collect()  # at most `most`, or one a language
    forget(docs.sparkSession, sample)
    langs = sorted({r["lang"] for r in rows})
    tf = np.stack([np.frombuffer(r["tf"], "<i4") for r in rows]) if rows else np.zeros((0, 1 << BITS), "<i4")
    y = np.array([langs.index(r["lang"]) for r in rows], int)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _weighted(tf, idf)
    centres, lang_of = [], []
    rng = np.random.default_rng(11)
    for k in range(len(langs)):
        own = x[y == k]
        c = own[rng.permutation(len(own))[:clusters]]
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            c = _unit(np.stack([own[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        centres.append(c)
        lang_of += [k] * len(c)
    if not rows:
        return Model([], idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(21))
    centroids, lang_of = np.concatenate(centres), np.array(lang_of)
    best = (x @ centroids.T).max(axis=1)
    size, floor = _length(tf), np.zeros(21)
    for k in range(21):  # texts that are at least half as long; short texts share fewer n-grams with a centroid
        like = best[(size >= k - 1) & (size <= k + 1)]
        floor[k] = margin * np.quantile(like, 0.01) if len(like) >= 20 else 0.0
    return Model(langs, idf, centroids, lang_of, floor)


def judged(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    read = [k for k, t in enumerate(texts) if t and has_letter(t)] if m.langs else []
    for k in range(0, len(read), 256):
        at = read[k : k + 256]
        tf = np.stack([counts(texts[i]) for i in at])
        cos = _weighted(tf, m.idf) @ m.centroids.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(at)), best]
        for i, j in zip(at, best, strict=True):
            lang[i] = m.langs[m.lang_of[j]]
        score[at] = np.clip(top, 0, 1)
        rejected[at] = top < m.floor[_length(tf)]
    return lang, score, rejected


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def _fitted(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from rows that are not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(docs))  # a fixed size: features x centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score, rejected = judged(b.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(~judged(b.column(at).to_pylist(), sent.value)[2]))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text of documents."""
    return identified(table(spark, sf_dir, "documents"))
