"""Alignment of two tokenizers over the same bytes, and how often their ids meet in the corpus.

A text is encoded with a leading space by a byte-level BPE (A) and by a piece
model (B), without special tokens. Byte offsets at which tokens of both end cut
the tokens into groups; an A and a B token are linked where their bytes overlap.
Between two neighbouring ends of either side lies exactly one link, so links are
found by merging the ends, never by comparing tokens.

Counting: an identity map gives each A id the B id of the same bytes. What links
by it (every exact one-to-one group) is counted in a vector as long as A's
vocabulary, one a task; only other pairs are shuffled, summed up before. The
rows then look their counts up in arrays of bounded size, or, above `most_pairs`
pairs, by a sort-merge join of the irregular pairs alone.

Edge cases: null, empty, and texts whose token bytes are not the text's (a text
that holds U+2581, which the piece model reads as a space) have no tokens: zeros
and an empty digest. Strings of special tokens are plain text. Repeated rows are
rows of their own, each a document for the counts; a null doc_id is a row like
others; other columns are not read; an empty table gives no row. A text's tokens
are held in one task, some twenty numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import forget, table, written
from panelforge.llm.packing import CACHE_WORDS, ByteBpe, default_tokenizer

#: Distinct irregular pairs up to which their counts go to the tasks as two sorted arrays (16 bytes a pair).
MOST_PAIRS = 2_000_000
#: Bytes of text that a task encodes at once, if no text alone is longer.
SLICE_BYTES = 4_000_000
STEP = 1 << 22


@dataclass(frozen=True)
class Pool:
    """Byte strings end to end."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(strings: list[bytes]) -> Pool:
        sizes = np.array([len(s) for s in strings], np.int64)
        return Pool(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The strings of the ids, end to end."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(n.sum())]

    def differ(self, ids: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Places where the joined strings, as long as want, are not want; a long text in bounded memory."""
        ends = np.cumsum(self.sizes[ids])
        cut = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP, len(want), STEP)), [len(ids)]]))
        found = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            begin = int(ends[a - 1]) if a else 0
            part = self.joined(ids[a:b])
            found.append(np.flatnonzero(part != want[begin : begin + len(part)]) + begin)
        return np.concatenate(found) if found else np.empty(0, np.int64)


class PlainBpe(ByteBpe):
    """A byte-level BPE to which strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added = []
        back = {chr(v): k for k, v in self.letters.items()}
        strings = [b""] * self.whole.get_vocab_size()
        for token, k in self.whole.get_vocab().items():
            strings[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.pool = Pool.of(strings)
        self.strings = strings


class PieceModel:
    """A sentencepiece model whose pieces hold gaps only in front; each distinct word with its gap is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        shown = [self.model.id_to_piece(k) for k in range(n)]
        self.by_bytes = np.array([self.model.is_byte(k) for k in range(n)])
        self.plain = ~np.array([self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k) for k in range(n)])
        self.strings = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(shown, self.by_bytes, strict=True)]
        self.pool = Pool.of(self.strings)
        space = self.model.piece_to_id("▁")
        self.by_word = bool(self.plain[space]) and not any("▁" in p.lstrip("▁") for p, own in zip(shown, self.plain, strict=True) if own)
        self.alone = {" ": np.array([space], np.int32)}  # the model would make nothing of it
        self.known: dict[str, np.ndarray] = dict(self.alone)
        self.older: dict[str, np.ndarray] = {}

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that each begin with a space, which the model itself adds."""
        out = [self.known.get(w) for w in words]
        for k, w in enumerate(words):
            if out[k] is None and w in self.older:
                out[k] = self.known[w] = self.older[w]
        new = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(new, self.model.encode([words[k][1:] for k in new], num_threads=1) if new else (), strict=True):
            out[k] = np.array(ids, np.int32)
            if len(words[k]) <= 64:
                self.known[words[k]] = out[k]
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = dict(self.alone), self.known
        return out

    def encode(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens before each edge) of texts end to end, each of which begins with a space."""
        gap = data == 32
        first = gap.copy()
        first[1:] &= ~gap[:-1]
        if not self.by_word:
            first[:] = False
        first[edges[:-1]] = True
        at = np.append(np.flatnonzero(first), len(data))
        coded = pa.Array.from_buffers(pa.utf8(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = self.ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        pool, starts = np.concatenate([*ids, np.empty(0, np.int32)]), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        return pool[np.repeat(starts[code] - (ends - n), n) + np.arange(n.sum())].astype(np.int64), np.concatenate([[0], ends])[np.searchsorted(at, edges)]


def identity(a: list[bytes], b: list[bytes], plain: np.ndarray, by_bytes: np.ndarray) -> np.ndarray:
    """For each A id the B id of the same bytes (a piece before a byte token), or -1."""
    of = {}
    for k in np.argsort(~by_bytes, kind="stable"):  # byte tokens first: pieces overwrite them
        if plain[k]:
            of[b[k]] = int(k)
    return np.array([of.get(x, -1) for x in a], np.int64)


class Pair:
    """Both tokenizers and the map between them, once a worker."""

    def __init__(self, a: str, b: str):
        self.a, self.b = PlainBpe(a), PieceModel(b)
        self.same = identity(self.a.strings, self.b.strings, self.b.plain, self.b.by_bytes)
        self.n_a, self.n_b = len(self.a.strings), len(self.b.strings)
        self.digits = Pool.of([b"%d," % k for k in range(max(self.n_a, self.n_b))])


@lru_cache(maxsize=1)
def pair_of(a: str, b: str) -> Pair:
    return Pair(a, b)


def tokens(pair: Pair, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(good, byte edges, A ids, A edges, B ids, B edges): edges run over the good texts, whose token bytes are space+text."""
    size = pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(size > 0)
    while True:
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.take(pa.array(good)).cast(pa.utf8()), pa.scalar(""))
        own = pair.a.encode(spaced)
        sizes_a = np.array([len(x) for x in own], np.int64)
        a = np.concatenate([*own, np.empty(0, "<u4")]).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size[good].astype(np.int64) + 1)])
        spaced = pa.concat_arrays([spaced])
        offsets = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        b, edge_b = pair.b.encode(data, edge) if len(good) else (np.empty(0, np.int64), np.zeros(1, np.int64))
        edge_a = np.concatenate([[0], np.cumsum(sizes_a)])
        total = [np.concatenate([[0], np.cumsum(p.pool.sizes[x])])[e] for p, x, e in ((pair.a, a, edge_a), (pair.b, b, edge_b))]
        bad = (np.diff(total[0]) != np.diff(edge)) | (np.diff(total[1]) != np.diff(edge))
        if not bad.any():
            for p, x in ((pair.a, a), (pair.b, b)):
                bad[np.unique(np.searchsorted(edge, p.pool.differ(x, data), "right") - 1)] = True
        if not bad.any():
            return good, edge, a, edge_a, b, edge_b
        good = good[~bad]


def _runs(key: np.ndarray, span: int, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Distinct keys % span of each owner key // span, ascending, and how often each occurs."""
    key, times = np.unique(key, return_counts=True)
    offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * span).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(key % span)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))


def _digests(pair: Pair, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, edges: np.ndarray) -> list[str]:
    """SHA-256 of a1,a2|b1;a3|b2 for each text; edges: places among all tokens of both sides."""
    na, nb = np.bincount(ga), np.bincount(gb)
    before = np.cumsum(na + nb) - (na + nb)
    at_a = before[ga] + np.arange(len(a)) - (np.cumsum(na) - na)[ga]
    at_b = before[gb] + na[gb] + np.arange(len(b)) - (np.cumsum(nb) - nb)[gb]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[before + na - 1], mark[before + na + nb - 1] = ord("|"), ord(";")
    out = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        sha = hashlib.sha256()
        for k in range(s, e, STEP):
            stop = min(k + STEP, e)
            shown = pair.digits.joined(ids[k:stop])
            shown[np.cumsum(pair.digits.sizes[ids[k:stop]]) - 1] = mark[k:stop]
            sha.update(shown[: len(shown) - (stop == e)].tobytes())
        out.append(sha.hexdigest())
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<long>, same_n array<long>, pairs array<long>, pairs_n array<long>"


def lined_up(pair: Pair, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row a text, as FIELDS: same holds the linked A ids whose B id is the identity map's, pairs the other linked pairs as a * |B| + b."""
    n = len(texts)
    good, edge, a, edge_a, b, edge_b = tokens(pair, texts)
    end_a, end_b = np.cumsum(pair.a.pool.sizes[a]), np.cumsum(pair.b.pool.sizes[b])
    found = {k: np.zeros(n, np.int64) for k in NUMBERS}
    digests = [""] * n
    own_a, own_b, doc = a[:0], b[:0], a[:0]
    if len(good):
        close_a, close_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        ga, gb = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        stops = np.union1d(end_a, end_b)  # each closes one link
        own_a, own_b = a[np.searchsorted(end_a, stops)], b[np.searchsorted(end_b, stops)]
        doc = good[np.searchsorted(edge, stops) - 1]
        found["n_a"][good], found["n_b"][good] = np.diff(edge_a), np.diff(edge_b)
        found["n_groups"][good] = np.diff(np.searchsorted(end_a[close_a], edge, "right"))
        found["n_links"][good] = np.diff(np.searchsorted(stops, edge, "right"))
        for k, sha in zip(good, _digests(pair, a, ga, b, gb, edge_a + edge_b), strict=True):
            digests[k] = sha
    same = pair.same[own_a] == own_b
    cols = [doc_ids, *(pa.array(found[k]) for k in NUMBERS), pa.array(digests, pa.string())]
    cols += _runs(doc[same] * pair.n_a + own_a[same], pair.n_a, n)
    cols += _runs((doc[~same] * pair.n_a + own_a[~same]) * pair.n_b + own_b[~same], pair.n_a * pair.n_b, n)
    return pa.RecordBatch.from_arrays(cols, ["doc_id", *NUMBERS, "groups_sha256", "same", "same_n", "pairs", "pairs_n"])


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many bytes of text, or of one row."""
    for b in batches:
        size = np.cumsum(pc.coalesce(pc.binary_length(b.column(column)), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < b.num_rows:
            stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right")))
            yield b.slice(k, stop - k)
            k = stop
    pa.default_memory_pool().release_unused()


def lined_up_docs(docs: DataFrame, a: str, b: str) -> DataFrame:
    """FIELDS of every row of docs; whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for part in portions(batches, 1):
            yield lined_up(pair, part.column(0), part.column(1))

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)


def same_counts(rows: DataFrame, n_a: int) -> np.ndarray:
    """Documents that hold each A id linked with the B id of the same bytes: a vector a task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_a, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_a)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["a", "n"])

    out = np.zeros(n_a, np.int64)
    for r in rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most |A| rows
        out[r["a"]] = r["n"]
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): documents that hold each irregular pair linked."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _add(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Sums of values by list."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = lists.offsets.to_numpy()
    return np.diff(ends[at - at[0]])


def aligned(docs: DataFrame, a: str, b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    spark = docs.sparkSession
    pair = pair_of(a, b)
    n_a, n_b = pair.n_a, pair.n_b
    rows = written(lined_up_docs(docs, a, b), "align-rows")
    counts = written(pair_counts(rows), "align-pairs")
    same = same_counts(rows, n_a)
    best = same.copy()
    for r in counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("n")).collect():  # at most |A| rows
        best[r["a"]] = max(best[r["a"]], r["n"])
    few = counts.count() <= most_pairs
    keys = n = np.empty(0, np.int64)
    if few:
        held = counts.toArrow()
        keys, n = held.column("pair").to_numpy(), held.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        forget(spark, counts)
    known = spark.sparkContext.broadcast((same, best, keys, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, keys, n = known.value
        for x in batches:
            ids, times = x.column("same").flatten().to_numpy(), x.column("same_n").flatten().to_numpy()
            n_best, total = _add(x.column("same"), times * (same[ids] == best[ids])), _add(x.column("same"), times * same[ids])
            out = [x.column(c) for c in ("doc_id", *NUMBERS)]
            if few:
                ids, times = x.column("pairs").flatten().to_numpy(), x.column("pairs_n").flatten().to_numpy()
                c = n[np.searchsorted(keys, ids)]
                n_best, total = n_best + _add(x.column("pairs"), times * (c == best[ids // n_b])), total + _add(x.column("pairs"), times * c)
            rest = [] if few else [x.column("pairs"), x.column("pairs_n"), pa.array(np.arange(x.num_rows))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_best), pa.array(total), x.column("groups_sha256"), *rest], [*names, *(["pairs", "pairs_n", "place"] if not few else [])])

    names = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    if few:
        return rows.mapInArrow(run, schema)
    own = written(rows.mapInArrow(run, f"{schema}, pairs array<long>, pairs_n array<long>, place long").drop("place").withColumn("row", F.expr("uuid()")), "align-open")
    tops = spark.createDataFrame([(k, int(v)) for k, v in enumerate(best)], "a long, top long")  # |A| rows
    ranked = counts.join(F.broadcast(tops), F.expr(f"pair div {n_b}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    each = own.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pairs_n").alias("times"))
    met = each.join(ranked.hint("merge"), "pair").groupBy("row").agg(F.sum(F.expr("times * is_best")).alias("more_best"), F.sum(F.expr("times * n")).alias("more"))
    out = own.drop("pairs", "pairs_n").join(met.hint("merge"), "row", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.select("doc_id", *NUMBERS, plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document, and how often its links occur in the corpus."""
    return aligned(table(spark, sf_dir, "documents"), default_tokenizer(), default_pieces())
