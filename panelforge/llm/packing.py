"""Packing of token pieces into sequences by a configuration linear program.

Documents are tokenised and cut into pieces. The lengths of all pieces form a
histogram (at most `capacity` counts, whatever the input), whose configuration
linear program is solved and rounded in configurations.py.
Pieces get their place by their rank within their length, counted in buckets
so that a common length is no hot group.

Edge cases: null and empty text is the end token alone; a document of exactly
`capacity` tokens is one piece; repeated rows are packed each on its own; an
empty table gives no piece.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.llm import configurations
from panelforge.llm.common import slices, table, written

CAPACITY = 1024
END = 2
#: Pieces of text whose ids a worker keeps, in two halves: the older half goes when the younger is full.
CACHE_WORDS = 120_000
#: How byte-level BPE cuts a text before merging (a fixed value of that kind of vocabulary).
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _bytes(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[r.start : r.stop] = True
    return out


_LETTER, _VISIBLE, _GAP = _bytes(range(65, 91), range(97, 123)), _bytes(range(33, 127)), _bytes(range(9, 14), range(32, 33))


def cuts(data: np.ndarray, edges: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Places in UTF-8 bytes where the pattern _CUT certainly begins a new match, the texts' edges among them.

    The last gap before a visible character is apart from the gaps before it; a
    space then belongs to what follows, any other gap stands alone. Letters end
    at ASCII that is no letter. Other places are left to the pattern.
    """
    found = []
    for s in range(0, len(data), step):  # a very long text in bounded memory
        lo = max(0, s - 2)
        x = data[lo : s + step + 2]
        visible, letter = _VISIBLE[x], _LETTER[x]
        last = _GAP[x]
        last[:-1] &= visible[1:]
        last[-1:] = False
        edge = edges[(edges > lo) & (edges < lo + len(x))] - lo
        last[edge - 1] = False
        cut = last.copy()
        cut[1:] |= (x[1:] == 32) & visible[:-1]
        cut[1:] |= last[:-1] & (x[:-1] != 32)
        plain = (x < 128) & ~letter
        letter[1:] |= (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] != 0x97) & (x[1:] != 0xB7)  # Latin-1 letters
        cut[1:] |= letter[:-1] & plain[1:]
        cut[edge] = True
        found.append(np.flatnonzero(cut[s - lo : s - lo + step]) + s)
    every = np.concatenate([[0], *found, [len(data)]])
    return every[np.concatenate([every[1:] > every[:-1], [True]])]


class ByteBpe:
    """Ids of texts by a byte-level BPE of the tokenizers library, each distinct piece merged once.

    Texts are cut column-wise where the pattern certainly cuts, and what is left
    by the pattern itself; the library's model merges the pieces. Texts that hold
    an added token's string go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.space = chr(self.letters[32])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, x: str) -> bytes:
        if x.isascii() and x[1:].isalnum():
            shown = self.space + x[1:] if x[0] == " " else x.translate(self.letters)
        else:
            shown = x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, x: str) -> bytes:
        if (x[1:] if x[0] == " " else x).isalpha():
            return self.merged(x)
        return b"".join([self.merged(p) for p in _CUT.findall(x)])

    def ids(self, words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            found = self.known.get(w)
            if found is None:
                found = self.older.get(w)
                if found is None:
                    found = self.word(w)
                if len(w) <= 64:
                    self.known[w] = found
            out.append(found)
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no null)."""
        source, held = texts, np.zeros(len(texts), bool)
        for token in self.added:
            held |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if held.any():
            texts = pc.if_else(pa.array(held), "", texts)
        texts = pa.concat_arrays([texts.cast(pa.utf8())])
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        at = cuts(data, edges)
        coded = pa.Array.from_buffers(pa.utf8(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = self.ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        tokens = pool[np.repeat(starts[code] - (ends - n), n) + np.arange(n.sum())]
        edge = np.concatenate([[0], ends])[np.searchsorted(at, edges)]
        out = [tokens[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for i in np.flatnonzero(held):
            out[i] = np.array(self.whole.encode(source[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
        return out


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's pieces; whole texts are read."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer_of(tokenizer)
        for b in slices(batches):
            doc, piece, start, length, crc, own = [], [], [], [], [], []
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
                    if with_ids:
                        own.append(ids[s:e].astype(np.int32))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.list_(pa.int32()))] if with_ids else cols, [*names, "ids"] if with_ids else names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, fields)


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    made = configurations.plan(counts, capacity)
    buckets = max(8, -(-sum(counts.values()) // 1_000_000))
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for config, m in zip(made.configs, made.times, strict=True):
        offset = 0
        for n in sorted(config, reverse=True):
            k = config[n]
            ranges.setdefault(n, []).append((taken.get(n, 0), base, k, offset))
            taken[n] = taken.get(n, 0) + m * k
            offset += k * n
        base += m
    table_of = {n: np.array(r, np.int64).T for n, r in ranges.items()}
    bucketed = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = bucketed.groupBy("length", "_bucket").count()
    before = before.select("length", "_bucket", (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    before = written(before, "pack-before")
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    side = F.broadcast(before) if before.count() <= 200_000 else before.hint("merge")
    ranked = bucketed.withColumn("_rank", rank).join(side, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_bucket", "_before")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, at = b.column(names.index("length")).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, start, k, shift = table_of[int(n)]
                r = np.searchsorted(first, at[own], "right") - 1
                inside = at[own] - first[r]
                seq[own] = start[r] + inside // k[r]
                off[own] = shift[r] + inside % k[r] * n
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs with their place: one row a piece."""
    return placed(written(pieces(docs, tokenizer or default_tokenizer(), capacity), "pack-pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences."""
    out = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
