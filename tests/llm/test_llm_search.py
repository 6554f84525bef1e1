"""Tokenizer alignment, ranked search and HyperMinHash against plain code."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from panelforge.llm import alignment, hyperminhash, lexical, nearest
from panelforge.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n \n", " é ", "a▁b x", "<|endoftext|> hi <s> </s> <unk> <0x41>", "日本語☃ \x00 \x00a  b\n\n\tc   ", "x" * 50_000, "aaa  aaa", "a  ▁ b", "word " * 20_000, "it's 12,5 ÀB"]
CLASH = "doc_id long, text string, n long, same string, hash string, label long, terms string, a long, pair long, key string, row string"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(ODD)]
    return [*rows, rows[6], rows[4]]


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s", "h", 2, "t", 3, 4, "k", "r") for d, t in rows], CLASH)


def spans(strings):
    ends = np.cumsum([len(x) for x in strings]).tolist()
    return list(zip([0, *ends], ends, strict=False))


def plain_alignment(rows):
    bpe, model, strings = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.PlainBpe(A).strings
    bpe.encode_special_tokens = True
    found = []
    for doc_id, text in rows:
        a, b = (bpe.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        sa = [strings[k] for k in a]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b)]
        if {b"".join(sa), b"".join(sb)} != {f" {text}".encode()}:
            found.append((doc_id, [], [], [], []))
            continue
        sa, sb = spans(sa), spans(sb)
        links, j = [], 0
        for k, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            links += [(a[k], b[i]) for i in range(j, min(len(b), j + e - s)) if sb[i][0] < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in cuts]
        for side, ids, of in ((0, a, sa), (1, b, sb)):
            for x, g in zip(ids, np.searchsorted(cuts, [e for _, e in of]), strict=True):
                groups[g][side].append(x)
        found.append((doc_id, a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    shown = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return [(d, len(a), len(b), len(g), len(n), sum(counts[p] == best[p[0]] for p in n), sum(counts[p] for p in n), shown(g)) for d, a, b, g, n in found]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_alignment_against_plain_code(spark, docs, odd, most_pairs):
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), *[(None if d is None else d + 10_000, t) for d, t in odd]]
    got = alignment.aligned(clashing(spark, rows), A, B, most_pairs).collect()
    assert by_text(got) == by_text(plain_alignment(rows))


def test_alignment_of_nothing(spark, odd):
    assert alignment.aligned(clashing(spark, odd).limit(0), A, B).count() == 0
    none = [(1, None), (2, ""), (3, "▁")]
    assert by_text(alignment.aligned(clashing(spark, none), A, B).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_portions_hold_whole_texts():
    import pyarrow as pa

    texts = ["x" * k for k in (5, 0, 30, 4, 4, 4)] + [None]
    cut = list(alignment.portions(iter([pa.record_batch([pa.array(texts)], ["text"])]), 0, 10))
    assert [p.column(0).to_pylist() for p in cut] == [texts[:2], texts[2:3], texts[3:5], texts[5:]]


def test_piece_model_equals_the_library():
    rng, model = np.random.default_rng(5), alignment.PieceModel(B)
    raw = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = " \n\tab'é☃日\x00"
    texts = ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 20))) for _ in range(3000)]
    data = [f" {t}".encode() for t in texts]
    ids, edges = model.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == raw.encode(texts)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, most=20):
    terms = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in own:
            m = 75 + 25 * n * n_docs // n_terms
            scored.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c), d))
        scored = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:most]
        out += [(item, k, d, s) for k, (s, d) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("block_items", [1000, 7])
def test_search_against_plain_code(spark, docs, block_items):
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), (None, docs.text[0]), (None, None), (90_000, ""), (90_001, docs.text[0]), (90_001, docs.text[0]), (90_002, "Hello hello HÉLLO 12 " * 9000)]
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    items = [*zip(items.item_id.tolist(), items.text.tolist(), strict=True), (900, None), (901, ""), (902, "hello hello Héllo"), (903, "zzzunheard"), (904, " ".join(docs.text[:30]))]
    got = lexical.ranked(clashing(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), block_items=block_items)
    assert by_text(got.collect()) == by_text(plain_search(rows, items))


def test_search_of_nothing(spark, docs):
    some, none = clashing(spark, [(1, "a b")]), clashing(spark, [(1, None)])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(some, items).count() == 1
    assert lexical.ranked(some, items.limit(0)).count() == 0
    assert lexical.ranked(none, items).count() == 0
    assert lexical.ranked(some.limit(0), items).count() == 0


def test_shared_sets_hold_each_item_once():
    rng = np.random.default_rng(9)
    common = [rng.choice(400, 30, replace=False).tolist() for _ in range(5)]
    items = [{int(t): int(rng.integers(1, 3)) for t in [*common[k % 5], *rng.choice(400, 150 if k == 3 else 10, replace=False)]} for k in range(60)]
    items.append({})
    dag = lexical.shared_sets(items)
    holds = [Counter([leaf]) for leaf in dag.leaves]
    for x, y in dag.inner:
        holds.append(holds[x] + holds[y])
    for item, tops in zip(items, dag.tops, strict=True):
        assert sum((holds[t] for t in tops), Counter()) == Counter(item.items())
    under = [{k} for k in range(len(dag.leaves))]
    for k, (x, y) in enumerate(dag.inner, len(dag.leaves)):
        under.append(under[x] | under[y] | {k})
    users = Counter(x for tops in dag.tops for x in set().union(*(under[t] for t in tops)))
    assert dag.inner and all(users[len(dag.leaves) + k] > 1 for k in range(len(dag.inner)))  # every inner node serves two items
    assert sum(map(len, dag.tops)) + 2 * len(dag.inner) < 0.8 * sum(map(len, items))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_near(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, own in enumerate(sets):
        for i, n in Counter(i for s in own for i in holders.get(s, ())).items():
            if 100 * n >= 85 * (len(own) + len(sets[i]) - n):
                parent[top(k)] = top(i)
        for s in own:
            holders.setdefault(s, []).append(k)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(d)
    return [(d, len(sets[k]), c := min((x for x in ids[top(k)] if x is not None), default=None), d == c) for k, (d, _) in enumerate(rows)]


def test_near_sets_against_all_pairs(spark, docs, odd):
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), *[(None if d is None else d + 10_000, t) for d, t in odd], (None, docs.text[0]), (50_000, str(docs.text[0]).upper())]
    out = hyperminhash.near_sets(clashing(spark, rows)).collect()
    assert by_text((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in out) == by_text(plain_near(rows))


def test_near_sets_of_edited_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(800):
        w = [f"w{i}" for i in range(20 + k % 40)]
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 500)}"
        rows.append((k, " ".join(w)))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in hyperminhash.near_sets(clashing(spark, rows)).collect()]
    assert by_text(got) == by_text(plain_near(rows))
    assert hyperminhash.near_sets(clashing(spark, rows).limit(0)).count() == 0


def test_op13_columns(spark):
    out = QUERIES["op13_minhash"](spark, DATA)
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert dict(out.dtypes)["kept"] == "boolean"


@pytest.mark.parametrize(("n", "shared"), [(7, 6), (20, 17), (300, 255), (300, 150), (3000, 0)])
def test_registers_estimate_the_similarity(n, shared):
    rng, order, found = np.random.default_rng(n + shared), hyperminhash.lenders(160), []
    for _ in range(100):
        u = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        half = shared + (n - shared) // 2
        x, y = u[:half], np.concatenate([u[:shared], u[half:]])
        r = hyperminhash.sketches([x, y], 160, order)
        found.append(hyperminhash.similarity(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]))[0])
    assert abs(np.mean(found) - shared / n) < 0.012
    assert np.min(found) > shared / n - hyperminhash.SLACK * math.sqrt(0.13 / min(n, 160))


def test_registers_are_floats():
    low = np.array([1, 2, 3, 2**63, 2**64 - 2, 5 << 40], np.uint64)
    for x, r in zip(low.tolist(), hyperminhash.compressed(low).tolist(), strict=True):
        zeros = 64 - x.bit_length()
        assert r == zeros << 10 | ((x << (zeros + 1)) & (2**64 - 1)) >> 54


def test_nearest_of_repeated_ids(spark):
    """Rows of one id are candidates of each other, and each is a query of its own."""
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [0.0, 3.0]), (1, [0.0, 1.5]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest.nearest(df, df.where("vec_id = 0"), 3, block_rows=2).collect()
    near = sorted((r["rank"], r["vec_id"], r["score"]) for r in out)
    first = [(1, 0, 0.0), (2, 2, 0.0), (3, 1, 0.5)]  # of each of the two equal rows
    assert near == sorted([*first, *first, (1, 1, 1.5), (2, 0, 2.0), (3, 0, 2.0)])


@pytest.mark.parametrize("size", [1e160, 1e300, 1e-170, 1e-310, 1.0])
def test_nearest_of_any_magnitude(spark, size):
    x = np.random.default_rng(4).normal(size=(60, 5)) * size
    df = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), 4, block_rows=7).collect()}
    for q in (0, 20, 40):
        d = [math.dist(x[q], y) for y in x]
        order = [int(k) for k in np.argsort(d, kind="stable") if k != q][:4]
        assert [got[q, k + 1][0] for k in range(4)] == order
        assert [got[q, k + 1][1] for k in range(4)] == pytest.approx([d[k] for k in order], rel=1e-9 if size > 1e-300 else 1e-3)


def test_blocks_have_bounded_bytes(spark):
    df = spark.createDataFrame([(k, [float(k + 1)] * 100) for k in range(50)], "vec_id long, embedding array<double>").coalesce(1)
    blocks = nearest.packed(nearest.usable(df), 4096, 9_000).collect()
    assert len(blocks) == 5 and all(len(b["vals"]) + len(b["low"]) <= 9_000 for b in blocks)
    assert len(nearest.packed(nearest.usable(df), 4096, 10).collect()) == 50
