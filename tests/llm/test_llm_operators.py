"""Training-data operators against brute force, on the small tables and on edge cases."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from panelforge.llm import chat, configurations, language_id, line_dedup, mixing, near_texts, nearest, packing, quality_rules, quality_trees, simhash, template, text_stats, warc
from panelforge.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000
TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c", "Ünï cödé ÀB", "x\ny\nx\n\nx", "the cat sat on the mat " * 8, LONG, "<|endoftext|> WARC/1.1\r\n</turn> ###", "日本語 テキスト"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, copies long, target string, _kept long, fp string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(k if k != 3 else None, t, ["en", None, "fr"][k % 3], ["s", None, "t"][k % 3], None, 1.0, 7, "x", 5, "f") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[8], (1, "other text of document one", "en", "s", 3, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    order = lambda df: df[cols].sort_values([c for c in cols if df[c].dtype.kind != "f"] or cols).reset_index(drop=True)
    got, want = order(got), order(want)
    for c in cols:
        if want[c].dtype.kind == "f" or str(want[c].dtype) in ("Float64", "Int64"):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)
        else:
            assert list(got[c]) == list(want[c]), c


def stats(t):
    w, t = words(t), t or ""
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(inside)


def test_text_counts(spark, edge, docs):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = spark.createDataFrame(docs[["doc_id", "text"]].astype({"text": str}))
    for df in (edge.select("doc_id", "text"), more):
        for r in text_stats.with_counts(df).collect():
            assert tuple(r[c] for c in cols) == stats(r["text"]), r["doc_id"]


def test_quality_rules(spark, edge, empty):
    out = QUERIES["op1_quality_rules"](spark, DATA).toPandas()
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    m = out.merge(labels, on="doc_id")
    assert m[m.quality == 1].kept[~m.base_failed].mean() > 0.97
    assert (out.base_failed == ((out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words))).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.quality_rules(edge, none).collect()
    assert len(rows) == edge.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules.quality_rules(empty, none).count() == 0


def test_rules_find_a_threshold(spark):
    rows = [(float(k % 100) / 100, float(k % 7), k % 100 >= 80) for k in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, bad boolean")
    rules = quality_rules.fit(df, ["a", "b"])
    kept = df.withColumn("kept", quality_rules.decision_list(rules)).collect()
    assert sum(r["kept"] == r["bad"] for r in kept) <= 0.03 * len(kept)


def test_rules_against_a_plain_learner(spark):
    import math

    rng = np.random.default_rng(12)
    x = rng.integers(0, 9, (1500, 3)).astype(float)
    bad = ((x[:, 0] >= 7) & (x[:, 1] < 4)) | ((x[:, 2] == 0) & (rng.random(1500) < 0.97)) | (rng.random(1500) < 0.02)
    df = spark.createDataFrame([(*map(float, r), bool(y)) for r, y in zip(x, bad, strict=True)], "a double, b double, c double, bad boolean")
    from pyspark.sql import functions as F

    part = np.array([r[0] for r in df.select(F.pmod(F.xxhash64("a", "b", "c", "bad"), F.lit(3)) == 0).collect()])  # the held rows
    want, left = [], np.ones(1500, bool)
    while len(want) < 8:
        conds, held, now = [], [], left.copy()
        while len(conds) < 3:
            grow = now & ~part
            if (grow & bad).sum() < 4:
                break
            base, best = math.log2((grow & bad).sum() / grow.sum()), None
            for f in range(3):
                for t in range(9):
                    for above in (True, False):
                        hit = x[:, f] > t if above else x[:, f] <= t
                        p, n = (grow & bad & hit).sum(), (grow & ~bad & hit).sum()
                        if p >= 4 and (best is None or p * (math.log2(p / (p + n)) - base) > best[0] + 1e-12):
                            best = p * (math.log2(p / (p + n)) - base), (f, above, t), hit, n
            if best is None or best[0] <= 1e-9:
                break
            conds.append(best[1])
            now = now & best[2]
            p, n = (now & part & bad).sum(), (now & part & ~bad).sum()
            held.append(((p - n) / max(1, p + n), p, n, now.copy()))
            if best[3] == 0:
                break
        if not conds:
            break
        k = min(range(len(conds)), key=lambda k: (-held[k][0], k))
        if not held[k][1] or held[k][1] < 0.9 * (held[k][1] + held[k][2]):
            break
        want.append((conds[: k + 1], int((held[k][3] & bad).sum()), int(held[k][3].sum())))
        left &= ~held[k][3]
    got = quality_rules.fit(df, ["a", "b", "c"])
    assert [([("abc".index(c.feature), c.above, c.threshold) for c in r.conditions], r.rejects, r.covered) for r in got] == want and len(want) >= 2


def test_rules_with_repeated_labels_and_clashing_columns(spark, docs):
    df = spark.createDataFrame(docs[["doc_id", "text"]]).withColumn("bad", F_lit("x")).withColumn("quality", F_lit("y"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("text", F_lit("z"))
    order = lambda d: sorted(map(tuple, d.collect()))
    assert order(quality_rules.quality_rules(df, labels.union(labels))) == order(quality_rules.quality_rules(df.select("doc_id", "text"), labels))


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest place reachable over pairs within three bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_simhash(spark, docs, group_rows):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(df, group_rows=group_rows).collect()}
    docs = docs.sort_values("doc_id")
    fps = [fingerprint(t) for t in docs.text]
    ids = list(docs.doc_id)
    want = {d: (f, ids[k]) for d, f, k in zip(ids, fps, components(fps), strict=True)}
    assert got == want


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)])
    fps = np.unique(np.concatenate([base, near]))
    q, at = simhash.GrayIndex(fps).search(fps, 3)
    want = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert sorted(zip(q, at, strict=True)) == sorted(zip(*want, strict=True))


def test_simhash_edges(spark, edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) >= 3 and {r["component_id"] for r in zero} == {0}
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == len({r["component_id"] for r in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_near_dedup_stage_against_all_pairs(spark, docs):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    cut = [words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in docs.text]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cut]
    alone = [f"w{k}" for k in range(60)]
    near = [alone, alone[:57], alone[3:], ["other", *alone[:30]]]  # 3 of 56 shingles gone; the last is under 0.8
    extra = [(10**6 + k, " ".join(w)) for k, w in enumerate(near)]
    sets += [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in near]
    ids = [*docs.doc_id, *(k for k, _ in extra)]
    label = list(range(len(ids)))
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in ids:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    want = {min(ids[k] for k in range(len(ids)) if label[k] == own) for own in set(label)}
    more = df.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = corpus_pipeline.near_dedup(spark, more, DATA)
    assert {r["doc_id"] for r in got.collect()} == want and pairs


def near_labels(texts, least=0.8):
    """Smallest place of each group of texts linked by five-word Jaccard similarity."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, texts)]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9]
    for _ in texts:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return label, pairs


def edited_copies(n, seed=2):
    """Copies of two texts with words changed, cut off or added: similarities on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    base = [[f"{b}{k}" for k in range(90)] for b in "pq"]
    texts = []
    for k in range(n):
        w = list(base[k % 2])
        for at in rng.choice(len(w), rng.integers(0, 5), replace=False):
            w[at] = f"x{rng.integers(0, 4)}" if rng.random() < 0.5 else f"y{k}.{at}"
        w = w[rng.integers(0, 6) : len(w) - rng.integers(0, 6)] + [f"z{rng.integers(0, 3)}"] * rng.integers(0, 5)
        texts.append(" ".join(w))
    return texts


def test_near_groups_of_edited_copies_against_all_pairs(spark):
    texts = edited_copies(160)
    want, pairs = near_labels(texts)
    rows = near_texts.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["label"], r["doc_id"])
    assert [first[r["label"]] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert 5 < len(set(want)) < 120 and len(pairs) > 300


def test_prefix_pairs_lose_no_link(spark):
    from pyspark.sql import functions as F

    texts = edited_copies(80, seed=5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_texts.shingle_sets(df)
    name = {r[1]: r[0] for r in df.select("doc_id", F.xxhash64("text")).collect()}
    alone = sets.select("hash", F.col("hash").alias("label")).distinct()
    got = near_texts.confirmed(near_texts.prefix_pairs(alone, sets.dropDuplicates(["hash"]), 0.8), sets.dropDuplicates(["hash"]), 0.8)
    links = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in got.collect()}
    assert links == {(j, i) for i, j in near_labels(texts)[1]} and len(links) > 100


def test_near_groups_edges(spark, edge, empty):
    rows = near_texts.near_groups(edge).collect()
    assert len(rows) == edge.count() and near_texts.near_groups(empty).count() == 0
    assert len({r["label"] for r in rows if r["doc_id"] in (0, 2)}) == 1
    kept = simhash.keep_first(edge, near_texts.near_groups(edge))
    assert kept.columns == edge.columns and kept.count() == len({r["label"] for r in rows})


def test_nearest_edges(spark):
    v = [0.5, 0.25]
    rows = [(0, v), (1, v), (2, [float("nan"), 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, []), (7, [3.0, 4.0]), (None, v), (1, v), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df, df.where("vec_id = 0"), 10, block_rows=2).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 7)]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_reads_no_other_columns(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0], 7, b"x", "y") for k in range(12)], "vec_id long, embedding array<double>, dim int, ids binary, score string")
    got = [(r["query_id"], r["vec_id"]) for r in nearest.nearest(df, df.where("vec_id = 3"), 2).collect()]
    assert sorted(got) == [(3, 2), (3, 4)]


def test_int8_products_are_exact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-127, 128, (5, 2500)).astype(np.int8) for _ in range(2))
    assert (nearest.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all() and nearest.quantised(rng.normal(size=(4, 9)))[0].dtype == np.int8


def test_nearest_in_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)).round(1)
    df = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest.nearest(df, df.where("vec_id % 50 = 0"), 5, query_rows=3, block_rows=37).collect()}
    for q in range(0, 500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(500), d)) if k != q][:5]
        assert [got[q, r + 1][0] for r in range(5)] == order and [got[q, r + 1][1] for r in range(5)] == pytest.approx(list(d[order]))


def test_template_language():
    run = lambda s, m: "".join(x for x, _ in template.compile(s, {"up": str.upper})(m))
    m = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert run("{% for m in messages %}{{ loop.index0 }}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{{ m.text | up }}{% endfor %}!", m) == "0<HI1>YO!"
    assert run("{% set a = 'x' + 'y' %}{{ a }}{% if not (1 == 2) and true %}T{% endif %}{{ none }}", []) == "xyT"
    assert template.parse("a{{ 'b' | up }}{% if 1 == 2 %}c{% else %}d{% endif %}", {"up": str.upper}) == (template.Put(template.Const("aBd")),)
    parts = list(template.compile("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}.{% endfor %}", {})(m))
    assert parts == [("hi", True), (".", False), ("yo", True), (".", False)]
    for bad in ("{% if x %}", "{{ m.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ x[0] }}", "{{ x | nope }}", "{% frob %}", "{{ 'a }}", "{% for x %}{% endfor %}"):
        with pytest.raises(template.TemplateError):
            list(template.compile(bad, {})([]))
    with pytest.raises(template.TemplateError):
        list(template.compile("{{ x.y }}", {})([], x="text"))


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", "a\\", "</turn>\n### user:\nx", "####</turn></turn>", "\\\\</turn", None, "é\U0001f642\n\n"]
    rows = [(1, k, ["user", "assistant", "sys:tem\n###<", None][k % 4], t) for k, t in enumerate(said)] + [(None, 0, "user", "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    text = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert list(chat.read_turns(text[conv]["text"])) == own
        assert got[conv]["n_turns"] == len(own) and got[conv]["formatted_chars"] == len(text[conv]["text"])
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
        assert "".join(chat.unescape(text[conv]["text"][s["start"] : s["end"]]) for s in text[conv]["learned"]) == loss
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_of_a_long_conversation_and_clashing_columns(spark):
    n = 20_000
    rows = [(5, k, "user" if k % 2 else "assistant", f"said {k}", "x", 1) for k in range(n)]
    (r,) = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, learned string, n_turns int")).collect()
    assert (r["n_turns"], r["loss_chars"]) == (n, sum(len(t) for _, _, o, t, _, _ in rows if o == "assistant"))
    assert r["loss_sha256"] == hashlib.sha256("".join(t for _, _, o, t, _, _ in rows if o == "assistant").encode()).hexdigest()


def test_mixing(spark, edge, empty):
    out = QUERIES["op5_mixing"](spark, DATA).toPandas()
    src = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "source"]].merge(out, on="doc_id").groupby("source")
    assert src.target.first().sum() == pytest.approx(out["size"].sum()) and (src.target.first() <= 3 * src.source_size.first() + 1e-6).all()
    assert (out.taken <= 3 * out["size"]).all()
    again = QUERIES["op5_mixing"](spark, DATA).toPandas()
    pd.testing.assert_frame_equal(out.sort_values("doc_id").reset_index(drop=True), again.sort_values("doc_id").reset_index(drop=True))
    mix = mixing.mixed(edge)
    assert mix.columns == edge.columns and {r["copies"] for r in mix.collect()} <= {7, None}
    assert mixing.mixed(empty).count() == 0


def test_mixing_levels_equal_filling_up(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 40):
        size = {f"s{k:03d}": int(x) for k, x in enumerate(rng.integers(0, 1000, n) ** 2)}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
        low, high = 0.0, 3.0 * max(size.values()) + 1
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(mid * weight[s], 3.0 * size[s]) for s in size) < sum(size.values()) else (low, mid)
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
        assert got == {s: pytest.approx(min(high * weight[s], 3.0 * size[s]), rel=1e-9, abs=1e-6) for s in size}


def test_mixing_levels(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100), ("d", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a 5, b 2, c 1, d 5, null 2: a, c and d stop at their caps, b and null share the rest alike until null stops
    assert got == {"a": 30.0, "c": 15.0, "d": 0.0, None: 300.0, "b": pytest.approx(1115 - 345)}


def test_language_id(spark, edge, empty, docs):
    out = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.rejected.mean() < 0.02 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]).all()
    rows = language_id.identified(edge).collect()
    for r in rows:
        if r["doc_id"] in (0, 2):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    kept = language_id.keep_identified(edge)
    assert kept.columns == edge.columns and all(r["text"] and r["text"].strip() for r in kept.collect())
    assert language_id.identified(empty).count() == 0 and language_id.keep_identified(empty).count() == 0


def test_language_id_letters_and_sample(spark):
    assert language_id.judged(["² ½ Ⅷ", "² ² ²", "_12"], language_id.Model(["en"], np.ones(1 << language_id.BITS), np.ones((1, 1 << language_id.BITS)), np.zeros(1, int), np.zeros(21)))[0] == ["und"] * 3
    rows = [(k, "abcd efgh"[k % 5 :] + chr(97 + k % 20), f"l{k % 400}") for k in range(1200)]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=2, most=40, clusters=3)
    assert len(m.langs) == 400 and len(m.lang_of) == 400  # one text a language where there are more languages than `most`
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("lang < 'l11'"), per_lang=2, most=4000, clusters=3)
    assert (np.bincount(m.lang_of) == 2).all()


def test_language_id_against_plain_code(spark, docs):
    m = language_id._fitted(spark.read.parquet(f"{DATA}/documents.parquet"))
    text = next(t for t in docs.text if t and len(t) > 300)
    tf = Counter()
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    for n, odd in ((1, 2654435761), (2, 2246822519), (3, 3266489917)):
        for i in range(len(letters) - n + 1):
            h = 0
            for c in letters[i : i + n]:
                h = h * 31 + ord(c)
            tf[(h * odd & 0xFFFFFFFF) >> 20] += 1
    assert {k: v for k, v in enumerate(language_id.counts(text)) if v} == tf
    vec = np.zeros(1 << language_id.BITS)
    for k, v in tf.items():
        vec[k] = (1 + np.log(v)) * m.idf[k]
    cos = m.centroids @ (vec / np.sqrt((vec**2).sum()))
    (lang,), (score,), _ = language_id.judged([text], m)
    assert (lang, score) == (m.langs[m.lang_of[int(cos.argmax())]], pytest.approx(cos.max(), rel=1e-5))


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 70_000 + "WARC/1.1\r\n" * 50
    pages = [(1, "http://a\r\nX: y", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "WARC/1.1", big), (6, "u", big), (7, "u", "WARC/1.1"), (None, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (8, "u", "\r\n\r\n0\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, segment_bytes=5000)
    got = warc.read_archives(spark, path).collect()
    first = {}
    for p, _, h in sorted(pages, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", p)
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["complete"]) for r in got) == Counter(
        (p, *(("response", None) if p == first[h or ""] else ("revisit", first[h or ""])), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), True) for p, _, h in pages)
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {h.encode() for h in first}
    raw = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert raw.count(b"WARC-Segment-Origin-ID") > 10
    warc.write_archives(df.limit(0), f"{path}-none")
    assert warc.read_archives(spark, f"{path}-none").count() == 0


def test_warc_reads_no_other_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", "x", 9), (2, "u", "a", "x", 9)], "page_id long, url string, html string, hash string, first long")
    warc.write_archives(df, str(tmp_path / "warc"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "warc")).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}


def test_warc_missing_segment(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 20_000)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, segment_bytes=5000)
    records = [r[0] for r in spark.read.text(path, lineSep="WARC/1.1\r\n").collect() if r[0]]
    for lost in (2, len(records) - 1):
        broken = f"{path}-{lost}"
        os.makedirs(broken)
        with open(f"{broken}/part-0.txt", "w", newline="") as f:
            f.write("".join(f"WARC/1.1\r\n{r}" for k, r in enumerate(records) if k != lost))
        (page,) = warc.read_archives(spark, broken).collect()
        assert (page["complete"], page["payload"]) == (False, None)


PASSAGE = [f"this is line number {k} of a passage that stands in many documents at once" for k in range(5)]


def test_line_dedup(spark, edge, empty):
    own = lambda k: [f"document {k} has its own line {j} with words that no other one has {k * j}" for j in range(3)]
    texts = {1: own(1) + PASSAGE, 2: own(2)[:1] + PASSAGE + own(2)[1:], 3: PASSAGE[:1] + own(3), 4: own(4) + PASSAGE + ["end"], 5: own(1) + PASSAGE}
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.deduplicated(df).collect()}
    assert got == {1: texts[1], 2: own(2), 3: texts[3], 4: own(4) + ["end"], 5: [""]}
    out = line_dedup.deduplicated(edge)
    assert out.columns == edge.columns and out.count() == edge.count() and line_dedup.deduplicated(empty).count() == 0


def test_line_dedup_keeps_one_copy_of_every_line(spark, docs):
    out = QUERIES["op8_line_dedup"](spark, DATA).toPandas()
    assert len(out) == len(docs)
    before = {x.strip() for t in docs.text for x in t.split("\n")}
    after = {x.strip() for t in out.text for x in t.split("\n")}
    assert before - after <= {""}
    gone = out[out.n_deleted > 0].merge(docs, on="doc_id")
    earlier = {}
    for r in docs.sort_values("doc_id").itertuples():
        for x in r.text.split("\n"):
            earlier.setdefault(" ".join(words(x)), r.doc_id)
    for r in gone.itertuples():
        left = Counter(" ".join(words(x)) for x in r.text_x.split("\n"))
        for x in Counter(" ".join(words(y)) for y in r.text_y.split("\n")) - left:
            assert x == "" or earlier[x] < r.doc_id


def test_line_dedup_finds_blocks_of_any_first_holder(spark):
    block = [f"line {k} of ten words in a block that two documents share" for k in range(6)]
    own = lambda k: [f"document {k} has its own line {j}" for j in range(3)]
    short = [f"{k} item" for k in range(30)]
    texts = {1: own(1) + block[:3], 2: own(2) + block[3:], 3: own(3) + block, 4: own(4) + block, 5: own(5) + short, 6: short + own(6)}
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.deduplicated(df).collect()}
    assert got == texts | {4: own(4), 6: own(6)}


def test_line_dedup_of_repeated_passages(spark):
    a, b = ([f"{name} line {k} of the ten words in the passage here" for k in range(5)] for name in "ab")
    poem = ["one line that a document repeats"] * 12
    texts = {1: a + a, 2: a + a, 3: ["own line of three"] + a, 4: b, 5: b + ["x"] + b, 6: poem, 7: poem + ["y"], 8: a + b, 9: b + a}
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.deduplicated(df).collect()}
    assert got == {1: a + a, 2: [""], 3: ["own line of three"], 4: b, 5: ["x"], 6: poem, 7: ["y"], 8: [""], 9: [""]}


def test_common_blocks_against_brute_force():
    rng = np.random.default_rng(8)
    size = rng.integers(0, 20, 6)
    for _ in range(300):
        x, y = rng.integers(0, 6, 14), rng.integers(0, 6, 14)
        want = set()
        for i in range(14):
            for j in range(14):
                n = 0
                while i + n < 14 and j + n < 14 and x[i + n] == y[j + n]:
                    n += 1
                if size[x[i : i + n]].sum() >= 40:
                    want |= {i + k for k in range(n) if size[x[i + k]]}
        got = {p for s, e in line_dedup.common_blocks(x, size[x], y, size[y], 40) for p in range(s, e)}
        assert {p for p in got if size[x[p]]} == want


def test_run_keys_cover_every_block():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lines, words_ = rng.integers(-(2**63), 2**63 - 1, 30), rng.integers(0, 20, 30).astype(np.int32)
        s, e = np.sort(rng.choice(31, 2, replace=False))
        s, e = int(s), int(e)
        while s < e and not words_[s]:
            s += 1
        while s < e and not words_[e - 1]:
            e -= 1
        a, b, key = line_dedup.run_keys(lines, words_, 40)
        inside = {p for x, y in zip(a, b, strict=True) if s <= x and y <= e for p in range(x, y)}
        assert inside == (set(range(s, e)) if words_[s:e].sum() >= 40 else set())
        shifted = line_dedup.run_keys(np.concatenate([lines[:3], lines[s:e]]), np.concatenate([words_[:3], words_[s:e]]), 40)[2]
        assert set(key[(a >= s) & (b <= e)]) <= set(shifted)


def test_line_dedup_against_all_pairs(spark, docs):
    """Every line inside a block of 40 or more words that any earlier text holds goes, and no other line."""
    rows = sorted({(r.doc_id, r.text) for r in docs.itertuples() if r.text is not None})
    cut = [[" ".join(words(x)) for x in t.split("\n")] for _, t in rows]
    names = {x: k for k, x in enumerate(sorted({x for c in cut for x in c}))}
    size = np.array([len(x.split()) for x in sorted(names)])
    coded = [np.array([names[x] for x in c]) for c in cut]
    want = {}
    for j in range(len(rows)):
        gone = set()
        for i in range(j):
            same = coded[j][:, None] == coded[i][None, :]
            for a, b in zip(*np.nonzero(same), strict=True):
                n = 0
                while a + n < len(coded[j]) and b + n < len(coded[i]) and same[a + n, b + n]:
                    n += 1
                if size[coded[j][a : a + n]].sum() >= 40:
                    gone |= {a + k for k in range(n) if cut[j][a + k]}
        want[rows[j][0]] = gone
    got = {r["doc_id"]: {k for k in r["_gone"] or () if cut_of(r["text"])[k]} for r in line_dedup.with_removals(spark.read.parquet(f"{DATA}/documents.parquet")).selectExpr("_row.doc_id", "_row.text", "_gone").collect() if r["text"] is not None}
    assert got == want and sum(map(len, want.values())) > 20


def cut_of(t):
    return [" ".join(words(x)) for x in t.split("\n")]


def test_line_dedup_of_three_blocks_held_together(spark):
    block = {x: " ".join(f"{x}{k}" for k in range(17)) for x in "ABC"}
    texts = {1: [block["A"]], 2: [block["B"]], 3: [block["C"]], 4: ["four", *block.values()], 5: [*block.values(), "five"]}
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.deduplicated(df).collect()}
    assert got == texts | {5: ["five"]}


def test_line_dedup_of_equal_ids(spark):
    texts = [PASSAGE + ["x"], PASSAGE + ["y"]]
    df = spark.createDataFrame([(1, "\n".join(t)) for t in texts], "doc_id long, text string")
    assert sorted(len(r["text"].split("\n")) for r in line_dedup.deduplicated(df).collect()) == [1, 6]


def test_patience():
    a, b = np.array([1, 2, 3, 9, 4, 5]), np.array([7, 1, 2, 3, 4, 5, 8])
    assert line_dedup.aligned(a, b) == [(0, 1, 3), (4, 4, 2)]
    assert line_dedup.aligned(np.array([1, 1]), np.array([1, 1])) == [] and line_dedup.aligned(np.array([5, 1, 1]), np.array([5, 1, 1])) == [(0, 0, 3)]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, texts):
    want = Counter()
    for k, ids in texts:
        ids = np.array([*ids, 2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want.update((k, n, s, e - s, zlib.crc32(ids[s:e].tobytes())) for n, (s, e) in enumerate(zip(cut, cut[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing(spark, edge, empty, docs):
    rows = QUERIES["op9_packing"](spark, DATA).collect()
    n = check_packing(rows, list(zip(docs.doc_id, ids_of(docs.text), strict=True)))
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 2
    own = edge.collect()
    check_packing(packing.packed(edge).collect(), [(r["doc_id"], i) for r, i in zip(own, ids_of([r["text"] for r in own]), strict=True)])
    assert packing.packed(empty).count() == 0


def test_encode_odd_texts():
    import pyarrow as pa

    odd = ["", " ", "  a  b\n\n c ", "x y z w", "it's they'll 'S 12ab34  ..", "\n", "\x1c a \x1d", "é ̀x ²³ ٣٤", " \n \n", "a\x85b c", "日本語 🙂🙂 a", "<|endoftext|> a<|endoftext|>"]
    got = packing.tokenizer_of(packing.default_tokenizer()).encode(pa.array(odd))
    assert [x.tolist() for x in got] == ids_of(odd)
    assert got[-1][0] == got[-1][-1] == 50256  # an added token's string is that token


def test_encode_random_texts():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    signs = [*"abcXYZ''sstrevml019 ....  \n\n\t\r,-_#²½ñÑß×÷é", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "̀", "日", "🙂", "ٱ", "Ⅷ", " the", "ing"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(4000)]
    bpe = packing.tokenizer_of(packing.default_tokenizer())
    assert [x.tolist() for x in bpe.encode(pa.array(texts))] == ids_of(texts)
    joined = "\n".join(texts)
    data = np.frombuffer(joined.encode(), np.uint8)
    edges = np.array([0, len(data)])
    assert (packing.cuts(data, edges, 7) == packing.cuts(data, edges)).all()


def best_fit(counts):
    """Sequences that best fit alone takes: the longest piece, then again and again the longest that fits."""
    left, total = dict(counts), 0
    while left:
        room, config = 1024, {}
        for n in sorted(left, reverse=True):
            if k := min(left[n], room // n):
                config[n] = k
                room -= k * n
        m = min(left[n] // k for n, k in config.items())
        total += m
        left = {n: r for n in left if (r := left[n] - m * config.get(n, 0))}
    return total


def used_by(made):
    used = Counter()
    for config, m in zip(made.configs, made.times, strict=True):
        assert m > 0 and 0 < sum(n * k for n, k in config.items()) <= 1024
        for n, k in config.items():
            used[n] += k * m
    return used


@pytest.mark.parametrize(
    ("counts", "optimum"),
    [({400: 1000, 350: 1000, 300: 1000}, 1125), ({700: 10, 1: 5, 1024: 3}, 13), ({600: 50, 424: 50}, 50), ({520: 7, 500: 9, 4: 3}, 8), ({1: 5000}, 5), ({1024: 4}, 4), ({}, 0)],
)
def test_plan_reaches_the_optimum(counts, optimum):
    made = configurations.plan(counts)
    assert used_by(made) == Counter(counts) and sum(made.times) == optimum
    print(f"{optimum} sequences, dual bound {made.bound}")
    assert 0.98 * optimum - 1 <= made.bound <= optimum


def test_plan_of_small_tables_against_every_packing():
    """The least number of sequences by trying all sets of pieces."""
    rng = np.random.default_rng(8)
    for _ in range(6):
        pieces = [int(x) for x in rng.choice([100, 200, 341, 400, 512, 513, 624, 700], 9)]
        fits = [m for m in range(1, 512) if sum(p for k, p in enumerate(pieces) if m >> k & 1) <= 1024]
        least = {0: 0}
        for _ in pieces:
            for done, n in list(least.items()):
                for m in fits:
                    if not done & m and least.get(done | m, 99) > n + 1:
                        least[done | m] = n + 1
        made = configurations.plan(dict(Counter(pieces)))
        assert made.bound <= least[511] <= sum(made.times) <= least[511] + 1 and used_by(made) == Counter(pieces)


def test_bounded_knapsack_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths, left, price = np.sort(rng.choice(np.arange(5, 40), 4, replace=False)), rng.integers(1, 4, 4), rng.random(4)
        found = configurations.bounded(price, lengths, left, 60)
        every = np.array(np.meshgrid(*[np.arange(n + 1) for n in left])).reshape(4, -1).T
        own = np.array([found.get(k, 0) for k in range(4)])
        assert own @ lengths <= 60 and (own <= left).all()
        assert own @ price == pytest.approx((every[every @ lengths <= 60] @ price).max())


def test_program_covers_and_is_near_its_bound():
    counts = Counter(int(x) for x in 1 + np.random.default_rng(9).exponential(250, 10_000) % 1023)
    amounts, price, bound = configurations.fractional(counts, 1024)
    covered = Counter()
    for key, x in amounts.items():
        assert sum(n * a for n, a in key) <= 1024
        for n, a in key:
            covered[n] += a * x
    assert all(covered[n] <= counts[n] * (1 + 1e-6) for n in counts)
    share = sum(covered.values()) / sum(counts.values())
    made = configurations.plan(counts)
    print(f"program covers {share:.3f} of the pieces, {sum(made.times)} sequences, dual bound {bound:.1f}")
    assert share > 0.3
    assert bound - 1e-6 <= sum(made.times) <= 1.002 * bound + 1
    table = configurations.Knapsack(price, np.array(sorted(counts)), 1024)
    assert table.best[-1] <= 1 + 1e-9  # prices are feasible duals


def test_plan_is_tight():
    rng = np.random.default_rng(4)
    counts = Counter(int(x) for x in rng.integers(1, 1025, 5000))
    made = configurations.plan(dict(counts))
    assert used_by(made) == counts
    assert sum(made.times) <= 1.03 * sum(n * k for n, k in counts.items()) / 1024 + 1


@pytest.mark.parametrize("skewed", [True, False])
def test_plan_covers_every_length_at_scale(skewed):
    rng = np.random.default_rng(9)
    counts = Counter(int(x) for x in (1 + rng.exponential(250, 10_000) % 1023 if skewed else rng.integers(1, 1024, 10_000)))
    counts = {n: 300 * k for n, k in counts.items()}
    made = configurations.plan(counts)
    assert used_by(made) == counts
    assert sum(made.times) <= (1.0 if skewed else 1.005) * best_fit(counts)  # README gives the figure for evenly spread lengths
    if skewed:  # as documents are
        assert sum(made.times) <= 1.0005 * sum(n * k for n, k in counts.items()) / 1024 + 1 and made.by_program > 0.3 * sum(counts.values())


def test_quality_trees(spark, edge, empty):
    out = QUERIES["op10_quality_trees"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all()
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_trees.scored(edge, none, F.lit(True)).collect()} == {0.5}
    assert quality_trees.scored(empty, none, F.lit(True)).count() == 0


def test_trees_with_repeated_labels_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs[["doc_id", "text"]])
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    learn = F.lit(True)
    plain = quality_trees.scored(df, labels, learn)
    again = quality_trees.scored(df.withColumn("score", F.lit("x")).withColumn("y", F.lit(1)), labels.union(labels).withColumn("text", F.lit("z")), learn)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, again.collect()))


def test_forest_equals_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    f = quality_trees.grow(x, y, trees=30, depth=3)
    assert ((f.predict(x) > 0.5) == y).mean() > 0.97
    for row, got in zip(x[:20], f.margin(x[:20]), strict=True):
        total = f.prior
        for t in range(len(f.feature)):
            node = 0
            for _ in range(f.depth):
                node = 2 * node + 1 + (row[f.feature[t, node]] > f.threshold[t, node])
            total += f.leaf[t, node - (2**f.depth - 1)]
        assert got == pytest.approx(total)


def test_pipeline(spark, edge, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language-id", "line-dedup", "near-dedup", "mixing", "packing"]
    for start in (empty, edge, spark.read.parquet(f"{DATA}/documents.parquet")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DATA)
            if name != "packing":
                assert now.columns == start.columns
            now = spark.createDataFrame(now.collect(), now.schema)
    rows = now.collect()
    assert rows and sum(r["length"] for r in rows) > 1000


def test_near_pairs_of_the_gray_index(spark):
    """What the index of five-word fingerprints links at three bits is proposed; equal fingerprints are."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{k}" for k in range(400)), "  ".join(base)]
    rows = near_texts.with_keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "hash", "fp")
    name = {r["hash"]: r["doc_id"] for r in rows.collect()}
    pairs = [{name[p["a"]], name[p["b"]]} for p in near_texts.index_pairs(rows.select("hash", "fp")).collect()]
    assert {0, 3} in pairs and set.union(*pairs) == {0, 1, 3} and len(pairs) == 2
