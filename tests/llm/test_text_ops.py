"""Text operators against brute force on small fixtures, edge cases included."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from quantloom.llm import bpe, fingerprints, license_scan, mixing, simhash, substring_dedup, toxicity

EDGES = [(9001, None), (9002, ""), (9003, "  \t\n"), (9004, "one"), (9005, "x " * 3000), (None, "a text without an id")]


def corpus(n=80, seed=3):
    rng = random.Random(seed)
    pool = [[rng.choice("abcde") for _ in range(60)] for _ in range(4)]
    rows = []
    for d in range(n):
        w, size = [], rng.choice([5, 40, 150])
        while len(w) < size:
            kind = rng.random()
            if kind < 0.3:
                p, a = rng.choice(pool), rng.randrange(40)
                w += p[a : a + rng.randrange(1, 40)]
            elif kind < 0.4:
                w += [rng.choice("ab")] * rng.randrange(1, 45)
            else:
                w += [rng.choice("abcdefghijklm") + rng.choice("abcdefg") for _ in range(rng.randrange(10))]
        rows.append((d, " ".join(w)))
    return rows + [(500, rows[3][1]), (501, rows[3][1].upper())]


@pytest.fixture(scope="module")
def rows():
    return corpus() + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{k % 7}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def removed(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 50])
def test_substring_dedup_is_exact(docs, rows, window):
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.removal_digests(docs, window).collect()}
    assert got == removed(rows, window)


def test_remove_repeats_keeps_columns_and_clean_texts(spark, docs, rows):
    clash = docs.selectExpr("*", "1 as d", "2 as u", "3 as spans", "4 as k")
    out = substring_dedup.remove_repeats(clash)
    assert out.columns == clash.columns
    want = removed(rows, 20)
    for r in out.collect():
        if not want[r.doc_id][1]:
            assert r.text == dict(rows)[r.doc_id]
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_tells_repeated_ids_apart(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (1, "other " + t), (2, t), (2, t)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in substring_dedup.removal_digests(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 2] and sum(g[2] == 0 for g in got) == 1 and all(g[2] == 30 for g in got if g[0] == 2)


def test_every_window_hangs_on_one_pair_of_its_own_words():
    for window in (20, 30, 50, 100):
        rng = np.random.default_rng(window)
        for ids in (rng.integers(0, 3, 3000), rng.integers(0, 1000, 3000), np.repeat(rng.integers(0, 5, 300), 10), np.zeros(3000, int)):
            words = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            x = substring_dedup.parse(words, np.zeros(3000, np.int64), window)
            assert (x["t"] - x["s"] + 1).sum() == 3000 - window + 1 and (x["t"] - x["s"]).max() < substring_dedup.SEGMENT
            assert (x["p"] >= x["t"]).all() and (x["p"] < x["s"] + window).all()
            # the same words between others: the same names, and pairs at the same places
            own = dict(zip(x["starts"].tolist(), x["names"].tolist()))
            other = np.concatenate([rng.integers(0, 9, 7).astype(np.uint64), words[500:900], rng.integers(0, 9, 5).astype(np.uint64)])
            y = substring_dedup.parse(other, np.zeros(len(other), np.int64), window)
            pairs = lambda z: {(w, k): p - w for k, p, s, t in zip(z["k"].tolist(), z["p"], z["s"], z["t"]) for w in range(s, t + 1)}
            here, there = pairs(x), pairs(y)
            for w, name in zip(y["starts"], y["names"].tolist()):
                if 7 <= w <= 407 - window:
                    assert own[w + 493] == name
                    k = [k for v, k in there if v == w]
                    assert here[w + 493, k[0]] == there[w, k[0]]


def test_names_of_windows_are_their_words():
    rng = np.random.default_rng(8)
    for high in (2, 3, 50):
        words = rng.integers(1, high + 1, 6000).astype(np.uint64)
        x = substring_dedup.parse(words, np.repeat(np.arange(3), 2000), 20)
        seen = {}
        for w, name in zip(x["starts"], x["names"].tolist()):
            seen.setdefault(name, set()).add(words[w : w + 20].tobytes())
        assert all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({v for c in seen.values() for v in c})


def simhash_reference(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(codes, distance=4):
    """{id: smallest id reachable}, by comparing all pairs."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i][1] ^ codes[j][1]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (k, _) in enumerate(codes):
        least.setdefault(find(i), []).append(k)
    return {k: min((x for x in least[find(i)] if x is not None), default=None) for i, (k, _) in enumerate(codes)}


def test_simhash_components(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()}
    codes = [(i, simhash_reference(t)) for i, t in rows]
    assert {k: v[0] for k, v in got.items()} == {i: f"{c:016x}" for i, c in codes}
    assert {k: v[1] for k, v in got.items()} == components(codes)
    assert got[3][1] == got[500][1] == got[501][1]


@pytest.mark.parametrize("node_rows", [20_000, 40])
def test_near_links_lose_nothing_when_nodes_are_split(spark, node_rows):
    from quantloom.llm.graph import connected_components

    rng = random.Random(5)
    codes = set()
    for base in (rng.getrandbits(64) for _ in range(12)):
        for _ in range(60):
            c = base
            for _ in range(rng.randrange(9)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    tree = {r.u: r.v for r in connected_components(simhash.near_links(df, 4, node_rows)).collect()}
    want = components([(signed(c), c) for c in codes])
    assert {signed(c): tree.get(signed(c), signed(c)) for c in codes} == want


def test_keep_one_of_each_group(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = components([(i, simhash_reference(t)) for i, t in rows])
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.union(docs)).count() == kept.count()


def test_keep_one_keeps_unlinked_rows_whatever_their_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[0]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as u", "3 as gone")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert simhash.keep_one(df).columns == df.columns
    first = min([(None, None), (None, "")], key=lambda r: simhash_order(spark, r[1]))
    assert got == sorted([(None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[0]), first], key=str)


def simhash_order(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("coalesce(xxhash64(t), 0L) as h").first().h if text is not None else spark.sql("select coalesce(xxhash64(cast(null as string)), 0L) as h").first().h


def test_gray_rank_orders_neighbours():
    codes = np.array([i ^ (i >> 1) for i in range(256)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(256)).all()


def test_bpe_matches_the_library_and_round_trips(docs, rows):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.token_digests(docs).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(docs.selectExpr("*", "1 as n_tokens")).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) == full[i].n_tokens and full[i].token_ids == ids and bytes(full[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "it's  \n x" * 700, "é1—日本 語" * 700, "<|endoftext|> word " * 400, "ab   cd" * 500])
def test_pieces_are_safe(text):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    cut = list(bpe.pieces(text, 97))
    assert "".join(cut) == text and [t for p in cut for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_texts_and_edits(docs, rows):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, edited)) < 0.2 and abs(r.near_next - jaccard(t, nxt)) < 0.2
        if len(shingles(t)) < 64 and len(shingles(edited)) < 64:
            assert abs(r.near_edited - jaccard(t, edited)) < 1e-9
        assert abs(r.distinct_shingles / max(len(shingles(t)), 1) - 1) < 0.3 or not shingles(t)
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


def test_merged_sketches_are_those_of_the_whole(spark):
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(900)]
    parts = [(1, " ".join(w[a : a + 304])) for a in (0, 300, 600)] + [(2, "a b"), (3, None)]
    df = spark.createDataFrame(parts, "key long, text string").select("key", fingerprints.sketch(F.col("text")).alias("sketch"))
    got = {r.key: r.sketch for r in fingerprints.merge(df, ["key"]).collect()}
    whole = spark.createDataFrame([(1, " ".join(w))], "key long, text string").select(fingerprints.sketch(F.col("text"))).first()[0]
    assert got[1] == whole and len(got[1]) == 128 and len(got[2]) == 1 and got[3] == []


def test_toxicity_finds_planted_words_and_holds_out(spark):
    import zlib

    rng = random.Random(2)
    bad = ["scoundrel", "vermin", "cretin"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz") for _ in range(30)]
        y = int(i % 4 == 0)
        if y:
            w[rng.randrange(30)] = rng.choice(bad).upper() + "!"
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "text")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, lab).collect()}
    assert len(got) == 403 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score < 0.5
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {i for i, y in labels if not y} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score_documents(docs, lab.limit(0)).count() == 403


def test_mixture_matches_sql(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in mixing.mixture(docs).collect())))
    assert got == sorted(map(str, con.execute(mixing.MIXTURE_SQL).fetchall()))
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.selectExpr("*", "1 as epoch", "2 as row", "3 as domain")).columns[-3:] == ["epoch", "row", "domain"]


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.budget for r in mixing.budgets(leaves, ["top", "leaf"], {}, 50, 1).collect()}
    # 1,005 tokens: half to each top; a's x holds 10, and y takes what x can't
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "z"): 502}


def test_license_scan(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "You need a driving license.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (4, "Some words.\nLicensed under the Apache License, Version 2.0.\r\nThis work is licensed under the GNU General Public License, version 3."), (5, "The license of nobody. " * 200), (5, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.licences) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (None, "MIT"), (3, "MIT"), (4, "Apache,GPL"), (5, ""), (5, "")], key=str)


def test_substring_tasks_hold_few_texts(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, tag: seen.append((tag, int(spark.conf.get(key)))) or write(df, tag))
    before = spark.conf.get(key)
    df = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40))) for k in range(3)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.removal_digests(df).collect()) == [0, 40, 40]
    assert all(n <= 1000 for tag, n in seen if tag in ("shared-names", "shared-boundaries")) and len(seen) > 2 and spark.conf.get(key) == before
    texts = pa.RecordBatch.from_arrays([pa.array(["a b c d"] * 50_000)], names=["text"])
    assert max(len(ids) for ids, *_ in substring_dedup._chunks(iter([texts]), 0, [])) <= 1 << 16
