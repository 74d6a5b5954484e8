"""The corpus pipeline against a brute-force version, stage by stage, and cases that every operator must stand."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import bpe, fingerprints, html_extract, license_scan, mixing, simhash, substring_dedup, toxicity, url_filter
from test_text_ops import components, removed, simhash_reference

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(11)
    vocab = [a + b for a in "bcdfgklmnprst" for b in "aeiou"] + ["x", "y"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(vocab) for _ in range(rng.choice([30, 80, 160]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "vermin", "cretin"])
        text = " ".join(w)
        if i % 7 == 3:
            text += " " + passage + " tail " + w[0]
        if i % 9 == 4 and i > 20:
            text = rows[i - 1][1]  # an exact copy
        rows.append((i, text, rng.choice(["en", "de", "fr"]), f"src{rng.randrange(5)}", len(text)))
        labels.append((i, int(any(b in text for b in ("scoundrel", "vermin", "cretin")))))
    odd = [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, "a text of nobody at all", "en", "src2", 23), (None, "another of nobody, unlike it", "de", "src2", 28), (902, "one of two", "en", "src0", 10), (902, "quite different words here", "en", "src0", 26)]
    return rows + odd, labels + [(None, 1), (2000, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = fixture()
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row[:2])


def without_toxic(spark, rows, labels):
    """The model's loop over the labelled rows in their order, twice, and its verdict on every row."""
    order = {r.d: r.h for r in spark.createDataFrame([(i,) for i, _ in labels if i is not None], "d long").selectExpr("d", "xxhash64(d) as h").collect()}
    label = {i: y for i, y in labels if i is not None}
    train = sorted(((order[r[0]], r[0], r[1]) for r in rows if r[0] in label and r[1] is not None))
    model = toxicity.Ftrl(1 << toxicity.BITS)
    for _ in range(toxicity.EPOCHS):
        for _, i, text in train:
            model.learn(toxicity.features(text), float(label[i]))
    w = model.weights().astype(np.float32)
    return [r for r in rows if w[toxicity.features(r[1])].sum(dtype=np.float64) < 0]


def without_copies(spark, rows):
    u = {t: h for t, h in spark.createDataFrame([(t,) for t in {r[1] for r in rows}], "t string").selectExpr("t", "coalesce(xxhash64(t), 0L) as h").collect()}
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, u[r[1]]))
    least = components([(k, simhash_reference(r[1])) for k, r in enumerate(ranked)])
    return [r for k, r in enumerate(ranked) if least[k] == k]


def without_repeats(rows):
    out = []
    u = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen = set()
    for d, text, *rest in u:
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        new = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text
        out.append((d, new, *rest[:-1], None if new is None else len(new)))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: str(r))


def test_stages_equal_brute_force(spark, folder, tmp_path):
    rows, labels = fixture()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "tokenize"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [("toxicity", lambda x: without_toxic(spark, x, labels)), ("near_dedup", lambda x: without_copies(spark, x)), ("substring_dedup", without_repeats)]
    want = rows
    for name, brute in steps:
        want = brute(want)
        docs = stages[name](spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert rows_of(docs) == sorted(want, key=str), name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r[0] for r in want}
    assert {900, 901, 902, None} & kept and sum(r[0] is None for r in want) == 2 and sum(r[0] == 902 for r in want) == 2
    assert not {i for i, y in labels if y and i is not None and i in kept}
    mixed = stages["mixing"](spark, docs, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/substring_dedup/*.parquet'")
    ids = sorted(str(r[0]) for r in con.execute(mixing.MIXTURE_SQL).fetchall())
    assert sorted(str(r.doc_id) for r in mixed.collect()) == ids and mixed.columns == docs.columns
    mixed.write.parquet(f"{tmp_path}/mixing")
    mixed = spark.read.parquet(f"{tmp_path}/mixing")
    enc = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    out = stages["tokenize"](spark, mixed, folder)
    for r in out.collect():
        assert r.token_ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == out.columns and rows_of(whole.select("doc_id", "text", "n_tokens")) == rows_of(out.select("doc_id", "text", "n_tokens"))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def bottom_k(text, k=128):
    h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    if not h:
        return []
    if len(h) < 5:
        one = 42
        for v in h:
            one = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), one)
        return [one >> 16]
    return sorted({chained(h[i : i + 5]) >> 16 for i in range(len(h) - 4)})[:k]


def test_sketches_are_the_least_hashes(spark):
    rng = random.Random(4)
    texts = [None, "", "a b", "a b c d", "a a a a a a a", *(" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)) for n in (5, 40, 700, 5000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", fingerprints.sketch(F.col("t")).alias("s")).collect():
        assert r.s == bottom_k(texts[r.i])


LONG = " ".join(f"w{i % 9973}" for i in range(substring_dedup.CHUNK + 5000))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, an empty and a very long text, repeated rows, clashing names."""
    rows = [(1, LONG, "en", "src1", len(LONG)), (1, LONG, "en", "src1", len(LONG)), (2, None, None, None, None), (None, "", "de", "src2", 0), (None, "short text", None, "x", 10), (3, "short text", "de", None, 10)]
    names = ("score", "predicted", "k", "h", "d", "u", "spans", "fp", "line", "rid", "epoch", "row", "token_ids", "sketch", "held_out")
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", *(f"'{n}' as {n}" for n in names))


def test_operators_stand_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    words = len(LONG.split())
    got = {r.doc_id: r for r in substring_dedup.removal_digests(hard).where("doc_id = 1").collect()}
    assert got[1].n_words == words and got[1].n_removed == removed([(1, LONG)], 20)[1][1]
    tokens = [r for r in bpe.token_digests(hard).collect() if r.doc_id == 1]
    enc = bpe.encoding(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)
    ids = enc.encode_ordinary(LONG)
    assert len(tokens) == 2 and all(r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for r in tokens)
    prints = {r.doc_id: r for r in simhash.near_components(hard).collect()}
    assert prints[1].fingerprint == f"{simhash_reference(LONG):016x}" and prints[2].fingerprint == "0" * 16 and prints[2].component_id == 2
    assert simhash.keep_one(hard).columns == hard.columns and simhash.keep_one(hard).count() == 3
    assert fingerprints.edited_fingerprints(hard).where("doc_id = 1").first().n_chars == len(LONG)
    assert license_scan.scan(hard).count() == hard.count() and license_scan.scan(hard.limit(0)).count() == 0
    scored = toxicity.score_documents(hard, labels)
    assert scored.count() == hard.count() and scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.drop_toxic(hard, labels).columns == [c for c in hard.columns if c not in ("score", "predicted")]
    assert mixing.mixture(hard).count() >= 1 and mixing.mixed_documents(hard).columns == hard.columns
    assert substring_dedup.remove_repeats(hard).columns == hard.columns and substring_dedup.remove_repeats(hard).count() == hard.count()


def test_urls_repeat_and_rules_tie(spark):
    rows = [(1, "http://a.example.net/de/8"), (1, "http://a.example.net/de/8"), (None, "http://b.com/en/"), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as score")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(df).where("rule is not null").collect()), key=str)
    assert got == [(1, "example.net/de/8", "block"), (1, "example.net/de/8", "block"), (None, "com/en/", "block")]
    assert url_filter.rule_for("a.net", "/x", (("allow", "net", "/x"), ("block", "a.net", "/"), ("allow", ".net", "/"))) == ("block", "a.net/")
    assert html_extract.main_text("<p>" + "word " * 200_000 + "end.</p>").count("word") == 200_000


@pytest.mark.parametrize("text, want", [("Licensed under WTFPL.", ("", 1)), ("SPDX-License-Identifier: MIT", ("MIT", 0)), ("This library is licensed under the LGPL.", ("LGPL", 0)), ("You need a driving license.", ("", 0)), ("Licensed under the Frobnicate License 3.", ("", 1))])
def test_known_and_unknown_licences(licences, text, want):
    assert licences[text] == want


@pytest.fixture(scope="module")
def licences(spark):
    texts = ["Licensed under WTFPL.", "SPDX-License-Identifier: MIT", "This library is licensed under the LGPL.", "You need a driving license.", "Licensed under the Frobnicate License 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: (r.licences, r.n_unknown) for r in license_scan.scan(df).collect()}
