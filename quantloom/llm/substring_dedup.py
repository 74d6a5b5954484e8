"""Substring dedup by recompression: exact removal of windows of words that start earlier elsewhere.

Every text is rewritten by rounds that name things alike wherever they stand: runs first (a word and its repetition
become one symbol), then pairs, round after round (two neighbours become one symbol if a coin, drawn from the symbols'
names, puts the first on the left side and the second on the right). A name is a 64-bit hash of the names that it
stands for, so that names are global without a dictionary being exchanged; whether two neighbours join depends on
their own names. So the symbols inside equal substrings are equal, but for some at the ends, which each round pops.

A window of words is its popped sequence: what each round pops at either end, and the symbols left in its middle at
the highest level that it reaches. Its name is made of the names in that sequence, so equal windows have equal names.
Each window hangs on one pair of neighbouring symbols of its middle, the longest, which the window's words decide, too.

Spark compares the names, round by round:

1. names of the pairs that windows hang on are counted over the corpus; those that occur once end there;
2. if all occurrences of a pair carry equal segments (the names of all the windows that hang on them, in order), the
   first keeps its windows and the others lose theirs;
3. else one representative of each distinct segment is compared name by name with the others of its pair.

Counts, first places and names cover the whole corpus. A filter, sized by the names that are shared, keeps lone ones
from being shuffled a second time; past its bound it passes everything, and the join does the same work.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import bloom_array, bloom_hits, frugal, materialize, mix64, rows_per_batch, split_by_keys

WINDOW = 20
#: Windows that one row holds at most (they are bits of a long).
SEGMENT = 60
#: Words parsed at once, and texts that reach Python at once: both bound what a task holds outside the heap.
CHUNK, TEXTS = 1 << 16, 1000
_BASE = 0x9E3779B97F4A7C55
_BASE_INV = pow(_BASE, -1, 1 << 64)


def pair_rounds(window: int) -> int:
    """Rounds of pairs after that of runs: each makes symbols a third longer, until some eleven fill a window."""
    return max(1, int(math.log(max(window / 11, 1)) / math.log(4 / 3)))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
    return grow(_BASE), grow(_BASE_INV)


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rewrite(ids: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places where symbols start, their names) of the words, the runs and each round of pairs. first: true where a
    document starts; no symbol crosses it."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | first[1:]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n)).astype(np.uint64)
    name = np.where(run > 1, mix64(ids[at] + run), ids[at])
    out = [(np.arange(n), ids), (at, name)]
    for r in range(rounds):
        coin = (mix64(name ^ np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        join = np.zeros(len(at), bool)
        join[1:] = coin[:-1] & ~coin[1:] & ~first[at[1:]]
        left = np.append(join[1:], False)
        name = name.copy()
        name[left] = _pair(name[left], name[1:][join[1:]])
        at, name = at[~join], name[~join]
        out.append((at, name))
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(_BASE) + b)


class _Level:
    """One round's symbols, with sums over their names and, for ranges of them, the pair to hang on."""

    def __init__(self, at: np.ndarray, name: np.ndarray, n: int, level: int):
        self.at, self.name, size = at, name, len(at)
        starts = np.zeros(n, np.int32)
        starts[at] = 1
        self.upto = np.cumsum(starts, dtype=np.int32)  # symbols that start at or before each word
        pw, self.inv = _powers(1 << size.bit_length())
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * pw[:size])])
        self.alone = mix64(name + np.uint64(2 * level))
        self.two = np.append(mix64(_pair(name[:-1], name[1:]) + np.uint64(2 * level + 1)), self.alone[-1:])
        end = np.append(at[2:], [n, n])[:size]
        # longest first, then the least name: the order of one unsigned number
        rank = (np.uint64(0xFFFF) - np.minimum(end - at, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (self.two >> np.uint64(16))
        self.rank, self.best = rank, [np.arange(size, dtype=np.int32)]

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One name for the symbols a to b - 1."""
        return (self.total[b] - self.total[a]) * self.inv[a]

    def hang(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first symbol of the pair that the symbols a to b - 1 hang on; of a single symbol, itself."""
        last = np.maximum(b - 1, a + 1)  # first symbols of pairs: a to last - 1
        power = np.frexp((last - a).astype(np.float64))[1] - 1
        for k in range(len(self.best), int(power.max(initial=0)) + 1):
            x = self.best[-1]
            y = np.append(x[1 << k - 1 :], np.full(min(1 << k - 1, len(x)), len(x) - 1, np.int32))
            self.best.append(np.where(self.rank[x] <= self.rank[y], x, y))
        out = np.empty(len(a), np.int64)
        for k in range(len(self.best)):
            i = np.flatnonzero(power == k) if power.min(initial=k) != k or power.max(initial=k) != k else slice(None)
            x, y = self.best[k][a[i]], self.best[k][last[i] - (1 << k)]
            out[i] = np.where(self.rank[x] <= self.rank[y], x, y)
        return out


def parse(ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The segments of concatenated documents (doc: their numbers, ascending): runs of windows that hang on one pair.

    k: the pair's name, h: that of the segment, p: the pair's place, s and t: first and last window, names: those of
    all windows, starts: the windows' places, i and j: the segments' first and last window among those."""
    n = len(ids)
    none, names0 = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else none
    if not len(start):
        return {"k": names0, "h": names0, "p": none, "s": none, "t": none, "i": none, "j": none, "names": names0, "starts": none}
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    levels = [_Level(at, name, n, k) for k, (at, name) in enumerate(rewrite(ids, first, pair_rounds(window)))]
    size = len(start)
    name, key, place = np.zeros(size, np.uint64), np.empty(size, np.uint64), np.empty(size, np.int64)
    on = np.arange(size)
    lo, hi = start, start + window  # what is known at a level: from word lo to word hi - 1
    a, b = lo, hi  # the same as symbols of the level
    for k, here in enumerate(levels):
        up = levels[k + 1] if k + 1 < len(levels) else None
        if up is not None:
            c, e = up.upto[lo].astype(np.int64), up.upto[hi - 1].astype(np.int64) - 1  # first and last start inside
            stay = c >= e
        stop = np.flatnonzero(stay) if up is not None else np.arange(len(on))
        if len(stop):
            x, y, w = a[stop], b[stop], on[stop]
            name[w] = mix64(name[w] + here.names(x, y) + np.uint64(k))
            q = here.hang(x, y)
            key[w], place[w] = np.where(y - x > 1, here.two[q], here.alone[q]), here.at[q]
        if up is None:
            break
        if len(stop):
            go = np.flatnonzero(~stay)
            on, lo, hi, a, b, c, e = on[go], lo[go], hi[go], a[go], b[go], c[go], e[go]
        if not len(on):
            break
        lo, hi = up.at[c], up.at[e]
        # what this round pops at either end, in this level's symbols
        left, right = here.upto[lo].astype(np.int64) - 1, here.upto[hi].astype(np.int64) - 1
        name[on] = _pair(mix64(name[on] + here.names(a, left)), here.names(right, b) + (right - left > 0))
        a, b = c, e
    head = np.ones(size, bool)
    head[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    i = np.flatnonzero(head)
    length = np.diff(np.append(i, size))
    if length.max() > SEGMENT:
        i = np.concatenate([np.arange(x, x + m, SEGMENT) for x, m in zip(i, length, strict=True)])
    j = np.append(i[1:], size) - 1
    pw, inv = _powers(1 << size.bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * pw[:size])])
    shape = ((place[i] - start[i]) * 64 + (j - i)).astype(np.uint64)
    h = mix64(mix64((total[j + 1] - total[i]) * inv[i]) + shape)
    return {"k": key[i], "h": h, "p": place[i], "s": start[i], "t": start[j], "i": i, "j": j, "names": name, "starts": start}


def _chunks(batches: Iterator[pa.RecordBatch], text: int, others: list[int]):
    """Words of whole documents, about CHUNK at a time: (their ids, each word's document, documents' first words, values)."""
    ids, docs, values, n = [], [], [], 0

    def out():
        sizes = np.array([len(x) for x in ids])
        return np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes, values

    for b in batches:
        for t, *rest in zip(b.column(text), *(b.column(k) for k in others), strict=True):
            words = t.as_py().encode().split() if t.is_valid else []
            if len(words) < 2:
                continue
            ids.append(word_ids(words))
            values.append(tuple(x.as_py() for x in rest))
            n += len(words)
            if n >= CHUNK:
                yield out()
                ids, docs, values, n = [], [], [], 0
    if ids:
        yield out()


def _anchors(keyed: DataFrame, window: int, bits=None) -> DataFrame:
    """k, h, d, u, p, s, n: segments (n windows from the s-th word on). With bits (a broadcast filter of names): those
    that may be in it only, and wh, their windows' names."""
    more = bits is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, begin, values in _chunks(batches, 2, [0, 1]):
            x = parse(ids, doc, window)
            keep = bloom_hits(bits.value, x["k"]) if more else slice(None)
            k, h, p, s, t, i = (x[c][keep] for c in "khpsti")
            of = doc[s] if len(s) else s
            d, u = (np.array([v[c] for v in values], np.int64)[of] for c in (0, 1))
            cols = {"k": k.view(np.int64), "h": h.view(np.int64), "d": d, "u": u, "p": (p - begin[of]).astype(np.int32), "s": (s - begin[of]).astype(np.int32), "n": (t - s + 1).astype(np.int32)}
            arrays = [pa.array(c) for c in cols.values()]
            if more:
                size = t - s + 1
                ends = np.cumsum(size)
                each = np.repeat(i - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                hashes = x["names"][each].view(np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(hashes)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *["wh"] * more])

    return keyed.select("d", "u", "text").mapInArrow(frugal(run), "k long, h long, d long, u long, p int, s int, n int" + ", wh array<long>" * more)


def _spans(keyed: DataFrame, window: int) -> DataFrame:
    """d, u, spans array<struct<s, n, keep>>: windows to remove, by document; bit i of keep spares the i-th of n."""
    place = F.struct("d", "u", "p")
    names = (
        _anchors(keyed, window).groupBy("k")
        .agg(F.count("*").alias("c"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min(place).alias("f"))
        .where("c > 1").drop("c")
    )
    with rows_per_batch(keyed.sparkSession, TEXTS):
        names = materialize(names, "shared-names")
        bits = keyed.sparkSession.sparkContext.broadcast(bloom_array(names, "k"))
        found = materialize(_anchors(keyed, window, bits).join(names, "k"), "shared-boundaries")
    alike = found.where("h0 = h1").where(place != F.col("f")).select("d", "u", "s", "n", F.lit(0).cast("long").alias("keep"))
    mixed = found.where("h0 < h1").select("k", "h", "d", "u", "p", "s", "n", "wh")
    reps = mixed.groupBy("k", "h").agg(F.min(place).alias("f"), F.first(F.expr("p - s")).alias("o"), F.first("wh").alias("wh"))
    reps = materialize(reps, "segments")
    each = reps.select("k", "h", "f", "o", F.posexplode("wh").alias("i", "w")).withColumn("o", F.expr("o - i"))
    firsts = each.groupBy("k", "o", "w").agg(F.min("f").alias("wf"))
    spared = (
        each.join(firsts, ["k", "o", "w"]).groupBy("k", "h")
        .agg(F.min("f").alias("f"), F.sum(F.expr("case when f = wf then shiftleft(1L, i) else 0L end")).alias("spare"))
    )
    spared = materialize(spared, "spared-windows")  # a table on this side lets a hot segment's rows be split
    other = mixed.join(spared, ["k", "h"]).select("d", "u", "s", "n", F.when(place == F.col("f"), F.col("spare")).otherwise(F.lit(0).cast("long")).alias("keep"))
    other = other.where("keep <> shiftleft(1L, n) - 1")
    return alike.union(other).groupBy("d", "u").agg(F.collect_list(F.struct("s", "n", "keep")).alias("spans"))


def _kept(words: list[bytes], spans: list | None, window: int) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int32)
    for x in spans:
        s, n, keep = x["s"], x["n"], x["keep"]
        for i in range(n):
            if not keep >> i & 1:
                edge[s + i] += 1
                edge[s + i + window] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not gone]


def _keyed(docs: DataFrame, cols: list[str]) -> DataFrame:
    """d: doc_id, nulls first; u: 0, or where doc_ids repeat a hash of the text, to tell rows apart; text; cols as c0, c1, ..."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    u = F.lit(0).cast("long") if n == ids else F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(d.alias("d"), u.alias("u"), F.col("text").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))


def _apply(docs: DataFrame, window: int, fn, cols: list[str], schema) -> DataFrame:
    """fn over Arrow batches of c0, c1, ... (cols) and spans (null: none), for every row of docs."""
    keyed = _keyed(docs, cols)
    spans = materialize(_spans(keyed, window), "spans")
    maybe, never = split_by_keys(keyed.drop("text"), spans, ["d", "u"])
    own = [f"c{i}" for i in range(len(cols))]
    joined = maybe.join(spans, ["d", "u"], "left").select(*own, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield fn(whole.slice(at, 256))

    return joined.unionByName(never.select(*own, F.lit(None).cast("array<struct<s:int,n:int,keep:bigint>>").alias("spans"))).mapInArrow(frugal(run), schema)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    Null and empty texts have no words; texts shorter than a window lose none. Rows that repeat a doc_id are told
    apart by their texts; of rows alike in both, all count as the first. A null doc_id comes before all others."""

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            words = text.as_py().encode().split() if text.is_valid else []
            kept = _kept(words, spans.as_py(), window)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, window, digest, ["doc_id", "text"], "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs in their columns; texts that lose words become their kept words, joined by one space (n_chars, where
    there is one, follows); other texts stay as they are."""
    cols = docs.columns

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        k, texts = cols.index("text"), []
        for text, spans in zip(b.column(k), b.column(len(cols)), strict=True):
            text = text.as_py()
            if text and spans.is_valid:
                text = b" ".join(_kept(text.encode().split(), spans.as_py(), window)).decode()
            texts.append(text)
        arrays = [pa.array(texts, b.column(k).type) if i == k else b.column(i) for i in range(len(cols))]
        return pa.RecordBatch.from_arrays(arrays, names=cols)

    out = _apply(docs, window, cut, cols, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
