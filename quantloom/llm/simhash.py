"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within `distance` bits of each other are linked; documents' components follow from the links. Equal
fingerprints are one node from the start. Search goes down a hierarchy of masked bit patterns:

* its upper nodes are the patterns of `blocks` bit blocks, of which two linked fingerprints share at least
  blocks - distance; each fingerprint goes to the node of every such set of blocks, a shuffle key. A node that
  holds too many fingerprints is split by the same rule over the bits that its mask leaves free;
* within an upper node, fingerprints are sorted by Gray rank, so that neighbours share most bits; runs of eight form
  a node with the mask and pattern of the bits that they share, runs of eight nodes the next, up to a root. Two nodes
  are compared by the bits fixed in both: once these accumulate more than `distance` differences, all pairs below
  are pruned at once.

Nothing is dropped: links found within an upper node are reduced to a spanning forest before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import frugal, materialize, split_by_keys
from quantloom.llm.graph import connected_components

BITS, SHINGLE, DISTANCE, FAN = 64, 4, 4, 8
#: Upper nodes above this many fingerprints are split again.
NODE_ROWS = 20_000
#: Node pairs held at once.
FRONTIER = 1 << 15


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values (seed 42) of the shingles; no words: 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    w = min(width, n)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[: n - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)], "<u8")
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; doc_id may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    few = docs.select("doc_id", "text")
    return few.mapInArrow(frugal(run), few.select("doc_id").schema.add("fp", "long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order (the prefix parity of its bits)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def links(fp: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j), i < j, of fingerprints of one group at most `distance` bits apart.

    fp is sorted by (group, Gray rank). Levels of the index are built bottom-up for all groups at once; pairs of
    nodes are refined top-down, in pieces of bounded size."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(fp, np.full(len(fp), ones), np.arange(len(fp) + 1), group)]
    while True:
        pat, mask, _, g = levels[-1]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        if len(head) == len(g):
            break
        rank = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
        at = np.flatnonzero(rank % FAN == 0)
        all_and, all_or = np.bitwise_and.reduceat(pat, at), np.bitwise_or.reduceat(pat, at)
        fixed = ~(all_and ^ all_or) & np.bitwise_and.reduceat(mask, at)
        levels.append((all_and & fixed, fixed, np.append(at, len(g)), g[at]))
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, roots[k : k + FRONTIER], roots[k : k + FRONTIER]) for k in range(0, len(roots), FRONTIER)]
    while stack:
        lv, a, b = stack.pop()
        if lv == 0:
            yield a, b
            continue
        begin = levels[lv][2]
        na, nb = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
        size = na * nb
        ends = np.cumsum(size)
        pair = np.repeat(np.arange(len(a)), size)
        k = np.arange(ends[-1]) - np.repeat(ends - size, size)
        i, j = begin[a][pair] + k // nb[pair], begin[b][pair] + k % nb[pair]
        pat, mask = levels[lv - 1][:2]
        keep = (i < j) | (i == j) & (lv > 1)
        i, j = i[keep], j[keep]
        near = np.bitwise_count((pat[i] ^ pat[j]) & mask[i] & mask[j]) <= distance
        i, j = i[near], j[near]
        stack += [(lv - 1, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place linked to each of n places, directly or not."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, b, a)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def upper_nodes(free: int, distance: int, need: int) -> list[int]:
    """Masks over the set bits of `free`: those of every choice of blocks that two linked codes may share, with the
    fewest blocks that fix at least `need` bits."""
    bits = [i for i in range(BITS) if free >> i & 1]
    for blocks in range(distance + 1, len(bits) + 1):
        share = blocks - distance
        if share * (len(bits) // blocks) >= need or share == 4:
            break
    parts = [sum(1 << b for b in bits[k * len(bits) // blocks : (k + 1) * len(bits) // blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, share)]


def near_links(codes: DataFrame, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """(u, v): edges between distinct codes (column fp, long), a spanning forest of each upper node's links.

    Nodes of more than node_rows codes are split, each by the bits that its own mask leaves free, until there are none;
    a node whose mask leaves no more than `distance` bits free is not split, as all its codes (16 at most) are linked."""
    spark = codes.sparkSession
    n = codes.count()
    need = max(1, (n // 512).bit_length())
    whole = (1 << 64) - 1

    def spread(rows: DataFrame, need: int) -> DataFrame:
        """rows (fp, q, fixed), a node's path and the bits that its mask fixes, for each node below: (fp, q, m, p, fixed)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp, q, fixed = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
                for mask in np.unique(fixed):
                    at = fixed == mask
                    for m in upper_nodes(whole & ~int(mask), distance, need):
                        m = np.uint64(m)
                        cols = (fp[at], q[at], np.full(at.sum(), m), fp[at] & m, np.full(at.sum(), mask | m))
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["fp", "q", "m", "p", "fixed"])

        return rows.select("fp", "q", "fixed").mapInArrow(frugal(run), "fp long, q long, m long, p long, fixed long")

    def join(rows: DataFrame) -> DataFrame:
        keys = ["q", "m", "p"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []

            def flush(t: pa.Table) -> pa.RecordBatch:
                cols = [t[c].to_numpy() for c in keys]
                fp = t["fp"].to_numpy().view(np.uint64)
                new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)) if len(fp) else np.zeros(0, bool)
                group = np.cumsum(new)
                order = np.lexsort((gray_rank(fp), group))
                fp, group = fp[order], group[order]
                root = forest(len(fp), links(fp, group, distance)) if len(fp) else np.zeros(0, np.int64)
                i = np.flatnonzero(root != np.arange(len(fp)))
                return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root[i]].view(np.int64))], names=["u", "v"])

            for b in batches:  # whole upper nodes at a time; the last may go on in the next batch
                t = pa.concat_tables([*held, pa.Table.from_batches([b])])
                held = []
                if not t.num_rows:
                    continue
                last = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in keys])
                cut = t.num_rows - int(last[::-1].argmin()) if not last.all() else 0
                if cut:
                    yield flush(t.slice(0, cut))
                held = [t.slice(cut)]
            if held:
                yield flush(pa.concat_tables(held))

        return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(frugal(run), "u long, v long")

    zero = F.lit(0).cast("long")
    rows, out = spread(codes.select("fp", zero.alias("q"), zero.alias("fixed")), need), []
    keys = ["q", "m", "p"]
    while True:
        size = rows.groupBy(*keys, "fixed").count().where(F.col("count") > node_rows)
        large = materialize(size.where(F.bit_count("fixed") < BITS - distance).select(*keys), "large-nodes")
        if large.isEmpty():
            break
        out.append(join(rows.join(large, keys, "left_anti")))
        hot = rows.join(large, keys, "left_semi")
        rows = spread(materialize(hot.select("fp", F.xxhash64(*keys).alias("q"), "fixed"), "large-rows"), 1)
    edges = join(rows)
    for x in out:
        edges = edges.union(x)
    return edges.distinct()


def _roots(codes: DataFrame, distance: int) -> DataFrame:
    """(fp, root) for every distinct fp of codes."""
    least = materialize(codes.select("fp").distinct(), "distinct-fingerprints")
    tree = materialize(connected_components(near_links(least, distance)), "components")
    return least.join(tree, least.fp == tree.u, "left").select("fp", F.coalesce("v", "fp").alias("root"))


def near_components(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable) for every row.

    Texts without words, nulls among them, have fingerprint 0 and are linked like any other. A null doc_id keeps its
    row and is never a component's id, unless the component has no other. Repeated rows are all returned."""
    codes = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), "fingerprints")
    first = codes.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = materialize(_roots(codes, distance).join(first, "fp"), "roots")
    named = root.groupBy("root").agg(F.min("first").alias("component_id"))
    member = root.join(named, "root").select("fp", "component_id")
    return codes.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """docs in their columns: of each component one row, that of the smallest doc_id, of equal ids that of the least
    hash of its text; null ids come last. Rows whose text is linked to no other stay, whatever their ids.

    Only dropped rows, rows that repeat both id and text, and the few that the filter can't tell from them, are shuffled."""
    u = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    d = F.col("doc_id").cast("long")
    codes = materialize(fingerprints(docs.select(F.struct(d.alias("d"), u.alias("u")).alias("doc_id"), "text"), width).select("doc_id.d", "doc_id.u", "fp"), "fingerprints")
    key = F.struct(F.col("d").isNull().alias("z"), "d", "u")
    root = materialize(_roots(codes, distance).join(codes.groupBy("fp").agg(F.min(key).alias("first")), "fp"), "roots")
    member = root.join(root.groupBy("root").agg(F.min("first").alias("kept")), "root").select("fp", "kept")
    gone = codes.join(member, "fp").where(key != F.col("kept")).select("d", "u").distinct()
    again = codes.groupBy("d", "u").count().where("count > 1").select("d", "u")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), d.alias("__d"), u.alias("__u"))
    out = materialize(gone.withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False))), "dropped-documents")
    maybe, never = split_by_keys(rows, out.select(F.col("d").alias("__d"), F.col("u").alias("__u")), ["__d", "__u"])
    lost = out.where("gone").select("d", "u")
    stay = maybe.join(lost, F.col("__d").eqNullSafe(F.col("d")) & (F.col("__u") == F.col("u")), "left_anti")
    both = never.unionByName(stay.dropDuplicates(["__d", "__u"]))
    return both.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
