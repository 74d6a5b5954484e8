"""Approximate nearest neighbours by inner product, with balanced posting lists.

Largest inner product is nearest distance once every vector has one more component, sqrt(M^2 - |x|^2) with M the
largest norm (0 for a query). On the driver, a bounded sample is cut into small clusters of even size by balanced
k-means, level by level; their centroids, at most MAX_LISTS, are linked into a graph that a beam search walks in
memory. Every vector goes to the list of its nearest centroid and, if it lies near a boundary, to others: those
within (1 + REPLICATE) times the least distance that aren't hidden behind a centroid already chosen. A query visits
the lists whose centroids are within (1 + PRUNE) times the distance of its nearest one. Lists are dealt out in
blocks of bounded size, so that a list that a third of the vectors share is still many small tasks.

Within a block, scores are computed in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import frugal, materialize

K = 20
SHAPE = "query_id long, rank int, vec_id long, score double"
#: Vectors a list is meant to hold; bounds of the lists' number and of the sample that the centroids are fitted on.
LIST_ROWS, MAX_LISTS, SAMPLE = 128, 1 << 14, 1 << 16
#: Sampled vectors that every query is scored against first: the k-th best of those in the lists that it visits bounds
#: what blocks need return.
BOUND_ROWS = 4096
#: Rows of one list that one task takes at once.
BLOCK_ROWS = 256
#: Rows of one batch of queries and the lists that they visit.
BATCH_ROWS = 1 << 15
REPLICATE, MAX_REPLICAS = 0.03, 4
#: Centroids that a query's walk keeps at first; queries whose selection that may cut see all centroids.
PRUNE, BEAM = 0.18, 512
#: Centroids that a vector's walk to its own lists keeps.
HOME_BEAM = 96
DEGREE = 16


def balanced_clusters(x: np.ndarray, size: int, seed: int = 7, fan: int = 8, rounds: int = 12) -> np.ndarray:
    """Centroids of clusters of about `size` rows: k-means that charges crowded clusters, again within each cluster."""
    rng = np.random.default_rng(seed)
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        k = min(fan, round(len(rows) / size))
        if k < 2:
            out.append(x[rows].mean(0))
            continue
        own = x[rows]
        c = own[rng.choice(len(rows), k, replace=False)]
        charge = np.zeros(k)
        for r in range(rounds):
            d = (own * own).sum(1)[:, None] - 2 * own @ c.T + (c * c).sum(1)
            best = (d + charge).argmin(1)
            n = np.bincount(best, minlength=k)
            charge = charge + d.std() * 0.4 / (1 + 0.3 * r) * np.clip(n * k / len(rows) - 1, -1, 1)
            c = np.stack([own[best == j].mean(0) if n[j] else own[rng.integers(len(rows))] for j in range(k)])
        if n.max() == len(rows):  # copies: no cut tells them apart
            out.append(own.mean(0))
        else:
            stack += [rows[best == j] for j in range(k) if n[j]]
    return np.stack(out)


class CentroidGraph:
    """Centroids with, for each, up to DEGREE neighbours none of which hides another, and a beam search over them."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.c, n = c.astype(np.float32), len(c)
        norm = (c * c).sum(1)
        rng = np.random.default_rng(seed)
        near = np.empty((n, min(n, 2 * degree)), np.int32)
        for a in range(0, n, 2048):
            d = norm[None, :] - 2 * c[a : a + 2048] @ c.T
            top = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            near[a : a + 2048] = np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1)
        links: list[list[int]] = []
        for i in range(n):
            chosen: list[int] = []
            for j in near[i]:
                dij = ((c[i] - c[j]) ** 2).sum()
                if j != i and (not chosen or ((c[chosen] - c[j]) ** 2).sum(1).min() > 0.8 * dij) and len(chosen) < degree // 2:
                    chosen.append(int(j))
            links.append(chosen)
        back: list[set[int]] = [set(x) for x in links]
        for i, x in enumerate(links):
            for j in x:
                back[j].add(i)
        far = rng.integers(0, n, (n, 4))
        for i in range(n):
            back[i].update(far[i].tolist())
            back[i].discard(i)
        width = max(map(len, back), default=1) or 1
        self.links = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(back)], np.int32).reshape(n, -1)
        self.start = rng.choice(n, min(n, 16), replace=False)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of each query's beam nearest found, nearest first."""
        n, beam, q = len(self.c), min(beam, len(self.c)), q.astype(np.float32)
        qn, cn = (q * q).sum(1)[:, None], (self.c * self.c).sum(1)
        if beam == n:  # the beam holds every node
            d = qn - 2 * q @ self.c.T + cn
            at = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return at, np.maximum(np.take_along_axis(d, at, 1), 0)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        ids = np.broadcast_to(self.start, (len(q), len(self.start))).copy()
        d = qn - 2 * q @ self.c[self.start].T + cn[self.start]
        seen[rows, ids] = True
        if ids.shape[1] < beam:
            ids = np.pad(ids, ((0, 0), (0, beam - ids.shape[1])))
            d = np.pad(d, ((0, 0), (0, beam - d.shape[1])), constant_values=np.inf)
        done = np.isinf(d)
        while True:
            open_ = np.where(done, np.inf, d)
            pick = np.argpartition(open_, min(3, beam - 1), axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(q), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.links.shape[1], axis=1)
            order = np.argsort(new, axis=1, kind="stable")  # one of equal ids
            same = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
            fresh &= ~twice
            i, j = np.nonzero(fresh)  # not |=, by which a repeated id's last place would undo the mark
            seen[i, new[i, j]] = True
            nd = np.where(fresh, qn - 2 * (self.c[new] @ q[:, :, None])[:, :, 0] + cn[new], np.inf)
            ids, d = np.concatenate([ids, new], 1), np.concatenate([d, nd], 1)
            done = np.concatenate([done, ~fresh], 1)
            keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            ids, d, done = (np.take_along_axis(v, keep, 1) for v in (ids, d, done))
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(d, order, 1), 0)


def _lists_of(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    at, d = graph.search(x, HOME_BEAM)
    at, d = at[:, :8], d[:, :8]
    out = []
    for i in range(len(x)):
        chosen = [at[i, 0]]
        for j, dj in zip(at[i, 1:], d[i, 1:], strict=True):
            if dj > d[i, 0] * (1 + REPLICATE) ** 2 or len(chosen) == MAX_REPLICAS:
                break
            if ((graph.c[chosen] - graph.c[j]) ** 2).sum(1).min() >= 0.3 * dj:
                chosen.append(j)
        out.append(np.array(chosen))
    return out


def _probes_of(graph: CentroidGraph, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """Lists to visit: by the distance ratio alone, and as many as hold `least` vectors together.

    The farthest centroid of a query's beam must fail both, or else the beam grows to all centroids."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(q)
    open_, beam = np.arange(len(q)), BEAM
    while len(open_):
        at, d = graph.search(q[open_], beam)
        near = d <= (d[:, :1] * (1 + PRUNE) ** 2)
        held = np.cumsum(sizes[at], axis=1) - sizes[at]
        take = near | (held < least)
        whole = ~take[:, -1] | (beam >= len(graph.c))
        for i in np.flatnonzero(whole):
            out[open_[i]] = at[i][take[i]]
        open_, beam = open_[~whole], len(graph.c)
    return out


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of each query's k best rows of x but its own, of those not under its floor; ties
    to smaller ids.

    A matrix product finds the candidates; the scores are row sums, the same wherever a row stands."""
    s = q @ x.T
    s[own[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] > k:
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (np.abs(q).max(1, initial=0) * np.abs(x).max(initial=0) * x.shape[1] + 1)
        take = s >= (edge - slack)[:, None]
    else:
        take = np.isfinite(s)
    take &= np.isfinite(s) if floor is None else s >= floor[:, None]
    i, j = np.nonzero(take)
    exact = (q[i] * x[j]).sum(1)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], ids[j[keep]], exact[keep]


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that take part: neither null nor zero, all components finite."""
    ok = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(vector, lambda e: e != 0)
    return table.where(F.coalesce(F.col(vector).isNotNull() & ok, F.lit(False)))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def search(table: DataFrame, queries, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where `queries` (a Column) holds, their k nearest others found.

    Rows with a null id or a vector that takes no part are left out on both sides; vectors of different lengths have
    no product, so each length is searched by itself. Rows that repeat an id are one vector: the first by a hash of
    it. Fewer than k others: all of them. An empty table gives an empty one."""
    spark = table.sparkSession
    vectors = usable(table.where(F.col(id_col).isNotNull()), vector)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = materialize(rows.groupBy("id").agg(F.min_by(F.struct("v", "asks"), F.xxhash64("v")).alias("r")).select("id", "r.v", "r.asks"), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # of a column of vectors, one or few
    found = [_search(rows if len(lengths) == 1 else rows.where(F.size("v") == m), k) for m in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SHAPE)


def _search(rows: DataFrame, k: int) -> DataFrame:
    """search over (id, v, asks), vectors of one length."""
    spark = rows.sparkSession
    kind = rows.schema["v"].dataType.simpleString()
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))).first()
    some = rows.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    wide = lambda x: np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])
    sample = wide(_matrix(some["v"]))
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS))
    graph = CentroidGraph(balanced_clusters(sample, max(1, len(sample) // lists)))
    shared = spark.sparkContext.broadcast(graph)
    homes = [graph.search(sample[a : min(a + 512, BOUND_ROWS)], HOME_BEAM)[0][:, 0] for a in range(0, min(len(sample), BOUND_ROWS), 512)]
    known = spark.sparkContext.broadcast((_matrix(some["v"])[:BOUND_ROWS], some["id"].to_numpy()[:BOUND_ROWS], np.concatenate(homes)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                x = _matrix(b.column(1))
                for_rows = _lists_of(shared.value, wide(x))
                i = np.repeat(np.arange(len(x)), [len(r) for r in for_rows])
                at = np.concatenate(for_rows).astype(np.int32) if len(x) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i))], names=["list", "id", "v"])

    postings = materialize(rows.select("id", "v").mapInArrow(frugal(assign), f"list int, id long, v {kind}"), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).toArrow()  # a row a list
    held = np.zeros(len(graph.c), np.int64)
    held[sizes["list"].to_numpy()] = sizes["n"].to_numpy()
    blocks = np.maximum(-(-held // BLOCK_ROWS), 1)
    counts = spark.sparkContext.broadcast((held, blocks))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = counts.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                q = _matrix(b.column(1))
                visit = _probes_of(shared.value, np.column_stack([q, np.zeros(len(q))]), held, 8 * k)
                x, ids, home = known.value
                visited = np.zeros((len(q), len(held)), bool)
                for r, v in zip(visited, visit, strict=True):
                    r[v] = True
                scores = np.where(visited[:, home] & (b.column(0).to_numpy()[:, None] != ids[None, :]), q @ x.T, -np.inf)
                # at least k others in these lists score so much; a little less, for rounding
                floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(q), -np.inf)
                floor = np.where(np.isfinite(floor), floor - 1e-9 * (np.abs(floor) + 1), -np.inf)
                one = np.concatenate(visit) if len(q) else np.zeros(0, int)
                i = np.repeat(np.repeat(np.arange(len(q)), [len(v) for v in visit]), blocks[one])
                at = np.repeat(one, blocks[one])
                ends = np.cumsum(blocks[one])
                block = np.arange(len(at)) - np.repeat(ends - blocks[one], blocks[one])
                for s in range(0, len(at), BATCH_ROWS):
                    e = slice(s, s + BATCH_ROWS)
                    j = pa.array(i[e])
                    yield pa.RecordBatch.from_arrays([pa.array(at[e].astype(np.int32)), pa.array(block[e].astype(np.int32)), b.column(0).take(j), b.column(1).take(j), pa.array(floor[i[e]])], names=["list", "block", "id", "v", "floor"])

    asked = rows.where("asks").select("id", "v").mapInArrow(frugal(probe), f"list int, block int, id long, v {kind}, floor double")
    block_of = F.get(F.lit([int(x) for x in blocks]), F.col("list"))
    dealt = postings.withColumn("block", F.pmod(F.xxhash64("id"), block_of).cast("int")).select("list", "block", "id", "v", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("asks"))
    both = dealt.unionByName(asked.withColumn("asks", F.lit(1))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (list, block), vectors before queries: one block is held, queries pass by."""
        key, xs, ids = None, [], []
        x = y = None
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in (0, 1, 4)])
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
            v, id_, floor = _matrix(b.column(3)), b.column(2).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)
            for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                here = tuple(keys[a, :2])
                if here != key:
                    key, xs, ids, x = here, [], [], None
                if not keys[a, 2]:
                    xs.append(v[a:z])
                    ids.append(id_[a:z])
                    continue
                if not xs:
                    continue
                if x is None:
                    x, y = np.concatenate(xs), np.concatenate(ids)
                for s in range(a, z, 1024):
                    e = min(s + 1024, z)
                    i, found, score = best(x, y, v[s:e], id_[s:e], k, floor[s:e])
                    yield pa.RecordBatch.from_arrays([pa.array(id_[s:e][i]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = both.sortWithinPartitions("list", "block", "asks").select("list", "block", "id", "v", "asks", "floor").mapInArrow(frugal(scan), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The K nearest of every row whose vec_id is divisible by 20."""
    return search(embeddings, F.col("vec_id") % 20 == 0)
