"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Graphs are flat arrays of neighbours, one array a level. Building and search
take many vectors at once in numpy: a search step expands the best open
candidates of all queries of a block together. Inner products become nearest
neighbours by one more component that gives all vectors the same length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import written
from .vectors import matrix, usable

_NEIGHBOURS = 16
_NONE = -1
_BLOCK = 512
#: Blocks of queries that one task sends through a shard's graph, which it loads once.
_SPLIT_BLOCKS = 16
#: Relative difference below which similarities in single precision may be ties.
_TIE = 1e-5


@dataclass
class Graph:
    """``levels[k]``: neighbours of the first len(levels[k]) nodes; nodes are in order of their highest level, downwards."""

    points: np.ndarray
    levels: list[np.ndarray]

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, nodes), best first; node -1 where fewer were found."""
        entry = np.zeros(len(queries), np.int64)
        for links in reversed(self.levels[1:]):
            entry = np.maximum(_beam(self.points, links, queries, entry, 4)[1][:, 0], 0)
        return _beam(self.points, self.levels[0], queries, entry, ef)

    def search_with_ties(self, queries: np.ndarray, k: int, ef: int) -> list[np.ndarray]:
        """Nodes found for each query; the beam widens where its last place may tie with the ``k``-th best."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        rows = np.arange(len(queries))
        while len(rows):
            ef = min(ef, len(self.points))
            sims, found = self.search(queries[rows], ef)
            for i, row in enumerate(rows):
                out[row] = found[i][found[i] >= 0]
            last, kth = sims[:, -1], sims[:, min(k, ef) - 1]
            with np.errstate(invalid="ignore"):
                tied = (last > -np.inf) & (last >= kth - _TIE * np.maximum(np.abs(kth), 1e-6))
            rows = rows[tied] if ef < len(self.points) else rows[:0]
            ef *= 2
        return out


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    q, n = len(queries), len(links)
    ids = np.full((q, ef), _NONE, np.int64)
    sims = np.full((q, ef), -np.inf, np.float32)
    done = np.ones((q, ef), bool)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for "none"
    seen[:, n] = True
    ids[:, 0], done[:, 0] = entry, False
    sims[:, 0] = np.einsum("qd,qd->q", queries, points[entry])
    seen[np.arange(q), entry] = True
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, min(expand, ef - 1), 1)[:, :expand]
        ok = np.take_along_axis(open_, pick, 1) > -np.inf
        some = ok.any(1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        near = links[np.where(ok, ids[live[:, None], pick], 0)]
        near = np.where(ok[:, :, None], near, _NONE).reshape(len(live), -1)
        near = np.sort(near, 1)
        new = ~seen[live[:, None], near] & (near >= 0)
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        width = max(1, int(new.sum(1).max()))
        order = np.argsort(~new, 1, kind="stable")[:, :width]
        near, new = np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)
        seen[live[:, None], np.where(new, near, n)] = True
        s = np.einsum("qd,qkd->qk", queries[live], points[np.where(new, near, 0)])
        s = np.where(new, s, -np.inf).astype(np.float32)
        all_s, all_i = np.concatenate([sims[live], s], 1), np.concatenate([ids[live], np.where(new, near, _NONE)], 1)
        all_d = np.concatenate([done[live], ~new], 1)
        top = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), 1, kind="stable"), 1)
        sims[live], ids[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_d))
    return sims, np.where(sims > -np.inf, ids, _NONE)


def _select(points: np.ndarray, node: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (-1: none) up to ``most``: those nearer to it than to one chosen before, then the nearest others."""
    v = points[np.maximum(cand, 0)]
    to_node = np.where(cand >= 0, np.einsum("nd,nkd->nk", points[node], v), -np.inf)
    order = np.argsort(-to_node, 1, kind="stable")
    cand, to_node = np.take_along_axis(cand, order, 1), np.take_along_axis(to_node, order, 1)
    valid = (cand >= 0) & (cand != node[:, None])
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = np.einsum("nkd,njd->nkj", v, v)
    closest = np.full(cand.shape, -np.inf)
    chosen = np.zeros(cand.shape, bool)
    for k in range(cand.shape[1]):
        good = valid[:, k] & (to_node[:, k] > closest[:, k]) & (chosen.sum(1) < most)
        chosen[good, k] = True
        closest[good] = np.maximum(closest[good], between[good, k])
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    best = np.argsort(rank, 1)[:, :most]
    out = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(cand, best, 1), _NONE)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=_NONE)
    return out


def _level(points: np.ndarray, n: int, most: int, upper: list[np.ndarray], ef: int) -> np.ndarray:
    """Neighbours of the first ``n`` nodes in one level; batches of at most half of what is there enter together."""
    links = np.full((n, most), _NONE, np.int64)
    graph = Graph(points, [links[:0], *upper])
    start = min(n, 32)
    links[:start] = _select(points, np.arange(start), np.tile(np.arange(start), (start, 1)), most)
    at = start
    while at < n:
        end = min(n, at + max(16, min(_BLOCK, at // 2)))
        new = np.arange(at, end)
        entry = np.zeros(len(new), np.int64)
        for above in reversed(upper):
            entry = np.maximum(_beam(points, above, points[new], entry, 4)[1][:, 0], 0)
        entry = np.where(entry < at, entry, 0)
        found = _beam(points, links[:at], points[new], entry, ef)[1]
        peers = points[new] @ points[new].T
        np.fill_diagonal(peers, -np.inf)
        k = min(16, len(new) - 1)
        if k > 0:
            found = np.concatenate([found, new[np.argpartition(-peers, k - 1, 1)[:, :k]]], 1)
        links[at:end] = _select(points, new, found, most)
        src, dst = np.repeat(new, most), links[at:end].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("nd,nd->n", points[src], points[dst])
        order = np.lexsort((-sim, dst))
        src, dst = src[order], dst[order]
        who, first, count = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(first, count)
        keep = rank < 48
        back = np.full((len(who), min(48, int(count.max()) if len(count) else 0)), _NONE, np.int64)
        back[np.repeat(np.arange(len(who)), count)[keep], rank[keep]] = src[keep]
        for lo in range(0, len(who), 2048):
            part = who[lo : lo + 2048]
            both = np.concatenate([links[part], back[lo : lo + 2048]], 1)
            both = -np.sort(-both, 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = _NONE
            links[part] = _select(points, part, both, most)
        at = end
    del graph
    return links


def build(vectors: np.ndarray, *, ef: int = 64, seed: int = 1) -> tuple[Graph, np.ndarray]:
    """The graph, and the row of ``vectors`` that each of its nodes is."""
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(_NEIGHBOURS)).astype(int)
    order = np.argsort(-height, kind="stable")
    norm = (vectors**2).sum(1)
    points = np.concatenate([vectors, np.sqrt(np.maximum(0, norm.max(initial=0) - norm))[:, None]], 1)[order].astype(np.float32)
    levels: list[np.ndarray] = []
    for k in range(int(height.max(initial=0)), -1, -1):
        n = int((height >= k).sum())
        levels.insert(0, _level(points, n, _NEIGHBOURS * (2 if k == 0 else 1), levels[:], ef))
    return Graph(points, levels), order


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    ef: int = 200,
    shard_size: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query, by inner product in double precision.

    Equal vectors are one node with its ``k + 1`` smallest ids, so copies, however
    many, neither crowd a graph nor a task. Nodes are dealt by hash to shards
    of about ``shard_size``, the most that one task builds and holds (some 15
    MB at 64 components). A task loads one shard's graph and streams blocks of
    queries through it; every query meets every shard, and the shards' best are
    merged. Scores are exact. Ties go to the smaller id: a search that ends in
    a tie with its ``k``-th place goes on with a wider beam until it is past it.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part; nor do null ids. Repeated rows count
    once; an id with several vectors is one query and one candidate, by its
    best score, and never its own neighbour. Other columns are ignored. Queries
    without candidates have no rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")
    ).where("vec_id IS NOT NULL")
    rows = usable(rows, "v").distinct()
    ids = rows.select("vec_id", "v").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    nodes = ids.where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes, "hnsw")
    asked = written(rows.where("is_query").select(F.col("vec_id").alias("query_id"), "v"), "hnsw")
    n_shards = max(1, -(-nodes.count() // shard_size))
    n_blocks = max(1, -(-asked.count() // _BLOCK))
    n_splits = -(-n_blocks // _SPLIT_BLOCKS)

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        v = matrix(table.column("v"))
        graph, order = build(v)
        lists = table.column("ids").to_pylist()
        data = pickle.dumps((graph.points, [x.astype(np.int32) for x in graph.levels], v[order], [lists[i] for i in order]))
        return pa.table({"shard": table.column("shard")[:1], "graph": pa.array([data], pa.binary())})

    dealt = nodes.withColumn("first", F.col("ids")[0]).withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(n_shards)).cast("int"))
    graphs = written(dealt.groupBy("shard").applyInArrow(index, "shard int, graph binary"), "hnsw")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "v")).alias("q"))
    blocks = blocks.select("block", "q", F.pmod("block", F.lit(n_splits)).alias("split"), all_of(n_shards).alias("shard"))
    work = graphs.select("shard", all_of(n_splits).alias("split"), F.lit(-1).alias("block"), "graph").unionByName(blocks, allowMissingColumns=True)
    # A graph comes ahead of the blocks that it answers.
    work = work.repartition(max(1, min(n_shards * n_splits, 65_536)), "shard", "split").sortWithinPartitions("shard", "split", "block")

    def search(batches) -> Iterator[pa.RecordBatch]:
        graph = exact = lists = lowest = None
        for batch in batches:
            for q, data in zip(batch.column("q"), batch.column("graph")):
                if data.is_valid:
                    points, levels, exact, lists = pickle.loads(data.as_py())
                    graph, lowest = Graph(points, levels), np.array([x[0] for x in lists])
                    continue
                who = q.values.field("query_id").to_numpy()
                v = matrix(q.values.field("v"))
                size = np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-300)
                found = graph.search_with_ties(np.concatenate([v / size, np.zeros((len(v), 1))], 1).astype(np.float32), k + 1, max(ef, k + 1))
                out: list[tuple[int, int, float]] = []
                for query, at, x in zip(who.tolist(), found, v):
                    s = exact[at] @ x
                    order = np.lexsort((lowest[at], -s))
                    got: set[int] = set()
                    for j in order:
                        if len(got) >= k and s[j] < least:
                            break
                        least = s[j]
                        new = [i for i in lists[at[j]] if i != query]
                        got.update(new)
                        out += [(query, i, float(s[j])) for i in new]
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = work.select("q", "graph").mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
