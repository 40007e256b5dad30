"""Near-duplicate vectors by product quantisation.

Unit vectors go to coarse inverted lists; residuals are coded by subspaces.
A pair's cosine of at least ``t`` means a distance of at most
r = sqrt(2 - 2 t). A pair is split by the border of two lists only if one
vector's step to the other crosses it, and of that step, in d dimensions, a
border's direction has a part of about r / sqrt(d). So a vector probes the
lists whose border is within a few times that, or, as an option, within r
itself, which loses nothing. Beyond a number of coarse lists each is divided
further, by codebooks of residuals, level by level; a vector probes a cell if
it passes the borders of every level, so neither the work of a list nor that
of placing a vector follows the number of vectors. Of two lists one side probes. A code's
table-lookup distance may exceed the true one by no more than the code's own
stored error. What passes is decided by the cosine of the original vectors in
double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import connected_components, discard, written
from .vectors import matrix, usable

_BLOCK = 2048
_EPS = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _levels(classes: int, list_size: int, most_lists: int, fan_out: int) -> list[int]:
    """Coarse lists, then the cells that each level divides a list into: about ``list_size`` classes a cell at any size."""
    cells = max(1, -(-classes // list_size))
    levels = [min(most_lists, cells)]
    cells = -(-cells // levels[0])
    while cells > 1:
        levels.append(min(fan_out, cells))
        cells = -(-cells // levels[-1])
    return levels


def _train(x: np.ndarray, levels: list[int], parts: int, codes: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Centroids of each level, a codebook for each subspace, and the subspaces' borders."""
    rng = np.random.default_rng(7)
    trees, rest = [], x
    for n in levels:
        trees.append(_kmeans(rest, n, 8, rng))
        rest = rest - trees[-1][(rest @ trees[-1].T - 0.5 * (trees[-1] * trees[-1]).sum(1)).argmax(1)]
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    return trees, [_kmeans(rest[:, a:b], codes, 6, rng) for a, b in zip(cuts[:-1], cuts[1:])], cuts


def _inside(rest: np.ndarray, centres: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre of each row, whether it probes each centre): the border to the centre's cell is within ``near``."""
    square = (centres * centres).sum(1)
    d = square - 2 * (rest @ centres.T)
    home = d.argmin(1)
    gap = np.sqrt(np.maximum(square[home][:, None] + square - 2 * (centres[home] @ centres.T), 1e-12))
    probe = (d - d[np.arange(len(d)), home][:, None]) <= 2 * gap * near
    probe[np.arange(len(d)), home] = True
    return home, probe


def _probes(u: np.ndarray, trees: list[np.ndarray], near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each row, what its centre leaves of the row, rows that probe, cells probed).

    A cell's number has its places in the levels as digits. Of two cells the
    first probes, so a row asks its own and cells of larger numbers.
    """
    at, probe = _inside(u, trees[0], near)
    home, rest = at.astype(np.int64), u - trees[0][at]
    q, cell = np.nonzero(probe)
    ahead = cell >= home[q]
    q, cell = q[ahead], cell[ahead]
    left = u[q] - trees[0][cell] if len(trees) > 1 else None
    for centres in trees[1:]:
        at = ((centres * centres).sum(1) - 2 * (rest @ centres.T)).argmin(1)
        home, rest = home * len(centres) + at, rest - centres[at]
        found = []
        for lo in range(0, len(q), 1 << 14):
            _, probe = _inside(left[lo : lo + (1 << 14)], centres, near)
            i, j = np.nonzero(probe)
            number = cell[i + lo] * len(centres) + j
            ahead = number >= home[q[i + lo]]
            i, j, number = i[ahead] + lo, j[ahead], number[ahead]
            found.append((q[i], number, left[i] - centres[j]))
        q, cell, left = (np.concatenate(x) for x in zip(*found))
    other = cell > home[q]
    return home, rest, np.concatenate([np.arange(len(u)), q[other]]), np.concatenate([home, cell[other]])


def _centre(cell: int, trees: list[np.ndarray]) -> np.ndarray:
    """The sum of a cell's centroids over the levels."""
    total = 0.0
    for centres in trees[:0:-1]:
        cell, at = divmod(cell, len(centres))
        total = total + centres[at]
    return trees[0][cell] + total


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number of each of ``n`` nodes' component under links a-b."""
    low = np.arange(n)
    while True:
        best = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, best)
        np.minimum.at(new, b, best)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_duplicates(
    vectors: DataFrame,
    *,
    cosine: float = 0.98,
    list_size: int = 256,
    most_lists: int = 4096,
    fan_out: int = 64,
    sample: int = 16_384,
    parts: int = 8,
    codes: int = 64,
    deviations: float | None = 3.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors of one label link at a cosine of ``cosine`` or more. Equal vectors
    of a label are one class that counts as often as it has rows, so copies are
    never paired. Centroids and codebooks are fitted on the ``sample`` classes
    of the smallest hash; there is about one list for ``list_size`` classes. Up
    to ``most_lists`` are coarse; where that is too few, residuals divide each
    list into up to ``fan_out`` cells a level, with as many levels as it takes.
    A vector probes lists whose border is within ``deviations`` / sqrt(d) of
    the distance r that ``cosine`` allows (at most r; None: r, so that no link
    is lost). At 3 the pairs least likely to be found, those just at ``cosine``
    that lie across a border, are missed with a probability of about 0.001 (for
    each border between them) if their difference has no preferred direction.
    Large lists are split into blocks of queries and of entries, and a block
    returns, for each vector, its number of links and one edge to its block's
    component, never the pairs.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components link with nothing, nor do null labels: no links, own
    component, kept. Rows of one id count as rows of their own; ids may be null.
    Other columns are ignored.
    """
    wide = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(wide).alias("v"), F.col(label_col).alias("label")
    )
    good = usable(rows.where("label IS NOT NULL"), "v")
    key = F.concat_ws("-", F.xxhash64("label", "v"), F.xxhash64("v", "label", F.lit(11)))
    keyed = written(good.withColumn("key", key), "pq")
    classes = keyed.groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = written(classes, "pq")
    levels = _levels(classes.count(), list_size, most_lists, fan_out)

    def learn(batches) -> Iterator[pa.RecordBatch]:
        got = [(k, v) for b in batches for k, v in zip(b.column("key").to_pylist(), matrix(b.column("v")))]
        if got:
            x = np.array([v for _, v in sorted(got, key=lambda r: r[0])])
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_train(x, levels, parts, codes))], pa.binary())], ["m"])

    chosen = classes.select("key", "v").orderBy("key").limit(sample)
    model = chosen.repartition(1).mapInArrow(learn, "m binary").collect()
    trees, books, cuts = pickle.loads(model[0].m) if model else ([np.zeros((1, 1))], [], np.zeros(1, int))
    radius = (2 - 2 * cosine) ** 0.5 + _EPS
    near = radius * (1.0 if deviations is None else min(1.0, deviations / max(1, trees[0].shape[1]) ** 0.5))

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part.column("v"))
                u = x / np.sqrt((x * x).sum(1, keepdims=True))
                home, rest, q, at = _probes(u, trees, near)
                code = np.stack([
                    ((b * b).sum(1) - 2 * (rest[:, i:j] @ b.T)).argmin(1) for b, i, j in zip(books, cuts[:-1], cuts[1:])
                ], 1).astype(np.uint8)
                told = np.concatenate([b[code[:, s]] for s, b in enumerate(books)], 1)
                error = np.sqrt(((rest - told) ** 2).sum(1))
                take = np.concatenate([np.arange(len(u)), q])
                n = len(u)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(pa.array(take)) for c in ("key", "label", "n", "v")],
                        pa.array(np.concatenate([home, at]), pa.int64()),
                        pa.array(np.concatenate([home, home[q]]), pa.int64()),
                        pa.array(np.arange(len(take)) >= n),
                        pa.array([bytes(c) for c in code[take]], pa.binary()),
                        pa.array(error[take]),
                    ],
                    ["key", "label", "n", "v", "list", "home", "asks", "code", "error"],
                )

    label = dict(classes.dtypes)["label"]
    placed = classes.select("key", "label", "n", "v").mapInArrow(
        place, f"key string, label {label}, n long, v {wide}, list long, home long, asks boolean, code binary, error double"
    )
    placed = written(placed, "pq")
    sizes = placed.groupBy("label", "list").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("asks")) / _BLOCK)).cast("int").alias("entry_blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("asks")) / _BLOCK)).cast("int").alias("query_blocks"),
        F.count_if(~F.col("asks")).alias("entries"),
    )
    sizes = sizes.where("entries > 0")
    salt = F.xxhash64("key")
    dealt = placed.join(sizes, ["label", "list"])
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    one_of = lambda c: F.array(F.pmod(salt, F.col(c)).cast("int"))
    dealt = dealt.withColumn("eb", F.explode(F.when(F.col("asks"), all_of("entry_blocks")).otherwise(one_of("entry_blocks"))))
    dealt = dealt.withColumn("qb", F.explode(F.when(F.col("asks"), one_of("query_blocks")).otherwise(all_of("query_blocks"))))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        keys = np.array(table.column("key").to_pylist(), object)
        q, e = np.flatnonzero(asks), np.flatnonzero(~asks)
        none = pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.string())})
        if not len(q) or not len(e):
            return none
        v, n = matrix(table.column("v")), table.column("n").to_numpy()
        norm = np.sqrt((v * v).sum(1))
        c = _centre(table.column("list")[0].as_py(), trees)
        rest = v[q] / norm[q, None] - c
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(v), -1)[e]
        limit = (radius + table.column("error").to_numpy()[e]) ** 2
        links_q, links_e = [], []
        for lo in range(0, len(q), 256):
            est = np.zeros((len(q[lo : lo + 256]), len(e)))
            for s, (b, i, j) in enumerate(zip(books, cuts[:-1], cuts[1:])):
                r = rest[lo : lo + 256, i:j]
                est += ((r * r).sum(1)[:, None] - 2 * (r @ b.T) + (b * b).sum(1))[:, code[:, s]]
            a, b = np.nonzero(est <= limit)
            a = q[a + lo]
            b = e[b]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                ok = np.einsum("nd,nd->n", v[x], v[y]) >= cosine * norm[x] * norm[y]
                links_q.append(x[ok])
                links_e.append(y[ok])
        if not any(map(len, links_q)):
            return none
        a, b = np.concatenate(links_q), np.concatenate(links_e)
        # Inside a list both vectors ask; across lists one does, and the link counts for both.
        across = table.column("home").to_numpy()[a] != table.column("list")[0].as_py()
        total = (np.bincount(a, n[b], len(v)) + np.bincount(b[across], n[a[across]], len(v))).astype(np.int64)
        low = _roots(len(v), a, b)
        told = np.unique(np.concatenate([a, b]))
        return pa.table({"key": pa.array(keys[told], pa.string()), "n": pa.array(total[told]), "root": pa.array(keys[low[told]], pa.string())})

    columns = ("key", "n", "v", "list", "home", "asks", "code", "error", "label", "eb", "qb")
    found = dealt.select(*columns).groupBy("label", "list", "eb", "qb").applyInArrow(compare, "key string, n long, root string")
    found = written(found, "pq")
    discard(placed)
    part = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg((F.sum("n") - 1).alias("n_links"))
    parts_ = classes.select("key", "low").join(part.withColumnRenamed("id", "key"), "key", "left")
    parts_ = parts_.select("key", "low", F.coalesce("component", "key").alias("part"))
    lowest = parts_.groupBy("part").agg(F.min("low").alias("component_id"))
    told = parts_.join(lowest, "part").join(links, "key", "left").select("key", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = keyed.select("vec_id", "key").join(told, "key").select("vec_id", "n_links", "component_id")
    ok = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
    size = keyed.select(F.size("v").alias("s")).limit(1).collect()
    usable_ = F.lit(False)
    if size:
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        usable_ = ok & ~bad & F.exists("v", lambda x: x != 0) & (F.size("v") == size[0].s)
    alone = rows.where(~F.coalesce(usable_, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
