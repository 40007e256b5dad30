import numpy as np
import pytest
from pyspark.sql import functions as F

from prematch.llm import pq
from prematch.llm.hnsw import nearest
from prematch.llm.pq import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, v string, key int"


def _rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    out = []
    for i in range(400):
        x = base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.4])
        out.append((i, [float(np.float32(a)) for a in x], int(rng.integers(3)), "x", 1))
    same = out[5][1]
    out += [(400 + i, same, 1, "x", 1) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [1.0] * 15 + [nan], [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    out += [(1000 + 20 * i, b, 1, "x", 1) for i, b in enumerate(bad)]
    out += [(2000, same, None, "x", 1)]
    return out


def _ok(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("options", [{"list_size": 32, "deviations": None}, {"list_size": 32}, {"list_size": 1, "deviations": None}, {"list_size": 10**6, "block": 64}, {"list_size": 4, "most_lists": 6, "fan_out": 3, "deviations": None}])
def test_pq_equals_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(pq, "_BLOCK", options.pop("block", pq._BLOCK))
    rows = _rows() + [_rows()[3]]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()))
    v = [np.array(r[1]) / np.linalg.norm(r[1]) if _ok(r[1]) and r[2] is not None else None for r in rows]
    near = [[j for j in range(len(rows)) if j != i and v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and v[i] @ v[j] >= 0.98] for i in range(len(rows))]
    low = [r[0] for r in rows]
    for _ in range(50):
        low = [min([low[i], *[low[j] for j in near[i]]]) for i in range(len(rows))]
    assert got == sorted((r[0], len(near[i]), low[i], r[0] == low[i]) for i, r in enumerate(rows))


def test_pq_cells_follow_the_classes():
    assert pq._levels(0, 256, 4096, 64) == [1]
    assert pq._levels(51_282, 256, 4096, 64) == [201]
    for n in (1, 1_000_000, 10**8, 10**11):
        levels = pq._levels(n, 256, 4096, 64)
        assert max(levels) <= 4096 and n / 256 <= np.prod(levels, dtype=float) <= max(1, 4 * n / 256)


def test_pq_probes_meet_every_pair_within_the_margin():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trees, _, _ = pq._train(x, [5, 4, 3], 2, 8)
    home, rest, q, cell = pq._probes(x, trees, 0.1)
    assert len(np.unique(home)) > 40
    assert np.allclose(rest, x - np.array([pq._centre(int(h), trees) for h in home]))
    asked = set(zip(q.tolist(), cell.tolist()))
    near = [(i, i + 600) for i in range(600) if np.linalg.norm(x[i] - x[i + 600]) <= 0.1]
    near = [(a, b) if home[a] < home[b] else (b, a) for a, b in near if home[a] != home[b]]
    assert len(near) > 20 and all((a, home[b]) in asked for a, b in near)
    assert len(asked) < 0.2 * len(x) * 60 and all(c >= home[i] for i, c in asked)
    assert {(i, h) for i, h in enumerate(home)} <= asked


def test_pq_blocks_without_any_near_pair(spark, monkeypatch):
    monkeypatch.setattr(pq, "_BLOCK", 2)
    rows = [(i, [float(i == j) for j in range(12)], 1, "x", 1) for i in range(12)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), list_size=100, codes=12).collect()
    assert sorted(map(tuple, got)) == [(i, 0, i, True) for i in range(12)]


def test_hnsw_finds_the_nearest(spark):
    rows = _rows() + [_rows()[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=10, shard_size=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    points = {r[0]: np.array(r[1]) for r in rows if _ok(r[1])}
    assert set(got) == {i for i in points if i % 20 == 0}
    right = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(points[q] @ points[i] - s) < 1e-9 and i != q for _, i, s in found)
        true = sorted(((-(points[q] @ p), i) for i, p in points.items() if i != q))[:10]
        right += len({i for _, i, _ in found} & {i for _, i in true})
    assert right >= 0.9 * 10 * len(got)


def test_hnsw_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0], 1, "x", 1)] + [(i, [1.0, float(i)], 1, "x", 1) for i in range(1, 301)]
    for shard_size in (16_384, 60):
        got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=20, shard_size=shard_size).collect()
        assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i, 1.0) for i in range(1, 21)]


def test_hnsw_counts_an_id_once_by_its_best_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.7, 0.95]), (3, [0.1, 0.1])]
    df = spark.createDataFrame([(i, v, 1, "x", 1) for i, v in rows], SCHEMA)
    for parts in (1, 5):
        got = nearest(df.repartition(parts), F.col("vec_id") == 0, k=2).collect()
        assert sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [(1, 2, 0.95), (2, 1, 0.9)]


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x", 1)], [(20, [1.0, 0.0], 1, "x", 1)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert nearest(df, F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(r[0], 0, r[0], True) for r in rows]
