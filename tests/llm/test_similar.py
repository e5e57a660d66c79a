import numpy as np
import pytest

from codelattice.llm import similar as S

SCHEMA = "vec_id long, model string, dim int, embedding array<float>, rep string, key int"


def brute(rows, k):
    seen = {}
    for i, model, dim, v, *_ in rows:
        dim = len(v) if v is not None and dim is None else dim
        if i is None or v is None or len(v) < dim or any(x is None or not np.isfinite(x) for x in v[:dim]) or not any(v[:dim]):
            continue
        seen.setdefault(i, (model, dim, np.array(v[:dim], np.float32).astype(float)))
    out = {}
    for i, (m, d, v) in seen.items():
        others = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, (m2, d2, w) in seen.items() if j != i and (m2, d2) == (m, d)]
        out[i] = [j for _, j in sorted(others)[:k]]
    return out


def clustered(n, dim, seed, model="a"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    x = (centres[rng.integers(len(centres), size=n)] + 0.15 * rng.normal(size=(n, dim))) * rng.uniform(0.2, 9, size=(n, 1))
    return [(int(i) + (0 if model == "a" else 100_000), model, dim, [float(f) for f in v.astype(np.float32)], "r", 1) for i, v in enumerate(x)]


def recall(spark, rows, k=5, **kw):
    got = {}
    for r in S.most_similar(spark.createDataFrame(rows, SCHEMA), k, **kw).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    want = brute(rows, k)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items() if v}
    return sum(len(set(got[i]) & set(v)) for i, v in want.items() if v) / max(1, sum(map(len, want.values())))


def test_exact_when_everything_is_probed(spark):
    assert recall(spark, clustered(400, 64, 1) + clustered(60, 32, 2, "b"), list_rows=10_000) == 1.0


@pytest.mark.parametrize("dim", [48, 100])
def test_recall_over_many_lists_and_blocks(spark, dim):
    rows = clustered(1500, dim, 3)
    assert recall(spark, rows, list_rows=60, shard_rows=150, shard_queries=400) >= 0.95


def test_hot_list_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", 16, [float(x) for x in (np.ones(16) + 1e-3 * rng.normal(size=16)).astype(np.float32)], "", 0) for i in range(600)]
    assert recall(spark, rows, list_rows=600, shard_rows=100, shard_queries=200) == 1.0


def test_copies_ties_and_unusable(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, "a", 4, v, "x", 1) for i in range(20, 0, -1)] + [(3, "a", 4, v, "x", 1)]
    rows += [(30, "a", 4, [4.0, 3.0, 2.0, 1.0], "", 1), (31, "a", 4, [0.0] * 4, "", 1), (32, "a", 4, [1.0, float("nan"), 0.0, 0.0], "", 1), (33, "a", 4, [1.0], "", 1)]
    rows += [(34, "a", 4, None, "", 1), (None, "a", 4, v, "", 1), (35, "b", 4, v, "", 1), (36, None, None, [1.0, 0.0], "", 1), (37, "a", 4, [1.0, None, 2.0, 3.0], "", 1)]
    got = {}
    for r in S.most_similar(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert sorted(got[1]) == [2, 3, 4, 5, 6] and sorted(got[20]) == [1, 2, 3, 4, 5] and sorted(got[30]) == [1, 2, 3, 4, 5]
    assert set(got) == set(range(1, 21)) | {30}


def test_empty(spark):
    assert S.most_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    u = S._unit(rng.normal(size=(600, 64)))
    layout = S.Layout(64, u[:1].astype(np.float32))
    c = u[:300].mean(axis=0).astype(np.float32)
    centre, spread = S._bounds(S._codes(layout, u[300:].astype(np.float32) - c), S._asks(layout, u[:300].astype(np.float32) - c))
    exact = u[:300] @ u[300:].T
    assert (np.abs(centre - exact) <= spread).mean() > 0.97
    assert np.abs(centre - exact).mean() < 0.08


def test_two_levels_and_long_lists(spark, monkeypatch):
    rows = clustered(2500, 24, 6)
    monkeypatch.setattr(S, "FLAT", 8)
    assert recall(spark, rows, list_rows=50, shard_rows=400) >= 0.95  # about 50 lists in 8 cells
    monkeypatch.setattr(S, "FLAT", 1024)
    monkeypatch.setattr(S, "LAYOUT_BYTES", 4 * 24 * 3)
    assert recall(spark, rows, list_rows=20, shard_rows=900) >= 0.95  # three lists, parted where they are searched


def test_exact_setting(spark):
    assert recall(spark, clustered(700, 20, 8) + clustered(60, 12, 9, "b"), exact=True, shard_rows=200) == 1.0


def test_many_copies_are_split(spark, monkeypatch):
    from codelattice.plans import skew

    monkeypatch.setattr(skew.split_join, "__defaults__", ("inner", 8, 3))
    rows = clustered(60, 8, 12) + [(1000 + i, "a", 8, [1.0] * 8, "r", 1) for i in range(40)]
    assert recall(spark, rows) == 1.0


def test_shards_are_bounded_in_bytes():
    layout = S.Layout(768, S._unit(np.random.default_rng(1).normal(size=(40, 768))).astype(np.float32))
    members = np.full(40, 1000)
    layout.share_out(members, members * 4, 0, min(S.SHARD_ROWS, S.SHARD_BYTES // (4 * 768)), S.QUERY_BYTES // (4 * 768))
    held = np.bincount(layout.shard, weights=members)
    assert held.max() * 4 * 768 <= S.SHARD_BYTES
