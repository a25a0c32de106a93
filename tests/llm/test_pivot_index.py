import numpy as np

from palimpsest.llm import pivot_index as pv


def brute(rows):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (links[i], root(i)) for i in parent}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    return [(k, (base[rng.integers(0, len(base))] + rng.normal(scale=rng.choice([0.1, 0.3, 0.35]), size=dim)).astype(np.float32).tolist()) for k in range(n)]


def test_recall_and_precision(spark):
    rows = clustered(600, 32, 1)
    want = brute(rows)
    for block in (1500, 40):
        got = {r.vec_id: r for r in pv.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), block=block).collect()}
        assert len(got) == 600 and all(got[i].n_links <= want[i][0] for i in want)
        assert sum(got[i].n_links for i in want) >= 0.97 * sum(n for n, _ in want.values()) > 0
        assert all(r.kept == (r.vec_id == r.component_id) and r.component_id >= want[r.vec_id][1] for r in got.values())


def test_edges(spark):
    v = [1.0, 2.0, 0.5, 0.1]
    rows = [(5, v), (3, v), (9, [2 * x for x in v]), (1, None), (2, [0.0] * 4), (4, [1.0, None, 1.0, 1.0]), (6, [1.0, float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0]),
            (8, [1.0, 2.0, 0.5]), (10, [-x for x in v]), (11, []), (None, v)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pv.near_duplicates(df).collect()}
    assert got == {5: (2, 3, False), 3: (2, 3, True), 9: (2, 3, False), **{i: (0, i, True) for i in (1, 2, 4, 6, 7, 8, 10, 11)}, None: (0, None, True)}
    assert pv.near_duplicates(df.limit(0)).collect() == []
    assert [tuple(r) for r in pv.near_duplicates(df.where("vec_id = 1")).collect()] == [(1, 0, 1, True)]


def hot_group(n, dim=64, seed=3, share=3):
    """1/share of the rows near one vector, the others clustered."""
    rng = np.random.default_rng(seed)
    x = np.array([v for _, v in clustered(n, dim, seed)])
    x[::share] = rng.normal(size=dim) + rng.normal(scale=0.25, size=(len(x[::share]), dim))
    return x.astype(np.float32)


def links_of(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.concatenate([(u[s : s + 1000] @ u.T >= 0.9).sum(1) for s in range(0, len(u), 1000)]) - 1


def test_recall_with_a_hot_group(spark):
    x = hot_group(12_000)
    want = links_of(x)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: r.n_links for r in pv.near_duplicates(rows).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.97 * want.sum() > 10_000_000
