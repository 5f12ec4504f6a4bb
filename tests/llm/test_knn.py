import numpy as np

from sourcelume.llm.knn import _best, nearest_neighbours, plan_tables

SCHEMA = "id long, embedding array<float>, place string"


def brute(rows, k, least):
    one = {}
    for i, e, _ in rows:
        if i is not None and e is not None and len(e) == 16 and all(x is not None and x == x for x in e) and any(e):
            v = np.array(e, np.float32).astype(float)
            one[i] = v / np.linalg.norm(v)
    ids = sorted(one)
    x = np.stack([one[i] for i in ids])
    s = np.round(x @ x.T, 9)
    out = set()
    for a, i in enumerate(ids):
        best = sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i and s[a, b] >= least)
        out |= {(i, j) for _, j in best[:k]}
    return out


def data(n=600, clusters=40):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, 16))
    rows = [(i, [float(x) for x in centres[i % clusters] + 0.25 * rng.normal(size=16)], "mine") for i in range(n)]
    rows += [(n + k, rows[7][1], None) for k in range(9)]  # copies, more than k
    rows += [(2000, None, None), (2001, [], None), (2002, [0.0] * 16, None), (2003, [float("nan")] * 16, None), (2004, [1.0] * 5, None), (None, [1.0] * 16, None), rows[3]]
    return rows


def test_recall_and_exactness(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 0.8)
    for group_rows in (1 << 17, 200):  # the second spreads each table over several tasks
        got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, dim=16, k=5, least_cosine=0.8, group_rows=group_rows).collect()}
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_are_neighbours_in_id_order(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0], None) for i in range(10)] + [(50, [0.0, 1.0, 0.0, 0.0], None)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), dim=4, k=3).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    assert [j for _, j in sorted(got[0])] == [1, 2, 3] and [j for _, j in sorted(got[2])] == [0, 1, 3] and 50 not in got


def test_empty_and_plan(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), dim=16).count() == 0
    assert nearest_neighbours(spark.createDataFrame([(1, [1.0] * 16, None)], SCHEMA), dim=16).count() == 0
    width, tables, t = plan_tables(15_000_000, 128, 0.8, 0.97, 1 << 17)
    assert width == 20 and tables > 10 and t == 7


def test_recall_round_one_centre(spark):
    """Raw cosines just above the floor are found though many rows share a direction, so that the mean is far from zero."""
    rng = np.random.default_rng(11)
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)
    centre, n = unit(rng.normal(size=128)), 900
    for share in (1 / 3, 1.0):
        x = unit(rng.normal(size=(n, 128)))
        m = int(share * n)
        x[:m] = unit(np.sqrt(0.7) * centre + np.sqrt(0.3) * x[:m])  # of typical cosine 0.7
        g = x[rng.permutation(m)][rng.integers(0, m, n)]
        side = unit(g - (g * x).sum(axis=1, keepdims=True) * x + 1e-9 * rng.normal(size=x.shape))
        c = rng.uniform(0.805, 0.85, size=(n, 1))
        rows = [(i, [float(e) for e in v], None) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * side]))]
        unit_rows = np.array([r[1] for r in rows], np.float32).astype(float)
        s = np.round(unit(unit_rows) @ unit(unit_rows).T, 9)
        np.fill_diagonal(s, -1)
        want = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.8}
        got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), dim=128, k=5, least_cosine=0.8).collect()}
        assert len(want) >= 2 * n - 10 and len(got & want) >= 0.97 * len(want), (share, len(got & want), len(want))


def test_hot_buckets_are_compared_exactly(spark):
    """A third of the rows crowd round one centre in a few buckets: the same answers as by brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[:300] = rng.normal(size=16) * 3 + 0.03 * rng.normal(size=(300, 16))
    x[300:330] = x[0] + 0.5 * rng.normal(size=(30, 16))
    rows = [(i, [float(e) for e in v], None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 0.8)
    for hot_rows in (20, 64):
        got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, dim=16, k=5, least_cosine=0.8, hot_rows=hot_rows, group_rows=100).collect()}
        dense = {p for p in want if p[0] < 300}
        assert len(got & dense) >= 0.998 * len(dense) and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_a_crowd_of_equal_codes(spark):
    """20 000 different vectors of one code, whose pairs would be 200 million: no task lists them."""
    rng = np.random.default_rng(8)
    centre = np.r_[np.full(8, 3.0), np.full(8, -2.0)]
    x = centre + 1e-3 * rng.normal(size=(20_000, 16))
    df = spark.createDataFrame([(i, [float(e) for e in v], None) for i, v in enumerate(x)], SCHEMA)
    got = nearest_neighbours(df, dim=16, k=5, least_cosine=0.8).collect()
    assert len(got) == 100_000 and len({r["id"] for r in got}) == 20_000
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["neighbour"])
    for i in range(0, 20_000, 2_000):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        assert min(s[list(by[i])]) >= np.sort(s)[-5]


def test_best():
    c = np.array([[0.9, 0.9, 0.9, 0.5], [0.1, 0.95, 0.2, 0.85]])
    r, q = _best(c, 2, 0.8, np.array([7, 3, 5, 1]))
    assert list(zip(r.tolist(), q.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 3)]
