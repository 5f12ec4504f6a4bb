import random

import numpy as np

from sourcelume.llm.leximin import block_words, leximin_rank, rank_for_queries


def test_rank_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 1e9, -3.0, None, float("nan"), float("inf")]), rng.random() if i % 5 else 0.5, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, s1 double, s2 double, rank string")
    out = {r["id"]: r for r in leximin_rank(df, ["s1", "s2"], "id", ["g"]).collect()}
    for g in ("a", "b", None):
        mine = [r for r in rows if r[1] == g]
        val = lambda x: float("-inf") if x is None or x != x else x
        place = lambda k, r: 1 + sum(val(o[k]) > val(r[k]) for o in mine)
        key = lambda r: sorted((len(mine) - place(k, r)) / (len(mine) - 1) for k in (2, 3))
        want = sorted(mine, key=lambda r: ([-x for x in key(r)], r[0]))
        assert [r[0] for r in want] == [i for i, _ in sorted(((r[0], out[r[0]]["rank"]) for r in mine), key=lambda x: x[1])]
    assert leximin_rank(df.limit(0), ["s1"], "id").count() == 0
    whole = leximin_rank(df.select("id", "s2"), ["s2"], "id").collect()
    assert sorted(r["rank"] for r in whole) == list(range(1, 201))


def test_queries_against_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    chunks = []
    for i in range(300):
        e = [float(x) for x in rng.normal(size=8)]
        ts = " ".join(f"'{w}':{','.join(str(k) for k in range(1, 1 + rng.integers(1, 4)))}" for w in rng.choice(words, 3, replace=False))
        chunks.append((i, e, ts, "extra"))
    chunks += [(300, None, "'w1':1", None), (301, [0.0] * 8, "'w1':1", None), (302, [float("nan")] * 8, "'w1':1", None), (303, [1.0] * 3, "'w1':1", None), (304, [1.0] * 8, None, None), (305, [1.0] * 8, "", None)]
    chunks += [chunks[0], chunks[5]]
    queries = [(1, "w1 w2", [float(x) for x in rng.normal(size=8)]), (2, "W3  w3", [float(x) for x in rng.normal(size=8)]), (3, "nothing", [float(x) for x in rng.normal(size=8)]), (4, "w1", None), (5, "", [1.0] * 8)]
    c = spark.createDataFrame(chunks, "chunk_id int, embedding array<float>, ts string, rank string")
    q = spark.createDataFrame(queries, "query_id int, query_text string, query_embedding array<float>")
    got = {}
    for r in rank_for_queries(c, q, 5, dim=8, block_queries=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    ok = {}
    for i, e, ts, _ in chunks:
        if e is not None and len(e) == 8 and all(x == x for x in e) and any(e) and ts is not None:
            tf = {p.split("':")[0][1:]: p.count(",") + 1 for p in ts.split(" ") if p}
            v = np.array(e, np.float32).astype(float)
            ok[i] = (v / np.linalg.norm(v), tf)
    assert set(got) == {1, 2, 3, 5}
    for qid, text, qe in queries:
        if qe is None:
            continue
        qv = np.array(qe, np.float32).astype(float)
        qv /= np.linalg.norm(qv)
        cos = {i: round(float(v @ qv), 9) for i, (v, _) in ok.items()}
        hits = {i: sum(tf.get(w, 0) for w in set(text.lower().split())) for i, (_, tf) in ok.items()}
        pc = {i: 1 + sum(x > cos[i] for x in cos.values()) for i in ok}
        ph = {i: 1 + sum(x > hits[i] for x in hits.values()) for i in ok}
        want = sorted(ok, key=lambda i: (max(pc[i], ph[i]), min(pc[i], ph[i]), i))[:5]
        assert [got[qid][k] for k in range(1, 6)] == want
    assert rank_for_queries(c.limit(0), q, 5, dim=8).count() == 0 and rank_for_queries(c, q.limit(0), 5, dim=8).count() == 0


def test_a_word_that_most_rows_have(spark):
    """Rows with the same number of hits are not candidates beyond the first k, so a hot word makes none of the steps grow;
    the ranking stays that of brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    n = [int(1 + i % 3) if i % 10 else 0 for i in range(3000)]
    rows = [(i, [float(e) for e in x[i]], f"'hot':{','.join(map(str, range(1, n[i] + 1)))} 'rest':9" if n[i] else "'rest':9", "") for i in range(3000)]
    c = spark.createDataFrame(rows, "chunk_id int, embedding array<float>, ts string, hits string").repartition(5)
    q = spark.createDataFrame([(1, "hot", [1.0] * 8), (2, "Rest hot", [-1.0, 1.0] * 4)], "query_id int, query_text string, query_embedding array<float>")
    got = {}
    for r in rank_for_queries(c, q, 5, dim=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for qid, v, more in ((1, np.ones(8), 0), (2, np.array([-1.0, 1.0] * 4), 1)):
        cos = np.round(u @ (v / np.linalg.norm(v)), 9)
        hits = np.array(n) + more
        pc = 1 + (cos[None, :] > cos[:, None]).sum(axis=1)
        ph = 1 + (hits[None, :] > hits[:, None]).sum(axis=1)
        want = sorted(range(3000), key=lambda i: (max(pc[i], ph[i]), min(pc[i], ph[i]), i))[:5]
        assert [got[qid][k] for k in range(1, 6)] == want


def test_block_words():
    words, starts, of = block_words(["b a  A", None, "a", ""])
    assert words == ["a", "b"] and [of[starts[i] : starts[i + 1]].tolist() for i in range(2)] == [[0, 2], [0]]
    assert block_words([None, " "])[0] == []
