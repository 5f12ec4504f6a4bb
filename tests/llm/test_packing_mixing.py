import random

import numpy as np
import pytest

from sourcelume.llm.mixing import mixture, share_report
from sourcelume.llm.packing import fill, fill_report, hilbert_keys, pack_documents
from sourcelume.llm.tokens import counter, n_tokens

DOC = "doc_id long, text string, source string, tokens string"


def docs(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "Index", "the"]) for _ in range(int(rng.expovariate(1 / 60)))), rng.choice("aaaaaabbc"), "mine") for i in range(n)]
    return rows + [(n, "word " * 3000, "a", None), (n + 1, "", "b", None), (n + 2, None, "c", None), (n + 3, "same text", "c", None), (n + 4, "same text", "c", None), (n + 5, "no source", None, None)]


def test_hilbert_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = grid[np.argsort(hilbert_keys(grid, 3))]
    assert len(set(hilbert_keys(grid, 3).tolist())) == 64 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_fill():
    sizes = [random.Random(2).randrange(1, 100) for _ in range(500)]
    bins = fill(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(sizes[i] for i in b) for b in bins) <= 100 and len(bins) <= 1.03 * sum(sizes) / 100 + 1


def test_packing(spark):
    rows = docs()
    df = spark.createDataFrame(rows, DOC)
    out = pack_documents(df, [("s", 128), ("m", 1000)], window=6, keep=3).collect()
    size = dict(zip([r[0] for r in rows if r[1] is not None], counter()([r[1] for r in rows if r[1] is not None])))
    for name, cap in (("s", 128), ("m", 1000)):
        mine = [r for r in out if r["name"] == name]
        per, bins = {}, {}
        for r in mine:
            per.setdefault(r["doc_id"], []).append(r)
            bins[r["container_id"]] = bins.get(r["container_id"], 0) + r["tokens"]
        assert {d: sum(r["tokens"] for r in rs) for d, rs in per.items()} == size and max(bins.values()) <= cap
        assert all(len(rs) == 1 for d, rs in per.items() if size[d] <= cap)
        for d, rs in per.items():
            rs.sort(key=lambda r: r["piece"])
            assert [r["first_token"] for r in rs] == [i * cap for i in range(len(rs))]
    report = {r["name"]: r["fill"] for r in fill_report(pack_documents(df, [("s", 128), ("m", 1000)])).collect()}
    assert report["s"] > 0.9 and report["m"] > 0.85
    empty = spark.createDataFrame([(i, "", "a", None) for i in range(70_000)] + [(-1, "one word", "a", None)], DOC)
    assert pack_documents(empty.coalesce(1), [("s", 128)]).agg({"doc_id": "count"}).first()[0] == 70_001  # without tokens a window still ends
    assert pack_documents(df.limit(0), [("s", 128)]).count() == 0 and pack_documents(df, []).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, [("s", 0)])


def test_neighbours_share_containers(spark):
    """Documents of one kind lie together on the curve and so in containers; sizes alone would mix the kinds."""
    rng = random.Random(6)
    words = [[f"{a}{i}" for i in range(12)] for a in ("ka", "lo", "mi", "nu")]
    rows = [(i, " ".join(rng.choice(words[i % 4]) for _ in range(rng.randrange(10, 90))), "a", None) for i in range(3000)]
    out = pack_documents(spark.createDataFrame(rows, DOC), [("m", 500)])  # a window is about a twelfth of the curve
    report = fill_report(out).first()
    assert report["fill"] > 0.98 and report["curve_spread"] < 0.2
    kinds = {}
    for r in out.collect():
        kinds.setdefault(r["container_id"], []).append(r["doc_id"] % 4)
    same = sum(max(map(k.count, range(4))) for k in kinds.values())
    assert same > 0.6 * len(rows)


def test_large_documents_do_not_decide_shares(spark):
    """A source that is mostly one huge document, one of few documents, and one that is scarce: all reach their shares."""
    rng = random.Random(9)
    word = lambda n: " ".join(["word"] * n)
    rows = [(i, word(rng.randrange(2, 60)), "giant", None) for i in range(500)] + [(500, word(30_000), "giant", None)]
    rows += [(1000 + i, word(rng.randrange(5, 400)), "plain", None) for i in range(400)] + [(2000 + i, word(rng.randrange(100, 300)), "few", None) for i in range(20)]
    df = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("giant", 0.2, 1), ("plain", 0.5, 1), ("few", 0.3, 4)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        for total in (None, 12_000):
            report = {r["source"]: r["actual_share"] for r in share_report(mixture(df, targets, seed=seed, total_tokens=total), targets).collect()}
            assert all(abs(report[s] - x) < 0.02 for s, x in (("giant", 0.2), ("plain", 0.5), ("few", 0.3))), (seed, total, report)


def test_systematic_sampling_gives_every_document_its_chance(spark):
    """Over many offsets a document is used as often as its share asks for."""
    rows = [(i, " ".join(["word"] * (5 + i % 40)), "a", None) for i in range(400)]
    df, targets = spark.createDataFrame(rows, DOC), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses = {}
    for seed in range(12):
        for r in mixture(df, targets, seed=seed, total_tokens=3000).collect():
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    rate = 3000 / sum(5 + i % 40 for i in range(400))
    large = [uses.get(i, 0) for i in range(400) if i % 40 > 20]
    assert abs(sum(large) / len(large) / 12 - rate) < 0.12 and max(uses.values()) <= 12 and len(uses) > 300


def test_mixture(spark):
    rows = docs(2000, 3)
    df = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 1), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mixture(df, targets)
    got = out.collect()
    used = {}
    for r in got:
        used.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= cap[s] for (s, _), c in used.items())
    report = {r["source"]: r for r in share_report(out, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s]["actual_share"] - share) < 0.02
    assert report["absent"]["uses"] == 0
    # the mixture is as large as the scarcest source allows
    assert any(report[s]["tokens"] > 0.93 * cap[s] * sum(counter()([r[1] for r in rows if r[1] is not None and r[2] == s])) for s in "abc")
    small = mixture(df, targets, total_tokens=5000).agg({"tokens": "sum"}).first()[0]
    assert 3000 < small < 7000
    assert mixture(df.limit(0), targets).count() == 0 and mixture(df, targets.limit(0)).count() == 0
    assert {(r["doc_id"], r["copy"]) for r in mixture(df, targets).collect()} == {(r["doc_id"], r["copy"]) for r in got}


def test_tokens(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "日本語 <|endoftext|>")]
    got = {r["i"]: r["n"] for r in spark.createDataFrame(rows, "i int, t string").select("i", n_tokens(F.col("t")).alias("n")).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 3
