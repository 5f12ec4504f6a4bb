import hashlib
import itertools
import random
import re

from sourcelume.llm.near_duplicates import duplicate_groups, duplicate_pairs, pairs_of_copies

SCHEMA = "id int, content string, content_sha string, similarity string"


def rows_of(texts):
    return [(i, t, hashlib.sha256((t or "").encode()).hexdigest(), "x") for i, t in enumerate(texts)]


def brute(rows, t, n=5, least=50):
    sets = {}
    for i, text, _, _ in rows:
        w = re.findall(r"[A-Za-z0-9_]+", text or "")
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    text = {r[0]: r[2] for r in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if text[a] != text[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    head = " ".join(f"licence{i}" for i in range(30))  # in every text: hot n-grams
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 3)] = [f"n{rng.randrange(10**6)}"]
            texts.append(" ".join(w))
        else:
            texts.append(head + " " + " ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(40, 200))))
    return texts + [texts[0], texts[0], texts[1], None, "", "short text", " ".join(["same"] * 80)]


def test_pairs_match_brute_force(spark):
    rows = rows_of(corpus())
    files = spark.createDataFrame(rows + rows[:2], SCHEMA)
    for options in ({}, {"block": 8, "extra": 0.2}):  # small blocks: hot n-grams are spread over pairs of blocks
        got = {(r["id_a"], r["id_b"]) for r in pairs_of_copies(*duplicate_pairs(files, 0.7, **options)).collect()}
        assert got == brute(rows, 0.7)


def test_groups(spark):
    rows = rows_of(corpus(5, 60))
    pairs = brute(rows, 0.8)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    same = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and a[1] is not None and b[1] is not None]
    for a, b in [*pairs, *same]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["class_id"] for r in duplicate_groups(spark.createDataFrame(rows, SCHEMA), 0.8).collect()}
    assert got == {r[0]: find(r[0]) for r in rows}


def test_empty(spark):
    assert duplicate_pairs(spark.createDataFrame([], SCHEMA), 0.7)[0].count() == 0
    assert duplicate_groups(spark.createDataFrame(rows_of([None, "a"]), SCHEMA), 0.7).count() == 2


def test_copies_are_members_not_pairs(spark):
    """Two similar texts with many copies each make one pair; a text counts once a task however many copies it has."""
    from sourcelume.llm.near_duplicates import _cells, _counts, shingle_hashes
    from sourcelume.llm.counting import summed_cells
    import numpy as np
    from pyspark.sql import functions as F

    one = " ".join(f"w{i}" for i in range(100))
    two = one.replace("w50", "changed")
    rows = rows_of([one] * 400 + [two] * 300 + [" ".join(f"z{i}" for i in range(80))])
    files = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pairs, members = duplicate_pairs(files, 0.7)
    assert pairs.count() == 1 and members.count() == 701 and pairs_of_copies(pairs, members).count() == 120_000
    got = summed_cells(files.select("content", F.xxhash64("content_sha").alias("doc")), _counts(16, 5, 50), 16)
    cells = _cells(shingle_hashes([one], 5, 50)[0] >> np.uint64(24), 16)
    assert got[cells].min() >= 1 and got[cells].max() <= 12
