import random

from sourcelume.llm.counting import summed_cells
from sourcelume.llm.truncation import field_limits, make_cut, truncated, truncation_rates

SCHEMA = "doc_id long, text string, source string, score string"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    nouns, verbs = [f"{a}{b}" for a in ("led", "mar", "quer", "tok", "ind") for b in ("ger", "gin", "ry", "en", "exes")], ["keeps", "reads", "drops", "sends", "opens"]
    rows, cut = [], set()
    for i in range(n):
        source = rng.choice(["issue", "note", "log"])
        text = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} when the {rng.choice(nouns)} is full." for _ in range(rng.randrange(1, 12)))
        if source == "note" and rng.random() < 0.4:
            text = f"fix({rng.choice(nouns)}): {rng.choice(verbs)} {rng.choice(nouns)}"
        if source == "log" and rng.random() < 0.3:
            text += "\n\n- " + "\n- ".join(f"{rng.choice(verbs)} the {rng.choice(nouns)}" for _ in range(3))
        limit = {"issue": 300, "note": 200, "log": 10**9}[source]
        if len(text) > limit and rng.random() < 0.4:
            text = text[:limit]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif len(text) > 60 and rng.random() < 0.04:
            text = text[: rng.randrange(20, len(text) - 4)]
            if text.rstrip()[-1] != "." and not text.startswith("fix"):
                cut.add(i)
        rows.append((i, text, source, "mine"))
    return rows, cut


def test_finds_cut_texts(spark):
    rows, cut = corpus()
    out = truncated(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"] for r in out.where("cut").collect()}
    assert len(got & cut) >= 0.85 * len(cut) and len(got - cut) <= 0.1 * len(got), (len(cut), len(got), len(got & cut))
    rates = {r["source"]: (r["texts"], r["cut"]) for r in truncation_rates(out).collect()}
    assert sum(t for t, _ in rates.values()) == len(rows) and sum(c for _, c in rates.values()) == len(got)


def test_odd_rows(spark):
    rows, _ = corpus(200, 2)
    rows += [(900, None, "issue", None), (901, "", "issue", None), (902, "  \n", None, None), (903, "word " * 60_000, None, None), (0, rows[0][1], rows[0][2], None)]
    out = truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r["doc_id"]: r["cut"] for r in out}
    assert 900 not in by and by[901] is False and by[902] is False and len(out) == len(rows) - 1
    assert truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_fall_inside_sentences():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        text = "One sentence is here. Another follows it, longer than the first.\n\nEnd of it."
        c = make_cut(text, [30], rng)
        assert c is None or text[: c[1]].rstrip()[-1] != "."


def test_limits_of_any_length(spark):
    """A limit is found however short it is and however many a source has; a usual length is none, nor are copies of a text."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, word(72 if i % 2 else rng.randrange(30, 200)), "short", "") for i in range(600)]
    rows += [(1000 + i, word(rng.choice([28, 29, 30, 31, 32])), "titles", "") for i in range(500)]
    limits = [50 + 90 * k for k in range(12)]
    rows += [(2000 + i, word(rng.choice(limits) if i % 2 else rng.randrange(20, 1300)), "many", "") for i in range(2400)]
    rows += [(9000 + i, "the same text again and again, posted under many ids", "copies", "") for i in range(300)]
    got = field_limits(spark.createDataFrame(rows, SCHEMA), "text", "source")
    assert [n for s, n in got if s == "short"] == [72] and [n for s, n in got if s == "many"] == limits and not [s for s, _ in got if s in ("titles", "copies")]


def test_summed_cells(spark):
    import numpy as np

    def cells(batches):
        for b in batches:
            yield b.column(0).to_numpy() % 5000

    got = summed_cells(spark.range(0, 100_000, 1, 7), cells, 13)
    assert got.shape == (1 << 13,) and (got[:5000] == 20).all() and not got[5000:].any()
    assert not summed_cells(spark.range(0), cells, 12).any() and np.issubdtype(got.dtype, np.integer)
