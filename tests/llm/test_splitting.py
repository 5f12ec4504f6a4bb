import random

from sourcelume.llm.splitting import split_oversized

SCHEMA = "id long, file_id int, chunk_index int, content string, start_line int, end_line int, piece string"


def pieces_of(spark, rows, **kw):
    out: dict[int, list] = {}
    for r in split_oversized(spark.createDataFrame(rows, SCHEMA), **kw).collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def test_round_trip_lines_and_numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        text = "".join(rng.choice(["a", "bc ", "é", "\U0001f600", "x;", "\n", "\r\n", "\n\n", "\r", " ", ".", "z" * 30]) for _ in range(rng.randrange(0, 500)))
        rows.append((i, i % 3, i // 3, text, 10, 10 + max(0, len(text.splitlines()) - 1), "mine"))
    rows += [(100, 0, 50, None, None, None, None), (101, 0, 51, "", 1, 1, None), (102, 1, 60, "w" * 1000, None, None, None), (103, None, 0, "v " * 300, 1, 1, None)]
    got = pieces_of(spark, rows, limit=100, overlap=20, block=4)
    for i, _, _, text, first, _, _ in rows:
        ps = got[i]
        assert [p["piece"] for p in ps] == list(range(len(ps))) and {p["pieces"] for p in ps} == {len(ps)}
        if text is None:
            assert ps[0]["content"] is None
            continue
        assert "".join(p["content"][p["overlap_chars"] :] for p in ps) == text
        assert all(len(p["content"]) <= 100 for p in ps)
        assert all(p["overlap_chars"] == 20 and q["content"].endswith(p["content"][:20]) for q, p in zip(ps, ps[1:]))
        if first is None:
            assert all(p["start_line"] is None for p in ps)
        elif len(ps) > 1:
            at = 0
            for p in ps:
                s = at - p["overlap_chars"]
                start = first + len((text[:s] + "x").splitlines()) - 1 - (text[s - 1 : s + 1] == "\r\n" and s > 0)
                assert (p["start_line"], p["end_line"]) == (start, first + len(text[: s + len(p["content"])].splitlines()) - 1)
                at = s + len(p["content"])
    for f in (0, 1, 2, None):
        order = sorted((r[2], r[0]) for r in rows if r[1] == f)
        numbers = [p["chunk_index"] for _, i in order for p in got[i]]
        assert numbers == sorted(numbers) and len(set(numbers)) == len(numbers)


def test_boundaries(spark):
    text = "line one\n\n" + "word " * 14 + "\n\n" + "y" * 90
    ps = pieces_of(spark, [(1, 1, 0, text, 1, 5, None)], limit=100, overlap=10)[1]
    assert ps[0]["content"].endswith("\n\n")


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert split_oversized(empty).count() == 0
    rows = [(1, 1, 0, "a b " * 100, 1, 1, None)] * 2
    assert split_oversized(spark.createDataFrame(rows, SCHEMA), limit=100, overlap=10).count() == 2 * len(pieces_of(spark, rows[:1], limit=100, overlap=10)[1])


def test_early_boundary_before_plain_character(spark):
    for early in ("line one\n", "one; two;", "some words "):
        run = "y" * 90
        text = early + run + "\n" + "more words " * 6
        ps = pieces_of(spark, [(1, 1, 0, text, 1, 5, None)], limit=100, overlap=5)[1]
        assert ps[0]["content"] == early and any(run in p["content"] for p in ps)
        assert "".join(p["content"][p["overlap_chars"] :] for p in ps) == text


def test_very_long_item(spark):
    """Thousands of pieces: each knows the lines before it, and the work grows with the pieces, not their square."""
    text = "".join(f"line {i}\n" for i in range(12_000))
    ps = pieces_of(spark, [(1, 1, 0, text, 1, 12_000, None)], limit=40, overlap=5)[1]
    assert len(ps) > 3_000 and "".join(p["content"][p["overlap_chars"] :] for p in ps) == text
    at = 0
    for p in ps:
        s = at - p["overlap_chars"]
        assert p["start_line"] == 1 + text.count("\n", 0, s)
        at = s + len(p["content"])
