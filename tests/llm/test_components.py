from sourcelume.llm.components import connected_components


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (5, 5), (None, 3), (200, 100)], "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in (100, 101, 102, 200)} == {100} and len(got) == 64
    assert connected_components(e.limit(0), "a", "b").count() == 0
