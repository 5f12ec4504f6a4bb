"""Mixing sources to target shares of tokens, by systematic sampling.

The expected copies of a source's documents are summed up in order of size, one random offset is added, and a document is
emitted once for each integer boundary that its step crosses. Ordered by size, such a sample misses its tokens by one of
the larger documents at most. So that these do not decide, a source is taken in two parts with the same offset: the larger
documents first, all with the copies that the share asks for; then the smallest ones, with the copies that bring the source
to its share whatever the first part gave. A document that alone is a large part of the goal can only spoil it: it gets the
whole copies that are due to every document, and no chance of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .tokens import DEFAULT, n_tokens

#: Cells over which the documents of one source and size are spread to be numbered.
CELLS = 1024


def _before(value: str, *by: str, order: str) -> Column:
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _crossed(low: Column, high: Column, rate: Column, offset: Column) -> Column:
    """Integer boundaries between the sums of expected copies before and after."""
    return F.floor(high * rate + offset) - F.floor(low * rate + offset)


def plan_sizes(sizes: DataFrame, goal: DataFrame, source: str, seed: int, whole: float = 0.25) -> DataFrame:
    """For each ``(source, tokens)`` how its ``n`` documents are sampled: ``rate`` (expected copies), ``first`` (documents
    of its part before it) and ``offset``. ``goal`` has ``source, goal, have, most``.

    One row a source and size: as many as the longest text has tokens, however many documents there are.
    """
    rows = sizes.join(F.broadcast(goal), source).withColumn("even", F.col("goal") / F.col("have")).withColumn("mass", F.col("n") * F.col("tokens"))
    rows = rows.withColumn("floor", F.floor(F.col("even") + 1e-9).cast("double"))
    # documents too large for a chance, where the others come nearer to the goal without one more of them; otherwise all are
    # sampled
    huge = (F.col("tokens") > F.col("goal") * whole) & (F.col("even") < F.col("most") - 1e-9)
    every = W.partitionBy(source)
    rows = rows.withColumn("apart", F.coalesce(F.sum(F.when(huge, F.col("mass"))).over(every), F.lit(0)))
    rest = (F.col("goal") - F.col("floor") * F.col("apart")) / F.nullif(F.col("have") - F.col("apart"), F.lit(0))
    short = F.col("goal") - F.col("floor") * F.col("apart") - F.col("most") * (F.col("have") - F.col("apart"))
    nearer = F.coalesce((short < F.min(F.when(huge, F.col("tokens"))).over(every) / 2) & (F.col("have") > F.col("apart")), F.lit(False))
    rows = rows.withColumn("rest", F.least(rest, F.col("most").cast("double"))).withColumn("nearer", nearer)
    rows = rows.withColumn("part", F.when(huge & F.col("nearer"), "whole").otherwise("large")).withColumn("even", F.when(F.col("nearer"), F.col("rest")).otherwise(F.col("even")))
    # the smallest documents, until they can make up for the largest that is sampled, in either direction
    largest = F.max(F.when(F.col("part") == "large", F.col("tokens"))).over(W.partitionBy(source))
    slack = F.greatest(F.least(F.col("even"), F.col("most") - F.col("even")), F.lit(0.05))
    rows = rows.withColumn("need", largest / slack)
    rows = rows.withColumn("held", _before("mass", source, order="tokens")).withColumn("part", F.when((F.col("part") == "large") & (F.col("held") < F.col("need")), "small").otherwise(F.col("part")))
    rows = rows.withColumn("first", _before("n", source, "part", order="tokens"))
    offset = F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("offset", offset)
    sure = F.when(F.col("part") == "whole", F.col("floor") * F.col("n")).when(F.col("part") == "large", _crossed(F.col("first"), F.col("first") + F.col("n"), F.col("even"), F.col("offset")))
    left = rows.groupBy(source).agg(F.sum(F.col("tokens") * F.coalesce(sure, F.lit(0))).alias("given"), F.sum(F.when(F.col("part") == "small", F.col("mass"))).alias("room"))
    rows = rows.join(left, source)
    small = F.least(F.greatest((F.col("goal") - F.col("given")) / F.col("room"), F.lit(0.0)), F.col("most").cast("double"))
    rate = F.when(F.col("part") == "whole", F.col("floor")).when(F.col("part") == "small", F.coalesce(small, F.lit(0.0))).otherwise(F.col("even"))
    return rows.select(source, "tokens", "first", "offset", "most", rate.alias("rate"))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = DEFAULT, total_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """``(key, source, tokens, copy)``: one row for each use of a document, ``copy`` from 1 to at most ``max_repeats``.

    ``targets`` has ``source, target_share, max_repeats``. The mixture is as large as the shares and repeats allow, or of
    ``total_tokens`` where that is less. Null texts, and sources without a target or with a share or repeat of 0, are left
    out; a target whose source has no tokens is left out of the total, as nothing can meet it. Rows that repeat count each.

    A document's place within its source is found in three levels: sizes, cells of a hash within a size, and the rows of a
    cell. No window holds more than the sizes of a source, the cells of a size or the rows of a cell, so a source that has
    most rows is not sorted in one task.
    """
    sized = docs.where(F.col(text).isNotNull()).select(key, source, n_tokens(F.col(text), tokenizer).alias("tokens"))
    sized = cut_lineage(sized.select(key, source, "tokens", F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("cell")))
    cells = sized.groupBy(source, "tokens", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(source, "tokens").agg(F.sum("n").alias("n"))
    goal = targets.where("target_share > 0 and max_repeats > 0").groupBy(source).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    # a row a source
    have = sizes.groupBy(source).agg(F.sum(F.col("tokens") * F.col("n")).alias("have")).where("have > 0").join(goal, source)
    room = have.agg(F.min(F.col("most") * F.col("have") / F.col("share"))).first()[0]
    size = float(room or 0.0) if total_tokens is None else min(float(room or 0.0), float(total_tokens))
    plan = plan_sizes(sizes, have.select(source, "most", "have", (F.lit(size) * F.col("share")).alias("goal")), source, seed)
    cells = cells.withColumn("ahead", _before("n", source, "tokens", order="cell")).drop("n").join(plan, [source, "tokens"])
    inside = F.row_number().over(W.partitionBy(source, "tokens", "cell").orderBy(key))
    ranked = sized.withColumn("inside", inside).join(cells, [source, "tokens", "cell"])
    at = F.col("first") + F.col("ahead") + F.col("inside")
    copies = F.least(_crossed(at - 1, at, F.col("rate"), F.col("offset")).cast("int"), F.col("most").cast("int"))
    used = ranked.withColumn("copies", copies).where("copies > 0")
    return used.select(key, source, "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def share_report(mixed: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """For each target: the share aimed at and reached, tokens, uses, and how often the most used document comes."""
    got = mixed.groupBy(source).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_used"))
    # a report row per source: the total is one number, taken over the few rows of the report
    whole = got.agg(F.sum("tokens")).first()[0] or 0
    out = targets.select(source, "target_share", "max_repeats").join(got, source, "left")
    share = F.round(F.coalesce("tokens", F.lit(0)) / F.lit(float(max(whole, 1))), 6)
    return out.select(source, "target_share", share.alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats")
