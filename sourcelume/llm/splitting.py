"""Splitting oversized items at natural boundaries.

One bounded-quantifier regex consumes an item piece by piece: its alternatives are ordered by the strength of the
boundary they end at (the end of the item, a blank line, a line end, a statement or sentence end, white space) and fall
back to plain characters. Lookback offsets, built with SQL array functions, give the overlap. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The line terminators of Python's ``str.splitlines``.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


#: Pieces whose line ends are added up together.
RUN = 256


def boundary_pattern(room: int, overlap: int = 0) -> str:
    """Java regex that takes at most ``room`` code points and ends at the strongest boundary found in the later part,
    else in the earlier one, else at a plain character. No piece is shorter than ``overlap``, which the next one repeats."""
    half, quarter = max(1, room // 2), max(1, room // 4)
    least = max(1, overlap)
    whole = r"(?!(?<=\r)\n)"  # never between CR and LF
    return (
        f"(?s).{{1,{room}}}\\z"
        f"|.{{{half},{room}}}(?<=\\n\\r?\\n){whole}"
        f"|.{{{quarter},{room}}}(?<=[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]){whole}"
        f"|.{{{quarter},{room}}}(?<=[;,.!?}}\\u3002\\uff01\\uff1f]|[;,.!?}}] )"
        f"|.{{{quarter},{room}}}(?<=\\s){whole}"
        f"|.{{{least},{room}}}(?<=[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]){whole}"
        f"|.{{{least},{room}}}(?<=[;,.!?}}\\u3002\\uff01\\uff1f]|[;,.!?}}] )"
        f"|.{{{least},{room}}}(?<=\\s){whole}"
        f"|.{{1,{room}}}{whole}"
        f"|.{{1,{room}}}"
    )


def _line_ends(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(LINE_END), F.lit(0)))


def split_oversized(
    df: DataFrame,
    limit: int = 2000,
    overlap: int = 200,
    content: str = "content",
    group: str = "file_id",
    order: str = "chunk_index",
    block: int = 4096,
) -> DataFrame:
    """Each row with more than ``limit`` code points becomes pieces of at most ``limit``; the others stay as they are.

    Every piece but an item's first begins with the last ``overlap`` code points of the piece before it, so dropping
    these and joining the pieces gives the item back. Added columns: ``piece`` (from 0), ``pieces``, ``overlap_chars``;
    ``start_line``/``end_line`` become the piece's own (null where the item's start is null), ``chunk_index`` is
    renumbered over the pieces of a group. A null or empty content is one piece, unchanged. Equal (group, order) rows are
    numbered in no stated order. Other columns are kept; an input that already has one of the added names loses it.

    Renumbering needs how many pieces lie before an item in its group. That is a prefix sum over (group, order) in
    two levels, blocks of ``block`` successive order values and the items of one block, so that a group holding a third
    of all rows is not sorted in one task.
    """
    if overlap < 0 or limit < 8 or overlap >= limit // 4:
        raise ValueError("overlap must be under a quarter of the limit, the limit at least 8")
    room = limit - overlap
    keep = [c for c in df.columns if c not in ("piece", "pieces", "overlap_chars", "chunk_index", "start_line", "end_line")]
    big = F.length(F.col(content)) > limit
    parts = F.when(big, F.regexp_extract_all(F.col(content), F.lit(boundary_pattern(room, overlap)), F.lit(0))).otherwise(F.array(F.col(content)))
    items = df.withColumn("__parts", parts).withColumn("pieces", F.size("__parts"))

    # pieces added by earlier items of the group; a block's list holds at most ``block`` order values
    slot = F.floor(F.col(order) / block)
    light = items.select(F.col(group).alias("__g"), slot.alias("__b"), F.col(order).alias("__o"), (F.greatest(F.col("pieces"), F.lit(1)) - 1).alias("__n"))
    values = light.groupBy("__g", "__b", "__o").agg(F.sum("__n").alias("__n"))
    blocks = values.groupBy("__g", "__b").agg(
        F.sum("__n").alias("__sum"), F.collect_list(F.when(F.col("__n") > 0, F.struct("__o", "__n"))).alias("__in")
    )
    ahead = W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__g", "__b", "__in", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__earlier"))
    blocks = blocks.where((F.col("__earlier") > 0) | (F.size("__in") > 0))
    items = items.join(blocks, items[group].eqNullSafe(blocks["__g"]) & slot.eqNullSafe(blocks["__b"]), "left")
    inside = F.aggregate("__in", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["__o"] < F.col(order), x["__n"]).otherwise(0))
    items = items.withColumn("__base", F.col(order) + F.coalesce(F.col("__earlier") + inside, F.lit(0)))

    # what a piece needs of the ones before it is put beside it before they part, so that no row carries the whole item
    items = items.withColumn("__ends", F.transform("__parts", lambda p: F.when(F.col("pieces") > 1, _line_ends(p)).otherwise(0)))
    # line ends before every run of ``RUN`` pieces, so that a piece adds up its own run only
    plus = lambda a, x: a + x
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("__ends") - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice("__ends", r * RUN + 1, F.lit(RUN)), F.lit(0), plus))
    items = items.withColumn("__runs", F.when(F.size("__ends") > RUN, runs).otherwise(F.array(F.lit(0))))
    items = items.withColumn("__before", F.when(F.size("__runs") > 1, F.transform(F.sequence(F.lit(0), F.size("__runs") - 1), lambda r: F.aggregate(F.slice("__runs", F.lit(1), r), F.lit(0), plus))).otherwise(F.array(F.lit(0))))

    def piece(part: Column, i: Column) -> Column:
        lookback = F.when(i > 0, F.right(F.element_at("__parts", i), F.lit(overlap))).otherwise(F.lit("")) if overlap else F.lit("")
        run = F.floor(i / RUN).cast("int")
        before = F.element_at("__before", run + 1) + F.aggregate(F.slice("__ends", run * RUN + 1, i - run * RUN), F.lit(0), plus)
        return F.struct(part.alias("part"), lookback.alias("head"), before.alias("before"))

    rest = [c for c in keep if c != content]
    out = items.select(*rest, order, "start_line", "end_line", "pieces", "__base", F.posexplode_outer(F.transform("__parts", piece)).alias("__i", "__x"))
    i = F.coalesce(F.col("__i"), F.lit(0))
    out = out.withColumns({"__part": F.col("__x.part"), "__head": F.coalesce(F.col("__x.head"), F.lit(""))})
    out = out.withColumn("__first", F.col("start_line") + F.coalesce(F.col("__x.before"), F.lit(0)) - F.when(i > 0, _line_ends(F.col("__head"))).otherwise(0))
    text = F.when(F.col("pieces") > 1, F.concat("__head", "__part")).otherwise(F.col("__part"))
    # the last line of a piece: a line end that closes the piece opens no further line
    inner = _line_ends(F.regexp_replace(F.concat("__head", "__part"), f"(?:{LINE_END})\\z", ""))
    return out.select(
        *[F.col(c) if c != content else text.alias(content) for c in keep],
        (F.col("__base") + i).cast("int").alias("chunk_index"),
        F.when(F.col("pieces") > 1, F.col("__first")).otherwise(F.col("start_line")).cast("int").alias("start_line"),
        F.when(F.col("pieces") > 1, F.col("__first") + inner).otherwise(F.col("end_line")).cast("int").alias("end_line"),
        i.alias("piece"),
        F.col("pieces"),
        F.when(F.col("pieces") > 1, F.length("__head")).otherwise(0).alias("overlap_chars"),
    )
