"""The queries of this package and, where SQL can state them over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from ..sources.tables import spread, table
from .credentials import credential_lines, redacted
from .foreign_source import files_to_set_aside
from .invalid_source import error_rates, parse_errors
from .knn import nearest_neighbours
from .leximin import rank_for_queries
from .mixing import mixture, share_report
from .near_duplicates import duplicate_groups, duplicate_pairs, pairs_of_copies
from .oracles import oracle_sql
from .packing import fill_report, pack_documents
from .splitting import split_oversized
from .truncation import truncated, truncation_rates


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    return parse_errors(spread(table(spark, sf, "files").select("id", "repo_id", "lang", "content")), ["id", "repo_id"]).dropDuplicates(["id"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    errors = parse_errors(spread(table(spark, sf, "files").select("id", "repo_id", "lang", "content")), ["id"])
    return errors.where("error_line IS NOT NULL").select(F.col("id").alias("file_id")).distinct()


def p1_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf).where("error_line IS NOT NULL").select(F.col("id").alias("file_id"), "repo_id", "lang", "error_line")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return error_rates(_errors(spark, sf), "repo_id", "lang")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "chunks").select("id", "file_id", "chunk_index", "content", "start_line", "end_line"))
    return pieces.where("pieces > 1").select(F.col("id").alias("chunk_id")).distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "chunks").select("id", "file_id", "chunk_index", "content", "start_line", "end_line"))
    return pieces.select(F.col("id").alias("chunk_id"), "file_id", "chunk_index", "piece", "pieces", "start_line", "end_line", "overlap_chars", "content")


def p2_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk put together again from its pieces, and whether these keep the limit, are numbered and overlap as stated."""
    rows = p2_pieces(spark, sf).dropDuplicates(["chunk_id", "piece"])
    own = F.substring("content", F.col("overlap_chars") + 1, F.length("content"))
    each = F.struct("piece", own.alias("own"), F.when(F.col("overlap_chars") > 0, F.left("content", F.col("overlap_chars"))).alias("head"))
    parts = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(each)).alias("p"), F.max("pieces").alias("pieces"), F.max(F.length("content")).alias("longest"))
    text = F.when(F.exists("p", lambda x: x["own"].isNotNull()), F.array_join(F.transform("p", lambda x: x["own"]), ""))
    before = F.transform("p", lambda x, i: F.array_join(F.transform(F.slice("p", F.lit(1), i), lambda y: y["own"]), ""))
    met = F.forall(F.zip_with("p", before, lambda x, b: x["head"].isNull() | b.endswith(x["head"])), lambda ok: ok)
    numbered = F.transform("p", lambda x: x["piece"]) == F.sequence(F.lit(0), F.col("pieces") - 1)
    return parts.select("chunk_id", text.alias("content"), F.coalesce(F.col("longest") <= 2000, F.lit(True)).alias("within_limit"), numbered.alias("numbered"), met.alias("overlapping"))


def _ranking(spark: SparkSession, sf: str) -> DataFrame:
    chunks = spread(table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "embedding", "ts"))
    return rank_for_queries(chunks, table(spark, sf, "search_queries"), 5)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf).select(F.col("query_id").cast("int").alias("query_id"), "chunk_id").distinct()


def p3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf).select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", "hits", F.round("cosine", 6).alias("cosine"), "place_cosine", "place_hits", "rank")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = nearest_neighbours(table(spark, sf, "chunks").select("id", "embedding"), k=5, least_cosine=0.80)
    return near.where("cosine >= 0.80").select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id")).distinct()


def p4_places(spark: SparkSession, sf: str) -> DataFrame:
    lines = credential_lines(spread(table(spark, sf, "files").select("id", "content")))
    return lines.select(F.col("id").cast("int").alias("file_id"), "line_no", "kind").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_places(spark, sf).select("file_id", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    out = redacted(spread(table(spark, sf, "files").select(F.col("id").alias("file_id"), "content")), key="file_id")
    return out.where("masked > 0").dropDuplicates(["file_id"])


def p4_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Of every file whether masking kept its length and lines, left nothing to find, and left it as valid as it was."""
    files = table(spark, sf, "files").where("content IS NOT NULL").select("id", "lang", "content")
    masked = redacted(spread(files.withColumn("before", F.col("content"))))
    marks = cut_lineage(masked.where("masked > 0").dropDuplicates(["id"]))
    flaws = F.coalesce("error_line", F.lit(-1))
    was = parse_errors(marks.select("id", "lang", F.col("before").alias("content")), ["id"]).select("id", flaws.alias("was"))
    now = parse_errors(marks.select("id", "lang", "content"), ["id"]).select("id", flaws.alias("now"))
    left = credential_lines(marks).select(F.col("id").cast("int").alias("id")).distinct().withColumn("found", F.lit(True))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    seen = marks.join(was, "id", "left").join(now, "id", "left").join(left, "id", "left").select(
        "id", (F.length("content") == F.length("before")).alias("a"), (lines("content") == lines("before")).alias("b"), F.col("found").isNull().alias("c"), F.col("was").eqNullSafe(F.col("now")).alias("d")
    )
    out = files.select("id").distinct().join(seen, "id", "left")
    names = {"a": "same_length", "b": "same_lines", "c": "nothing_left", "d": "parses_as_before"}
    return out.select(F.col("id").alias("file_id"), *[F.coalesce(c, F.lit(True)).alias(n) for c, n in names.items()])


def p6_reasons(spark: SparkSession, sf: str) -> DataFrame:
    files = spread(table(spark, sf, "files").select("id", "repo_id", "path", "lang", "content", "content_sha"))
    aside = files_to_set_aside(files, table(spark, sf, "repos").select("id", "name"))
    return aside.select(F.col("id").alias("file_id"), F.array_join("reasons", ",").alias("reasons"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_reasons(spark, sf).select("file_id").distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    files = spread(table(spark, sf, "files").select("id", "content", "content_sha"))
    # TESTDATA asks for pairs of files, copies included
    return pairs_of_copies(*duplicate_pairs(files, 0.70)).select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b")).distinct()


def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    files = spread(table(spark, sf, "files").select("id", "content", "content_sha"))
    return duplicate_groups(files, 0.70).withColumnRenamed("id", "file_id")


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    # a handful of named capacities, whatever the corpus
    budgets = [(r["name"], r["capacity_tokens"]) for r in table(spark, sf, "token_budgets").collect()]
    return pack_documents(spread(table(spark, sf, "documents").select("doc_id", "text")), budgets)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(cut_lineage(_containers(spark, sf)))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each capacity the documents that have a place, and what must not be: containers over it, documents split that would
    fit, and split ones whose pieces do not follow on each other."""
    rows = cut_lineage(_containers(spark, sf))
    by = ["name", "capacity_tokens"]
    over = rows.groupBy(*by, "container_id").agg(F.sum("tokens").alias("t")).groupBy(*by).agg(F.count(F.when(F.col("t") > F.col("capacity_tokens"), 1)).alias("overfull"))
    docs = rows.groupBy(*by, "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("first_token", "tokens"))).alias("p"))
    meets = F.forall(F.transform("p", lambda x, i: x["first_token"] == i * F.col("capacity_tokens")), lambda ok: ok)
    docs = docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens")), 1)).alias("split_in_vain"), F.count(F.when(~meets, 1)).alias("in_pieces_that_do_not_meet")
    )
    return docs.join(over, by).select(*by, "documents", *[F.col(c).cast("int").alias(c) for c in ("overfull", "split_in_vain", "in_pieces_that_do_not_meet")])


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed = cut_lineage(p9_mixture(spark, sf))
    return share_report(mixed, table(spark, sf, "mix_targets"))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each target the documents used too often, numbered wrongly, or not of this source."""
    targets = table(spark, sf, "mix_targets").select("source", "max_repeats")
    uses = p9_mixture(spark, sf).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last"), F.countDistinct("copy").alias("different"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("own"))
    rows = uses.join(docs, "doc_id", "left").join(targets, "source", "full_outer")
    bad = lambda cond: F.count(F.when(cond, 1)).cast("int")
    return rows.groupBy("source").agg(
        bad(F.col("n") > F.col("max_repeats")).alias("used_too_often"), bad((F.col("n") != F.col("last")) | (F.col("n") != F.col("different"))).alias("misnumbered"),
        bad(F.col("n").isNotNull() & ~F.col("own").eqNullSafe(F.col("source"))).alias("of_another_source"),
    )


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = truncated(spread(table(spark, sf, "documents").select("doc_id", "text", "source")))
    return scored.select("doc_id", "source", F.round("score", 6).alias("score"), "cut")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_scores(spark, sf).where("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_rates(p10_scores(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_errors, p1_rates, p2_found, p2_pieces, p2_rejoined, p3_found, p3_ranking, p4_found, p4_places, p4_redacted, p4_safe, p5_found, p6_found, p6_reasons, p7_found, p7_groups, p8_containers, p8_fill, p8_checks, p9_mixture, p9_shares, p9_checks, p10_found, p10_scores, p10_rates)}


__all__ = ["oracle_sql", "queries"]
