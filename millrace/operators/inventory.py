"""Model stores: sizes, status across homes, audits of links, and overlaps between listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a cached link, in the order they are tried.
STATES = ("incomplete", "missing_blob", "size_mismatch", "complete", "orphan_blob")


def sizes(files: DataFrame) -> DataFrame:
    """``(repo, n_files, total, cached, remaining)`` from (repo, name, size, is_cached)."""
    cached = F.coalesce("is_cached", F.lit(False))
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total"),
        F.coalesce(F.sum(F.when(cached, F.col("size"))), F.lit(0)).alias("cached"), F.coalesce(F.sum(F.when(~cached, F.col("size"))), F.lit(0)).alias("remaining"),
    )


def status_matrix(holdings: DataFrame, homes: list[str]) -> DataFrame:
    """One row per repo and a column per home. The homes are given, so no job has to find them."""
    return holdings.groupBy("repo").pivot("home", homes).agg(F.max("status"))


def removable(holdings: DataFrame, home: str) -> DataFrame:
    """Repos of a home that another home holds whole."""
    usable = holdings.where((F.col("home") != home) & (F.col("status") == "complete")).select("repo")
    return holdings.where(F.col("home") == home).join(usable, "repo", "left_semi")


def audit_links(links: DataFrame, blobs: DataFrame) -> DataFrame:
    """A state per snapshot link, and per blob that nothing links to. ``links`` is (repo, name, blob, size), ``blobs`` (repo, blob, blob_size)."""
    both = links.join(blobs, ["repo", "blob"], "full")
    state = (
        F.when(F.col("name").isNull(), "orphan_blob").when(F.col("blob").endswith(".incomplete"), "incomplete").when(F.col("blob_size").isNull(), "missing_blob")
        .when(F.col("size").isNotNull() & (F.col("size") != F.col("blob_size")), "size_mismatch").otherwise("complete")
    )
    return both.select("repo", "name", "blob", state.alias("state"))


def select_files(files: DataFrame, include: list[str] = (), exclude: list[str] = (), least: int | None = None, most: int | None = None, days: int | None = None, now=None) -> DataFrame:
    """Files by globs, size and age; filters on columns of the listing, so they reach its scan."""
    from ..sources.package import glob_expression

    rows = files
    if include:
        rows = rows.where(F.greatest(*[F.col("name").rlike(glob_expression(g)) for g in include]) if len(include) > 1 else F.col("name").rlike(glob_expression(include[0])))
    for g in exclude:
        rows = rows.where(~F.col("name").rlike(glob_expression(g)))
    if least is not None:
        rows = rows.where(F.col("size") >= least)
    if most is not None:
        rows = rows.where(F.col("size") <= most)
    if days is not None:
        rows = rows.where(F.col("modified") < (now if now is not None else F.current_timestamp()) - F.expr(f"interval {int(days)} days"))
    return rows


def skip_middle(variants: DataFrame, low: int = 4, high: int = 8) -> DataFrame:
    """Without the quantisations between a low and a high one that the same family has too; (family, bits)."""
    ends = variants.groupBy("family").agg(F.bool_or(F.col("bits") <= low).alias("_low"), F.bool_or(F.col("bits") >= high).alias("_high"))
    middle = (F.col("bits") > low) & (F.col("bits") < high)
    return variants.join(ends, "family").where(~(middle & F.col("_low") & F.col("_high"))).drop("_low", "_high")


def largest(files: DataFrame, count: int, by: str = "size") -> DataFrame:
    """A top list, by size descending or by age."""
    return files.orderBy(F.col("size").desc() if by == "size" else F.col("modified").asc(), "repo").limit(count)


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two listings with their provenance: both, first or second."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return left.join(right, keys, "full").select(*keys, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second").alias("found_in"))


def trigger_accuracy(labelled: DataFrame) -> DataFrame:
    """Confusion counts and accuracy from (should_trigger, did_trigger)."""
    s, d = F.col("should_trigger"), F.col("did_trigger")
    return labelled.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s & d).alias("tp"), F.count_if(~s & d).alias("fp"), F.count_if(s & ~d).alias("fn"), F.count_if(~s & ~d).alias("tn"),
        F.avg((s == d).cast("double")).alias("accuracy"),
    )


# When words read from a page look like a table, and when a page is doubtful.
ROW_PIXELS, ROW_WORDS, ROW_COLUMNS, TABLE_ROWS, LEAST_CONFIDENCE = 10, 4, 3, 3, 60


def page_tables(words: DataFrame, column_pixels: int = 10) -> DataFrame:
    """``(page, mean_confidence, table_rows, is_table, flagged)`` from (page, x, y, confidence)."""
    rows = words.groupBy("page", F.floor(F.col("y") / ROW_PIXELS).alias("row")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor(F.col("x") / column_pixels)).alias("columns"), F.sum("confidence").alias("c"), F.count("confidence").alias("k")
    )
    pages = rows.groupBy("page").agg(F.count_if((F.col("n") >= ROW_WORDS) & (F.col("columns") >= ROW_COLUMNS)).alias("table_rows"), (F.sum("c") / F.sum("k")).alias("mean_confidence"))
    return pages.select("page", "mean_confidence", "table_rows", (F.col("table_rows") >= TABLE_ROWS).alias("is_table"), ((F.col("mean_confidence") < LEAST_CONFIDENCE) | (F.col("table_rows") >= TABLE_ROWS)).alias("flagged"))
