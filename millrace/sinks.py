"""Sinks: committed writes, imports with a status, and output paths that must not collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import digest, word_count


def import_status(new: DataFrame, old: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``(key, status)``: created, updated, unchanged or absent, by digest of the bytes."""
    a = new.select(key, digest(F.col(content)).alias("_new"))
    b = old.select(key, digest(F.col(content)).alias("_old"))
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "absent").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated")
    return a.join(b, key, "full").select(key, status.alias("status"))


def changed(new: DataFrame, old: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """The rows of ``new`` that a write would change: what is byte-identical is left out."""
    return new.join(import_status(new, old, key, content).where(F.col("status").isin("created", "updated")).select(key), key, "left_semi")


def output_path(path: Column, folder: str | None, suffix: str, drop: str = "") -> Column:
    """``<folder or the input's>/<stem><suffix>``; an inner suffix ``drop`` goes too."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    stem = F.regexp_replace(name, drop.replace(".", "\\.") + "$", "") if drop else name
    base = F.lit(folder.rstrip("/") + "/") if folder is not None else F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(base, stem, F.lit(suffix))


def collisions(paths: DataFrame, out: str = "output") -> DataFrame:
    """Outputs that more than one input resolves to; a write must not start while there are any."""
    return paths.groupBy(out).agg(F.count(F.lit(1)).alias("inputs")).where("inputs > 1")


def write_once(df: DataFrame, where: str, kind: str = "parquet", **options) -> None:
    """Write through Spark's committer: readers see all of it or nothing, and a second write fails."""
    df.write.format(kind).options(**options).mode("errorifexists").save(where)


def write_transcript_files(df: DataFrame, where: str, about: DataFrame | None = None) -> None:
    """``(path, text)`` as a folder per path of one text file that ends with a newline, and a metadata line per path.

    ``about`` has further fields by path for the metadata. Texts that are null or blank
    raise nothing: they get a metadata line with 0 words and no file. Repeated paths share a folder.
    """
    rows = df.select("path", F.btrim("text", F.lit(" \t\n\x0b\x0c\r")).alias("text"))
    facts = rows.select("path", word_count(F.coalesce("text", F.lit(""))).alias("transcriptWords"))
    if about is not None:
        facts = facts.join(about, "path", "left")
    facts.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{where}/metadata")
    rows.where("text <> ''").repartition("path").write.mode("errorifexists").partitionBy("path").text(f"{where}/transcripts")


def write_discovery(df: DataFrame, where: str) -> None:
    """What was found for each input as a JSON line, nulls too: tracks, sidecars, presets by score."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{where}/discovery")


def write_transcripts(df: DataFrame, where: str) -> None:
    """``(path, text)`` as tables for a corpus, where a file per path would be too many: texts, and word counts as JSON."""
    rows = df.withColumn("words", word_count(F.col("text")))
    rows.select("path", "words").write.mode("errorifexists").json(f"{where}/metadata")
    rows.select("path", F.concat("text", F.lit("\n")).alias("text")).write.mode("errorifexists").parquet(f"{where}/transcripts")
