"""Token templates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_file_name

TOKEN = r"\{\{([^}]+)\}\}"


def tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: F.trim(t)))


def missing_keys(text: Column, fields: Column) -> Column:
    """Keys that a template asks for and a record lacks, distinct and sorted."""
    return F.array_sort(F.filter(tokens(text), lambda t: ~F.map_contains_key(fields, t)))


def fill(text: Column, fields: Column) -> Column:
    """The text with ``{{key}}`` replaced where the record has the key; values are not read as templates again."""
    pieces = F.split(text, r"\{\{")
    fill_one = lambda p: F.when(
        p.rlike(r"(?s)^[^}]+\}\}") & F.map_contains_key(fields, F.trim(F.regexp_extract(p, r"(?s)^([^}]+)\}\}", 1))),
        F.concat(F.coalesce(F.try_element_at(fields, F.trim(F.regexp_extract(p, r"(?s)^([^}]+)\}\}", 1))), F.lit("None")), F.regexp_replace(p, r"(?s)^[^}]+\}\}", "")),
    ).otherwise(F.concat(F.lit("{{"), p))
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.concat(pieces[0], F.array_join(F.transform(rest, fill_one), ""))


def bulk_fill(records: DataFrame, template: str, name: str, suffix: str = ".docx") -> DataFrame:
    """``(ord, record, output, content, missing, ok)``: the template once per record; ``name`` is a SQL expression over
    the record's columns and ``loop_index``. Names that collide get ``-2``, ``-3`` in order."""
    from .dedupe import numbered_names

    rows = records.withColumn("loop_index", F.col("ord") + 1)
    safe = safe_file_name(F.expr(name))
    rows = rows.withColumn("_name", F.when(F.lower(safe).endswith(suffix), safe).otherwise(F.concat(safe, F.lit(suffix))))
    rows = numbered_names(rows, "_name", ["ord"], "output")
    text = F.lit(template)
    gaps = missing_keys(text, F.col("fields"))
    return rows.select("ord", "output", F.when(F.size(gaps) == 0, fill(text, F.col("fields"))).alias("content"), gaps.alias("missing"), (F.size(gaps) == 0).alias("ok"))


def bulk_report(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("generated_count"), F.count_if(~F.col("ok")).alias("error_count"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("ord", "missing")))).alias("errors"),
    )
