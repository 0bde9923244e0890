"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_small

WORD = r"[^\x20\x09-\x0D]+"
#: Symbols that crowd machine-made junk; a document's weight falls with their share.
SYMBOLS = r"[!#$%&*|<>~^]"
#: Ranges of the sampling key that a source is cut into before the prefix sums.
SLICES = 1024
MOST = 3


def quality_weight(text):
    """A weight in (0, 1] from the share of symbols; 1 for null and empty texts."""
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = F.regexp_count(text, F.lit(SYMBOLS)).cast("double") / length
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * share), F.lit(1.0))


def uniform(doc_id):
    """A number in (0, 1) that depends on the id alone, so reruns agree."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.0, most: int = MOST, cycle: tuple = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share
    ``share`` of all words by weight; one that would pass ``most`` times its source's
    size stops there and the excess is shared again by weight until none is above.
    Only sums reach the driver. A source without a word has target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    table = cut(sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))))
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    cap, rate, stopped = F.lit(float(most)) * F.col("source_size"), 0.0, -1
    while True:
        over = F.lit(rate) * F.col("w") > cap
        row = table.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w")
        ).first()
        if row["n"] == stopped or not row["w"]:
            break
        stopped, rate = row["n"], (total - (row["full"] or 0.0)) / row["w"]
    return table.select("source", "source_size", F.least(cap, F.lit(rate) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weight=None, share: float = 1.0, most: int = MOST, slices: int = SLICES) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, times)`` for every row of ``docs``.

    A source's whole epochs come first; the rest of its target goes to the documents
    with the smallest keys ``-ln(u) / weight``, as long as the middle of a document
    lies below the rest, so a source misses its target by at most half of one
    document. Null and empty texts have size 0 and are taken as often as their
    source's whole epochs, for 0 words. Rows with equal ids and texts are
    interchangeable; null ids draw one fixed number. Other columns are ignored.

    Each source is cut into ``slices`` ranges of the key, which are summed before the
    shuffle; prefix sums then run inside a slice, so a hot source is never sorted
    in one task.
    """
    text = F.col("text")
    base = docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        (weight if weight is not None else quality_weight(text)).alias("weight"),
        F.xxhash64(text).alias("tie"),
    )
    key = -F.log(uniform(F.col("doc_id"))) / F.col("weight")
    rows = cut(
        base.withColumn("key", key)
        .withColumn("slice", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * slices), F.lit(slices - 1)).cast("int"))
        .drop("weight")
    )
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    goals = targets(per_slice.groupBy("source").agg(F.sum("words").alias("source_size")), share, most)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    goals = goals.withColumnRenamed("source", "_source")
    parts = per_slice.withColumn("before", F.coalesce(before, F.lit(0)))
    parts = parts.join(goals, parts["source"].eqNullSafe(goals["_source"])).select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"), "before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = join_small(summed, cut(parts), summed["source"].eqNullSafe(F.col("_source")) & (summed["slice"] == F.col("_slice")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("before") + F.col("earlier") + F.col("size") / F.lit(2.0)
    times = epochs + F.when(middle < rest, 1).otherwise(0)
    return placed.withColumn("times", F.when(F.col("source_size") > 0, times).otherwise(F.lit(1)).cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"
    )


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; rows that share a doc_id share its lot."""
    lot = mix(docs).groupBy(F.col("doc_id").alias("_mr_doc")).agg(F.max("times").alias("_mr_times")).where("_mr_times > 0")
    joined = docs.join(lot, docs["doc_id"].eqNullSafe(F.col("_mr_doc")))
    return joined.withColumn("_mr_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mr_times")))).drop("_mr_doc", "_mr_times", "_mr_copy")


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the columns of the op10 query."""
    symbols = SYMBOLS.replace("'", "''")
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (len(regexp_extract_all(text, '{symbols}'))::DOUBLE / greatest(length(text), 1)::DOUBLE)), 1.0::DOUBLE) AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_,
    (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest_w FROM r),
l AS (SELECT coalesce(max((total - full_) / rest_w) FILTER (WHERE ratio >= (total - full_) / rest_w), 0.0) AS rate FROM c),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, rate * w) AS target FROM s, l),
k AS (SELECT d.*, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN earlier + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k"""
