"""Distinct with a defined winner, duplicate detection, collision-free names and free identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column | str, order: list) -> DataFrame:
    """The row of each key that comes first in ``order``; rows with a null key go.

    The smallest row per key is found by an aggregate, which combines before the
    shuffle: a hot key costs a row per task, where a window would sort it whole.
    """
    key = F.col(key) if isinstance(key, str) else key
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min_by(own, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def last_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(own, F.struct(*order)).alias("_row")).select("_row.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: detection, not removal."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def numbered_names(df: DataFrame, name: str, order: list, out: str = "unique_name", dash_from: int = 2) -> DataFrame:
    """The first holder of a name keeps it, later ones get ``-2``, ``-3`` and so on before the extension.

    Names that only the numbering makes may meet literal ones; ``settle_names`` settles those.
    """
    turn = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    return df.withColumn("_n", turn).withColumn(
        out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), (F.col("_n") + dash_from - 2).cast("string"), ext))
    ).drop("_n")


def settle_names(names: Column) -> Column:
    """The names of one group in order, each the first free of ``x``, ``x-2``, ``x-3``...

    A fold over an array, for groups that fit in a row: a literal ``x-2`` met
    earlier pushes a numbered name on.
    """
    def place(taken, name):
        stem = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1)
        ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda i: F.when(i == 1, name).otherwise(F.concat(stem, F.lit("-"), i.cast("string"), ext)))
        return F.concat(taken, F.array(F.filter(tries, lambda t: ~F.array_contains(taken, t))[0]))

    return F.aggregate(names, F.array().cast("array<string>"), place)


def free_ids(df: DataFrame, group: str, identifier: str, order: str, most: int = 0x7FFFFFFF) -> DataFrame:
    """Keep valid identifiers (0 up to ``most``), give all others of a group the next free number from 1.

    Adds ``new_id``. With v valid ids in a group, its k-th free number is at most v + k, so
    the candidates are a bounded sequence and no loop over rows is needed.
    """
    number = F.when(F.col(identifier).rlike(r"^[+-]?[0-9]{1,18}$"), F.col(identifier).cast("long"))
    rows = df.withColumn("_id", F.when((number >= 0) & (number < most), number))
    bad = rows.where("_id is null").withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    need = rows.groupBy(group).agg(F.count_distinct("_id").alias("v"), F.count_if(F.col("_id").isNull()).alias("k")).where("k > 0")
    tries = need.select(group, F.explode(F.sequence(F.lit(1).cast("long"), F.col("v") + F.col("k"))).alias("free"))
    taken = rows.where("_id is not null").select(group, F.col("_id").alias("free")).distinct()
    free = tries.join(taken, [group, "free"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("free")))
    fixed = bad.join(free, [group, "_k"]).withColumn("new_id", F.col("free")).drop("_k", "free", "_id")
    return rows.where("_id is not null").withColumn("new_id", F.col("_id")).drop("_id").unionByName(fixed)
