"""Rows that meet in the buckets of an index: small buckets whole in a task, crowded ones in pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_small

#: A bucket is a band and a key; of a crowded one, ``one`` and ``two`` name the blocks that meet, ``side`` the row's own.
KEYS = ("band", "key", "one", "two")
_GIVEN = 5


#: Rows of an index that one task makes, about.
MADE = 500_000


def spread(nodes: DataFrame, rows: int) -> DataFrame:
    """Deal nodes to as many tasks as ``rows`` rows of their index want; by bytes alone few would make them all."""
    return nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, rows // MADE), "node")


def crowded(index: DataFrame, least: int, block: int) -> DataFrame:
    """``(band, key, blocks)`` of the buckets of more than ``least`` rows.

    The number of blocks is the root of the number of blocks of ``block`` rows: both the tasks
    that settle a bucket and what one of them reads grow with it, and its rows are copied less.
    """
    sizes = index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return cut(sizes.select("band", "key", F.ceil(F.sqrt(F.col("n") / block)).cast("int").alias("blocks")))


def deal(index: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of small buckets, and those of crowded ones, once for each block that theirs meets."""
    marked = join_small(index, hot, ["band", "key"])
    none = F.lit(0)
    small = marked.where("blocks is null").drop("blocks").withColumns({"one": none, "two": none, "side": none})
    large = marked.where("blocks is not null").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small, large.withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("blocks", "other")


def gather(rows: DataFrame, *payload: str) -> DataFrame:
    """Bring the rows of a bucket together."""
    return rows.select(*KEYS, "side", *payload).repartition(*KEYS).sortWithinPartitions(*KEYS)


def numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column)


def words(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def values(column: pa.Array) -> np.ndarray:
    """Binary values of any lengths."""
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def stretches(batches: Iterator[pa.RecordBatch], payload: tuple[Callable, ...]) -> Iterator[list[np.ndarray]]:
    """The gathered columns, cut where a bucket ends; only the bucket being read is held."""
    held: list[list[np.ndarray]] = []
    readers = (numbers,) * _GIVEN + payload
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [read(batch.column(i)) for i, read in enumerate(readers)]
        same = np.ones(batch.num_rows, bool)
        for i in range(len(KEYS)):
            same &= now[i] == now[i][-1]
        head = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if head or (held and any(held[0][i][0] != now[i][-1] for i in range(len(KEYS)))):
            yield [np.concatenate(x) for x in zip(*held, [x[:head] for x in now])]
            held = []
        held.append([x[head:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def bounds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the buckets of a stretch start and stop."""
    differs = np.zeros(max(0, len(columns[0]) - 1), bool)
    for x in columns[: len(KEYS)]:
        differs |= x[1:] != x[:-1]
    change = np.flatnonzero(differs) + 1
    return np.concatenate(([0], change)), np.concatenate((change, [len(columns[0])]))


def neighbours(columns: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of the small buckets of a stretch, a step of distance at a time; ``most`` rows a bucket."""
    starts, stops = bounds(columns)
    end, left = np.repeat(stops, stops - starts), np.arange(len(columns[0]))
    for step in range(1, most):
        left = left[left + step < end[left]]
        if not len(left):
            return
        yield left, left + step


def first_met(x: np.ndarray, band: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether codes with these exclusive-ors share no band before this one."""
    fresh = np.ones(len(x), bool)
    for j in range(int(band.max(initial=0))):
        fresh &= (band <= j) | ((x & masks[j]) != 0).any(axis=1)
    return fresh


def sides(columns: list[np.ndarray], start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """A row of a crowded bucket at a time, with the rows that it is to meet there."""
    rows = np.arange(start, stop)
    one, two, side = columns[2][start], columns[3][start], columns[4][start:stop]
    if one == two:
        for i in rows[:-1]:
            yield int(i), rows[i + 1 - start :]
        return
    right = rows[side == two]
    if len(right):
        for i in rows[side == one]:
            yield int(i), right


class Groups:
    """Rows united step by step; what unites them is a spanning forest."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def unite(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` through which row i gains a group, one for each."""
        mine = self.label[i]
        theirs, first = np.unique(self.label[others], return_index=True)
        new = theirs != mine
        if not new.any():
            return others[:0]
        self.label[np.isin(self.label, theirs[new])] = mine
        return others[first[new]]
