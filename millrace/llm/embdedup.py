"""Embedding near-duplicates from randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut
from .buckets import Groups, bounds, crowded, deal, first_met, gather, neighbours, numbers, sides, spread, stretches, words
from .vectors import matrices, pack_bits, rotation, unit

COSINE = 0.95
#: Bits of a code: more than the dimensions, from several rotations side by side.
BITS = 256
SEED = 20240607
#: A pair exactly at the threshold meets in no band with this probability at most, if its differing
#: bits are binomial; closer pairs with far less.
MISSED = 1e-6
#: Rows of a bucket that meet in one task; a larger one is cut in blocks that meet in pairs, a task each.
BLOCK = 256


def missed(bits: int, bands: int, cosine: float = COSINE) -> float:
    """How likely a pair at the threshold meets in no band: all bands draw on the same BITS, of which it differs in a binomial number."""
    share, d = math.acos(cosine) / math.pi, np.arange(BITS + 1)
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, BITS + 1)))))
    likely = np.exp(log[BITS] - log[d] - log[BITS - d] + d * math.log(share) + (BITS - d) * math.log1p(-share))
    rest = np.maximum(BITS - d, bits)
    same = np.where(BITS - d >= bits, np.exp(log[rest] - log[rest - bits] - log[BITS] + log[BITS - bits]), 0.0)
    return float((likely * np.exp(bands * np.log1p(-np.minimum(same, 1 - 1e-12)))).sum())


def plan_bands(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits a band and number of bands: buckets stay small as rows grow, recall stays put."""
    bits = min(28, max(8, math.ceil(math.log2(max(2, vectors))) - 2))
    low, high = 0, 1
    while missed(bits, high, cosine) > MISSED:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(bits, middle, cosine) > MISSED else (low, middle)
    return bits, high


@lru_cache(maxsize=4)
def _turn(dims: int) -> np.ndarray:
    """An isometry into BITS dimensions (nearly one, if there are more dimensions than bits)."""
    turn = rotation(dims, BITS, SEED)
    return turn / math.sqrt(max(1.0, BITS / dims))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with codes and correction factors; one row per vector that takes part."""
    for batch in batches:
        for data, at in matrices(batch.column(1)):
            u = unit(data)
            r = u @ _turn(u.shape[1])
            factor = np.abs(r).sum(axis=1) / math.sqrt(BITS)  # inner product of the vector and its code
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.full(len(at), u.shape[1], np.int32)),
                    pa.array([x.tobytes() for x in u], pa.binary()),
                    pa.array([x.tobytes() for x in pack_bits(r > 0)], pa.binary()),
                    pa.array(factor),
                ],
                names=["vec_id", "dims", "unit", "code", "factor"],
            )


def _band_masks(bits: int, bands: int) -> np.ndarray:
    """Seeded choices of code bits, as masks over the words of a code."""
    rng, out = np.random.default_rng(SEED + 1), np.zeros((bands, BITS), bool)
    for band in out:
        band[rng.choice(BITS, bits, replace=False)] = True
    return pack_bits(out)


def _mix(words: np.ndarray) -> np.ndarray:
    """A 64-bit key of masked words."""
    h = np.zeros(len(words), np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _index(masks: np.ndarray):
    """A row for each band of each node; lengths of vectors have bands of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, first = words(batch.column(1)), np.asarray(batch.column(2)).astype(np.int64) * _BANDS
            for band, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + band), pa.array(_mix(codes & mask)), batch.column(0), batch.column(1)],
                    names=["band", "key", "node", "code"],
                )

    return run


#: Deviations that a confidence bound spans.
WIDTH = 6.0
#: Rows of a bucket that returns its pairs; a larger one is settled where it meets.
SMALL = 48
#: More than the bands of any plan.
_BANDS = 1 << 20


def _furthest(cosine: float) -> float:
    """The Hamming distance that codes of a pair at the threshold stay under, WIDTH deviations out."""
    share = math.acos(cosine) / math.pi
    return BITS * share + WIDTH * math.sqrt(BITS * share * (1 - share))


def _pairs(masks: np.ndarray, cosine: float):
    """Pairs of small buckets whose codes leave them open, each in the first band it shares.

    A share of differing bits estimates angle / pi without bias.
    """
    most = _furthest(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in stretches(batches, (numbers, words)):
            band, node, code, found = columns[0] % _BANDS, columns[5], columns[6], []
            for left, right in neighbours(columns, SMALL + 1):
                hit = np.bitwise_count(code[left] ^ code[right]).sum(axis=1) <= most
                found.append((left[hit], right[hit]))
            left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            fresh = first_met(code[left] ^ code[right], band[left], masks)
            a, b = node[left[fresh]], node[right[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _settle(masks: np.ndarray, cosine: float):
    """Links of crowded buckets, counted where their rows meet: ``(a, b, others)``.

    A row with a null b says how many rows link with a through pairs that share this band
    first; the others are a spanning forest of those links. So a bucket returns a number of
    rows that follows its size, not its pairs. Codes, estimates and exact cosines decide in
    the same order as for small buckets.
    """
    most = _furthest(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in stretches(batches, (numbers, words, words, numbers, numbers)):
            node, code, factor, rows = columns[5], columns[6], columns[8], columns[9]
            for start, stop in zip(*bounds(columns)):
                units = np.ascontiguousarray(columns[7][start:stop]).view(np.float64)
                guess, slack = _decoded(code[start:stop], factor[start:stop], units.shape[1], cosine)
                earlier = masks[: int(columns[0][start] % _BANDS)]
                count, groups, a, b = np.zeros(stop - start, np.int64), Groups(stop - start), [], []
                for i, others in sides(columns, start, stop):
                    others = others[np.bitwise_count(code[others] ^ code[i]).sum(axis=1) <= most]
                    for mask in earlier:
                        if not len(others):
                            break
                        others = others[((code[others] ^ code[i]) & mask).any(axis=1)]
                    at, others = i - start, others - start
                    others = others[units[others] @ guess[at] + slack[at] >= cosine]
                    others = others[(units[others] * units[at]).sum(axis=1) >= cosine]
                    if not len(others):
                        continue
                    count[at] += rows[start + others].sum()
                    count[others] += rows[i]
                    new = groups.unite(at, others)
                    a += [node[i]] * len(new)
                    b += node[start + new].tolist()
                hit = np.flatnonzero(count)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([node[start + hit], np.array(a, np.int64)])),
                            pa.array([None] * len(hit) + b, pa.int64()),
                            pa.array(np.concatenate([count[hit], np.zeros(len(a), np.int64)])),
                        ],
                        names=["a", "b", "others"],
                    )

    return run


def _decoded(code: np.ndarray, factor: np.ndarray, dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose inner product with a unit vector estimates the coded one's without bias, and the slack at the threshold.

    For a pair at the threshold the error is the sine of its angle times an inner product
    with the code's remainder: never more than sine * sqrt(1 - f * f) / f, and under
    WIDTH / sqrt(BITS - 1) of that with the confidence of WIDTH deviations.
    """
    signs = np.unpackbits(code.astype(">u8").view(np.uint8).reshape(len(code), -1), axis=1)[:, :BITS].astype(np.float64) * 2 - 1
    decoded = signs @ (_turn(dims).T / math.sqrt(BITS))
    sine = math.sqrt(1 - cosine * cosine)
    slack = sine * np.sqrt(np.clip(1 - factor * factor, 0, 1)) / factor * min(1.0, WIDTH / math.sqrt(BITS - 1))
    return decoded / factor[:, None], slack


def estimate(code: np.ndarray, factor: np.ndarray, other: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded unit vectors with others, row by row, and the slack at the threshold."""
    guess, slack = _decoded(code, factor, other.shape[1], cosine)
    return (guess * other).sum(axis=1), slack


def _check(cosine: float):
    """Pairs whose upper bound reaches the threshold, recomputed exactly in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factor = np.asarray(batch.column(6))
            lengths = np.asarray(batch.column(2))
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(own))
                ua, ub = (words(part.column(i)).view(np.float64) for i in (3, 4))
                value, slack = estimate(words(part.column(5)), factor[own], ub, cosine)
                hit = value + slack >= cosine
                hit[hit] = (ua[hit] * ub[hit]).sum(axis=1) >= cosine
                hit = pa.array(hit)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit)], names=["a", "b"])

    return run


def embedding_components(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row that takes part.

    Equal vectors are one node whose rows count by number, so copies meet nobody twice.
    Null, empty and zero vectors and those with null or non-finite components are left
    out here. Vectors of different lengths never link; each length is a search of its own, however
    many rows have it. Repeated rows count as other vectors. A null vec_id counts as a link but names
    no component unless it is alone in it (component_id null). Very long vectors keep
    their codes of BITS bits, and only exact cosines link. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    coded = cut(rows.mapInArrow(_encode, "vec_id long, dims int, unit binary, code binary, factor double"))
    nodes = cut(
        coded.groupBy("unit").agg(F.first("dims").alias("dims"), F.first("code").alias("code"), F.first("factor").alias("factor"), F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    masks = _band_masks(*plan_bands(count := nodes.count(), cosine))
    index = spread(nodes.select("node", "code", "dims"), count * len(masks)).mapInArrow(_index(masks), "band long, key long, node long, code binary")
    hot = crowded(index, small, block)
    cold, warm = deal(index, hot)
    open_ = gather(cold, "node", "code").mapInArrow(_pairs(masks, cosine), "a long, b long")
    coded_side = nodes.select(F.col("node").alias("a"), "dims", F.col("unit").alias("ua"), "code", "factor")
    with_units = open_.join(coded_side, "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b").select("a", "b", "dims", "ua", "ub", "code", "factor")
    links = cut(with_units.mapInArrow(_check(cosine), "a long, b long"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.select(F.col("node").alias("b"), "rows"), "b").select("a", F.col("rows").alias("others"))
    if hot.limit(1).count():
        full = warm.join(nodes.select("node", "unit", "factor", "rows"), "node")
        settled = cut(gather(full, "node", "code", "unit", "factor", "rows").mapInArrow(_settle(masks, cosine), "a long, b long, others long"))
        links = links.unionByName(settled.where("b is not null").select("a", "b"))
        others = others.unionByName(settled.where("b is null").select("a", "others"))
    roots = components(links)
    placed = (
        nodes.select("node", "unit", "rows", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(others.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others")), "node", "left")
    )
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(lowest, "root").select("unit", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    return coded.select("vec_id", "unit").join(placed, "unit").select("vec_id", "n_links", "component_id")


def embedding_dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """``embedding_components`` with ``kept``, and with the rows that take no part: n_links 0, their own component.

    ``kept`` is false where vec_id is null.
    """
    linked = embedding_components(df, vec_id, embedding, cosine, block, small)
    alone = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(_left_out, "vec_id long")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for _, at in matrices(batch.column(1)):
            keep[at] = False
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["vec_id"])
