"""SimHash near-duplicates over a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import cut, join_small

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER, LOWER)
#: 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of 8 bytes.
DISTANCE, BYTES, SHARED = 3, 8, 5
#: Position sets of the index: the 14 planes of AG(3,2). The complement of a plane is
#: a plane and any 3 positions lie in exactly one, so whatever 3 bytes differ, one
#: plane holds only shared bytes: every pair with 5 shared bytes meets in a posting.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: A posting of more distinct fingerprints is split by a further shared byte and 6 bits, so that one task's search stays short.
HOT_POSTING = 1 << 12
_CHUNK = 1 << 20


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(positions) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of folded UTF-8, a bounded piece at a time; bytes.split cuts at 09-0D and 20."""
    at, rest = 0, b""
    while at < len(data):
        piece = rest + data[at : at + _CHUNK]
        at += _CHUNK
        if at >= len(data):
            yield piece.split()
            return
        words = piece.split()
        rest = words.pop() if words and not piece[-1:].isspace() else b""
        yield words


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash as an unsigned integer; zero without a word or for null."""
    data = (text or "").encode().translate(_FOLD)
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_digest
    for words in _words(data):
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        tail = words[len(words) - shingle + 1 :]
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        for i in range(0, len(starts), 1 << 16):
            hashes = b"".join([digest(line[s:e], 42) for s, e in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), 42)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint_bits", shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(x, shingle)) for x in texts], dtype="int64")

    return df.withColumn(out, bits(F.col(text)))


def _shares(x: np.ndarray) -> np.ndarray:
    """Whether two fingerprints with this exclusive-or link: tally shared bytes, then verify bits."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1, dtype=np.uint8)
    keep = tally >= SHARED
    keep[keep] = np.bitwise_count(x[keep]) <= DISTANCE
    return keep


def _within(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect one long posting: a breadth-first search emits a star per component."""
    out, left = [], values
    while len(left) > 1:
        seed, left = left[:1], left[1:]
        frontier, found = seed, []
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            for value in frontier:
                open_ = ~hit
                if not open_.any():
                    break
                hit[open_] = _shares(left[open_] ^ value)
            frontier, left = left[hit], left[~hit]
            found.append(frontier)
        reached = np.concatenate(found) if found else left[:0]
        if len(reached):
            out.append((np.repeat(seed, len(reached)), reached))
    return out


def _links(index: np.ndarray, key: np.ndarray, value: np.ndarray, long_run: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among sorted rows whose (index, key) are equal."""
    change = np.flatnonzero((index[1:] != index[:-1]) | (key[1:] != key[:-1])) + 1
    starts = np.concatenate(([0], change))
    stops = np.concatenate((change, [len(key)]))
    sizes = stops - starts
    for s, e in zip(starts[sizes >= long_run], stops[sizes >= long_run]):
        yield from _within(value[s:e])
    end = np.repeat(np.where(sizes < long_run, stops, 0), sizes)
    left = np.arange(len(key))
    for step in range(1, long_run):
        left = left[left + step < end[left]]
        if not len(left):
            break
        hit = left[_shares(value[left] ^ value[left + step])]
        if len(hit):
            yield value[hit], value[hit + step]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted postings; only the posting being read is held."""
    held: list[tuple] = []

    def links(parts):
        index, key, value = (np.concatenate(x) for x in zip(*parts))
        for a, b in _links(index, key, value):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        index, key, value = (np.asarray(batch.column(i)) for i in range(3))
        value = value.view(np.uint64)
        if held and (held[0][0][0] != index[-1] or held[0][1][0] != key[-1]) or not held:
            cut_at = len(key) - 1
            change = np.flatnonzero((index[1:] != index[:-1]) | (key[1:] != key[:-1]))
            cut_at = change[-1] + 1 if len(change) else 0
            if held or cut_at:
                yield from links(held + [(index[:cut_at], key[:cut_at], value[:cut_at])])
            held = [(index[cut_at:], key[cut_at:], value[cut_at:])]
        else:
            held.append((index, key, value))
    if held:
        yield from links(held)


def _split_hot(postings: DataFrame, limit: int) -> DataFrame:
    """Replace postings of more than ``limit`` rows by finer ones that lose no link.

    Two members share 4 bytes and must share one of the other 4; the 24 bits then
    left differ in at most 3, so one of four 6-bit groups is equal. What remains
    of a posting has 18 free bits: at most 2**18 distinct fingerprints, of which fewer
    than 2**18 / 19 can lie more than 3 bits apart, so its search soon runs out of rows.
    """
    hot = cut(postings.groupBy("plane", "key").count().where(F.col("count") > limit).select("plane", "key", F.lit(True).alias("hot")))
    marked = join_small(postings, hot, ["plane", "key"])
    finer = []
    for i, plane in enumerate(PLANES):
        for p in sorted(set(range(8)) - set(plane)):
            free = [8 * q + bit for q in sorted(set(range(8)) - set(plane) - {p}) for bit in range(8)]
            for g in range(4):
                mask = _mask([*plane, p]) | _signed(sum(1 << b for b in free[6 * g : 6 * g + 6]))
                finer.append((i, 100 + len(finer), _signed(mask & ((1 << 64) - 1))))
    steps = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(n).alias("plane"), F.lit(m).alias("mask")) for i, n, m in finer])
    split = (
        marked.where("hot")
        .select("plane", "value", F.explode(F.filter(steps, lambda s: s["of"] == F.col("plane"))).alias("s"))
        .select(F.col("s.plane").alias("plane"), F.col("value").bitwiseAND(F.col("s.mask")).alias("key"), "value")
    )
    return marked.where("hot is null").select("plane", "key", "value").unionByName(split)


def fingerprint_links(values: DataFrame, value: str = "value", hot_posting: int = HOT_POSTING) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints at most 3 bits apart.

    Every linked pair is joined by a path of returned links; a posting returns at
    most a constant number of links per member, never all its pairs.
    """
    values = values.select(F.col(value).alias("value"))
    keys = F.array(*[F.struct(F.lit(i).alias("plane"), F.col("value").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(PLANES)])
    postings = values.select("value", F.explode(keys).alias("k")).select("k.plane", "k.key", "value")
    if values.limit(hot_posting + 1).count() > hot_posting:
        postings = _split_hot(postings, hot_posting)
    sorted_ = postings.repartition("plane", "key").sortWithinPartitions("plane", "key", "value")
    return sorted_.mapInArrow(_probe, "a long, b long")


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, hot_posting: int = HOT_POSTING) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Texts are folded (A-Z), cut into words at ``[\\x20\\x09-\\x0D]+`` and hashed as
    3-word shingles. Null and empty texts, and texts of white space alone, have
    fingerprint zero and link like any other. Equal fingerprints are collapsed
    before the index is built, so copies cost one posting. Repeated rows each
    return a row; a null doc_id never names a component unless it has no other
    member (then component_id is null). An empty table gives an empty result;
    other columns are ignored.
    """
    prints = cut(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "value", shingle).select("doc_id", "value"))
    one = cut(prints.groupBy("value").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(one, "value", hot_posting))
    placed = one.join(roots.withColumnRenamed("node", "value"), "value", "left").select("value", "least", F.coalesce("root", "value").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("value", "component_id")
    return prints.join(named, "value").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the smallest of its component.

    Rows that share a doc_id, a null one too, are one document: they stay or go together.
    Null ids stay if one of them is alone in its component.
    """
    found = simhash_components(df, doc_id, text)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_mr_kept")).distinct()
    return df.join(kept, df[doc_id].eqNullSafe(F.col("_mr_kept")), "left_semi")
