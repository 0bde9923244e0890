"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_small
from .vectors import matrices, rotation, unit

#: Bits of a substring of the code. One table of 256 lists per substring and block.
PIECE = 8
#: Rows that the rotation is learned on: those of the smallest hashes.
SAMPLE = 20_000
#: The radius searched, as a share of the code's bits. Every code within it is reranked.
RADIUS = 0.47
#: Vectors of a block of the index, and queries of a block.
BLOCK, QUERIES = 8_192, 2_048
#: Lists of a substring's table that are probed one by one; beyond, the rows' substrings are looked up in the probes.
PROBES = 24
STEPS = 25
SEED = 7


def learn_rotation(data: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Iterative quantisation: the rotation that brings unit vectors near their signs."""
    width = data.shape[1]
    turn = rotation(width, width, SEED)
    for _ in range(steps if len(data) > width else 0):
        left, _, right = np.linalg.svd(data.T @ np.where(data @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def pieces(data: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of 8-bit substrings."""
    return np.packbits(data @ turn > 0, axis=1)


_MASKS = {
    r: np.array(sorted(sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(PIECE), n)), np.uint8)
    for r in range(PIECE + 1)
}


class Index:
    """Substring tables over one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.columns = np.ascontiguousarray(codes.T)
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)]
        self.words = _words(codes)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes at most ``radius`` bits away.

        With m substrings and radius m * r + a, one of the first a + 1 substrings is at
        most r bits away or one of the others at most r - 1: those lists are probed.
        """
        m = self.codes.shape[1]
        r, a = divmod(min(radius, m * PIECE), m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            if (reach := r if j <= a else r - 1) < 0:
                continue
            if reach >= PIECE:
                seen[:] = True
                break
            probes = _MASKS[reach] ^ code[j]
            if len(probes) > PROBES:
                wanted = np.zeros(256, bool)
                wanted[probes] = True
                seen |= wanted[self.columns[j]]
                continue
            order, starts = self.order[j], self.starts[j]
            for v in probes:
                seen[order[starts[v] : starts[int(v) + 1]]] = True
        found = np.flatnonzero(seen)
        bits = np.bitwise_count(self.words[found] ^ _words(code[None])).sum(axis=1)
        return found[bits <= radius]


def _words(codes: np.ndarray) -> np.ndarray:
    pad = -codes.shape[1] % 8
    if pad:
        codes = np.concatenate([codes, np.zeros((len(codes), pad), np.uint8)], axis=1)
    return np.ascontiguousarray(codes).view(np.uint64)


def nearest(ids: np.ndarray, data: np.ndarray, index: Index, qid: int, query: np.ndarray, code: np.ndarray, k: int, radius: int) -> list[tuple[int, float]]:
    """The k best ids of a block by their best rows, nearest first, ties to the smaller id; the radius grows until k are found."""
    bits = index.codes.shape[1] * PIECE
    while True:
        found = index.within(code, radius)
        found = found[ids[found] != qid]
        if radius >= bits or (len(found) >= k and len(np.unique(ids[found])) >= k):
            break
        radius = min(bits, radius + PIECE)
    if not len(found):
        return []
    rough = data[found] @ query
    if len(found) > k:
        names, which = np.unique(ids[found], return_inverse=True)
        top = np.full(len(names), -np.inf)
        np.maximum.at(top, which, rough)
        if len(names) > k:
            found = found[rough >= np.partition(top, len(top) - k)[len(top) - k] - 1e-9]
    own = data[found]
    scores = (own * query).sum(axis=1)  # row by row, so equal vectors score alike wherever they lie
    best = np.lexsort((ids[found], -scores))
    best = best[np.sort(np.unique(ids[found[best]], return_index=True)[1])][:k]
    return [(int(ids[found[i]]), float(scores[i])) for i in best]


def _pack(block: int, every: int, queries: bool):
    """Blocks of unit vectors of one length as packed rows; vectors that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, data):
            return pa.RecordBatch.from_arrays([pa.array([data.shape[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([data.tobytes()])], names=["dims", "ids", "data"])

        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0)
            known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            wanted = known & (ids % every == 0) if queries else known
            for data, at in matrices(batch.column(1)):
                data, at = data[wanted[at]], at[wanted[at]]
                if not len(at):
                    continue
                own = held.setdefault(data.shape[1], [np.zeros(0, np.int64), np.zeros((0, data.shape[1]))])
                own[0], own[1] = np.concatenate([own[0], ids[at]]), np.concatenate([own[1], unit(data)])
                while len(own[0]) >= block:
                    yield out(own[0][:block], own[1][:block])
                    own[0], own[1] = own[0][block:], own[1][block:]
        for ids, data in held.values():
            if len(ids):
                yield out(ids, data)

    return run


def _turn(turns: dict[int, np.ndarray], dims: int) -> np.ndarray:
    """The learned rotation, or a random one for a length that the sample lacks."""
    return turns[dims] if dims in turns else rotation(dims, dims, SEED)


def _best(found: list[tuple[int, float]], k: int) -> list[tuple[int, float]]:
    """The first k ids, nearest first, ties to the smaller id, each by its best row."""
    out, seen = [], set()
    for vec, score in sorted(found, key=lambda x: (-x[1], x[0])):
        if vec not in seen:
            seen.add(vec)
            out.append((vec, score))
            if len(out) == k:
                break
    return out


def _search(turns: dict[int, np.ndarray], k: int, share: float):
    """Cells of one block of queries, which comes first, and blocks of the index, which stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best = None, [], {}

        def done():
            out = [(qid, vec, score) for qid, found in best.items() for vec, score in found]
            if out:
                q, v, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for own, kind, dims, packed, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if own != cell:
                    yield from done()
                    cell, asked, best = own, [], {}
                ids, rows = np.frombuffer(packed, "<i8"), np.frombuffer(data).reshape(-1, dims)
                codes = pieces(rows, _turn(turns, dims))
                if not kind:
                    asked.append((ids, rows, codes))
                    continue
                index = Index(codes)
                radius = int(share * codes.shape[1] * PIECE)
                for qids, queries, qcodes in asked:
                    for qid, query, code in zip(qids.tolist(), queries, qcodes):
                        found = nearest(ids, rows, index, qid, query, code, k, radius)
                        best[qid] = _best(best[qid] + found, k) if qid in best else found
        yield from done()

    return run


def learn(df: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """A rotation for each vector length, learned on a sample bounded by ``sample`` rows."""
    rows = df.select(F.col("vec_id"), F.col("embedding")).where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    data: dict[int, list] = {}
    for batch in rows.to_batches():
        for own, _ in matrices(batch.column(1)):
            data.setdefault(own.shape[1], []).append(unit(own))
    return {width: learn_rotation(np.concatenate(parts)) for width, parts in data.items()}


def search(df: DataFrame, every: int = 50, k: int = 5, radius: float = RADIUS, sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest by cosine of each id divisible by ``every``.

    Every vector is indexed; within a block, all codes inside the radius are retrieved
    and reranked by exact cosines, and the radius grows where fewer than k ids lie in it.
    Ties go to the smaller vec_id. Null ids, null, empty and zero vectors and those
    with null or non-finite components take no part. Each length of vectors is a search
    of its own, however many rows have it: a query's neighbours have its length. A repeated id's rows are
    candidates of one id and never of its own query; repeated queries return one list.
    Fewer than k other ids give all of them. Very long vectors make longer codes. An empty
    table gives an empty result; other columns are ignored.

    The blocks of the index are dealt to cells; each block of the stated queries visits every cell
    of its length, and a cell returns k rows a query however many blocks it holds.
    """
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    turns = learn(rows, sample)
    packed = "dims int, ids binary, data binary"
    index = cut(rows.mapInArrow(_pack(block, every, False), packed).withColumn("block", F.monotonically_increasing_id()))
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // queries))
    asked = cut(asked.repartition(groups).mapInArrow(_pack(queries, every, True), packed).withColumn("q", F.monotonically_increasing_id()))
    slots = 4 * df.sparkSession.sparkContext.defaultParallelism
    # How many cells a block of queries visits: as many as there are blocks, as far as tasks can run.
    salts = max(1, min(index.count(), slots))
    blocks = index.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    numbers = asked.select("q", "dims")  # a row for QUERIES queries
    meets = join_small(blocks, numbers, "dims", "inner").select("q", "salt", F.lit(1).alias("kind"), "dims", "ids", "data")
    visits = asked.select("q", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "dims", "ids", "data")
    cells = visits.unionByName(meets).withColumn("cell", F.xxhash64("q", "salt"))
    tasks = min(2 * slots, max(1, salts * groups))
    gathered = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "kind").select("cell", "kind", "dims", "ids", "data")
    found = gathered.mapInArrow(_search(turns, k, radius), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
