"""Near-duplicates of word shingles: wide SimHash fingerprints meet in a byte-position index and are verified on the shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import cut, join_small
from .buckets import Groups, bounds, crowded, deal, first_met, gather, neighbours, numbers, sides, spread, stretches, values, words
from .simhash import _FOLD
from .vectors import pack_bits

#: Words of a shingle. Sets of a and b shingles are near if they share c with c / (a + b - c) >= 4 / 5, so 9 c >= 4 (a + b).
WORDS = 5
#: Bytes of a fingerprint: at the threshold 15 % of its bits differ, so 64 bits are too few to tell near from far.
BYTES = 32
#: Bits that near fingerprints differ in at most: 15 % are 39, and a deviation is 5.7.
DISTANCE = 64
#: Bytes that a pair must share at the same positions.
MATCHES = 4
#: Bits of a set's parities. Each shingle of one set alone flips one bit, so they bound the difference from below.
PARITY = 1024
#: Rows that a posting returns the pairs of; more are settled where they meet, in blocks of about so many.
SMALL, BLOCK = 64, 256
#: Index lists whose crowded postings are settled first, so that later ones need only look between components.
FIRST = 2


def plan(sets: int) -> tuple[int, list[tuple[int, ...]]]:
    """Positions a list, and the lists: position sets of the index that intersect that many byte lists.

    The positions are dealt to groups, and every choice inside a group is a list, so a pair
    meets as soon as one group holds enough shared bytes. At the threshold 3 % of pairs meet
    nowhere, at 0.85 0.6 %. Up to 2**26 sets two positions of six groups do (70 lists); beyond,
    postings would be long, and three positions of two groups take their place (1120 lists).
    """
    size, groups = (2, 6) if sets <= 1 << 26 else (3, 2)
    return size, [p for part in np.array_split(np.arange(BYTES), groups) for p in combinations(part.tolist(), size)]


def shingles(text: str | None) -> list[bytes]:
    """Shingles in order of the folded text, words cut as for fingerprints; a shorter text is one shingle."""
    said = (text or "").encode().translate(_FOLD).split()
    if len(said) < WORDS:
        return [b" ".join(said)] if said else []
    line = b" ".join(said)
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1)
    starts = np.concatenate(([0], ends[: len(said) - WORDS])).tolist()
    return [line[s:e] for s, e in zip(starts, (ends[WORDS - 1 :] - 1).tolist())]


def hashes(text: str | None) -> np.ndarray:
    """The set's 64-bit hashes, ascending."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, 42) for x in shingles(text)], np.uint64))


def _spread(found: np.ndarray) -> np.ndarray:
    """BYTES pseudo-random bytes of each hash, as words."""
    out = found[:, None] + np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set as words: a bit is set if it is in over half of the hashes' bytes."""
    ones = np.zeros(8 * BYTES, np.int64)
    for i in range(0, len(found), 1 << 14):
        ones += np.unpackbits(_spread(found[i : i + (1 << 14)]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).view(np.uint64)


def parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2
    return pack_bits(odd.astype(bool)[None])[0]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets are near."""
    least = 4 * (len(a) + len(b))
    return 9 * min(len(a), len(b)) >= least and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= least


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, codes, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = hashes(text)
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            codes.append(fingerprint(found).tobytes())
            sketches.append(parities(found).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "print", "digest", "size", "code", "parity"],
        )


def _masks(lists: list[tuple[int, ...]]) -> np.ndarray:
    bits = np.zeros((len(lists), BYTES), np.uint8)
    for mask, positions in zip(bits, lists):
        mask[list(positions)] = 0xFF
    return bits.view(np.uint64)


def _index(lists: list[tuple[int, ...]]):
    """A posting for each list of each set: the bytes at the list's positions are its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = words(batch.column(1)).view(np.uint8).astype(np.int64)
            for band, positions in enumerate(lists):
                key = np.zeros(len(code), np.int64)
                for p in positions:
                    key = (key << 8) | code[:, p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), band, np.int32)), pa.array(key), *(batch.column(i) for i in range(4))],
                    names=["band", "key", "node", "code", "size", "root"],
                )

    return run


def _open(code: np.ndarray, size: np.ndarray, a: np.ndarray, b) -> np.ndarray:
    """Which of the pairs of rows ``a`` and ``b`` may be near: those that share MATCHES bytes and differ in DISTANCE bits at most."""
    hit = np.flatnonzero(9 * np.minimum(size[a], size[b]) >= 4 * (size[a] + size[b]))
    other = b if np.isscalar(b) else b[hit]
    x = code[a[hit]] ^ code[other]
    few = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= DISTANCE
    hit, x = hit[few], x[few]
    tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1, dtype=np.int64)
    return hit[tally >= MATCHES]


def _pairs(masks: np.ndarray, most: int):
    """Pairs of small postings that are in different components so far, each in the first list that both are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in stretches(batches, (numbers, words, numbers, numbers)):
            band, (node, code, size, root), found = columns[0], columns[5:], []
            for left, right in neighbours(columns, most + 1):
                hit = np.flatnonzero(root[left] != root[right])
                hit = hit[_open(code, size, left[hit], right[hit])]
                found.append((left[hit], right[hit]))
            left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            fresh = first_met(code[left] ^ code[right], band[left], masks)
            a, b = node[left[fresh]], node[right[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each crowded posting, verified on the sets that come with the rows."""
    for columns in stretches(batches, (numbers, words, numbers, values)):
        node, code, size = columns[5:8]
        for start, stop in zip(*bounds(columns)):
            own = [np.frombuffer(x, np.uint64) for x in columns[8][start:stop]]
            odd, groups, a, b = np.stack([parities(x) for x in own]), Groups(stop - start), [], []
            for i, others in sides(columns, start, stop):
                others = others[groups.label[others - start] != groups.label[i - start]]
                others = others[_open(code, size, others, i)]
                others = others[_maybe(odd[others - start] ^ odd[i - start], size[others] + size[i])]
                for j in others:
                    if groups.label[j - start] != groups.label[i - start] and near(own[i - start], own[j - start]):
                        groups.unite(i - start, np.array([j - start]))
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rest(masks: np.ndarray):
    """Pairs of crowded postings that may be near and are in different components so far, each in its first list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in stretches(batches, (numbers, words, numbers, numbers, words)):
            node, code, size, root, odd = columns[5:]
            for start, stop in zip(*bounds(columns)):
                earlier = masks[: int(columns[0][start])]
                for i, others in sides(columns, start, stop):
                    others = others[root[others] != root[i]]
                    others = others[_open(code, size, others, i)]
                    others = others[_maybe(odd[others] ^ odd[i], size[others] + size[i])]
                    for mask in earlier:
                        if not len(others):
                            break
                        others = others[((code[others] ^ code[i]) & mask).any(axis=1)]
                    if len(others):
                        a, b = np.full(len(others), node[i]), node[others]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _maybe(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether parities leave a pair open."""
    return 9 * np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= sizes


def _by_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            hit = pa.array(_maybe(words(batch.column(2)) ^ words(batch.column(3)), numbers(batch.column(4))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are near."""
    for batch in batches:
        read = lambda i: (np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist())  # noqa: E731, B023
        hit = pa.array([near(a, b) for a, b in zip(read(2), read(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])


def _print():
    """What a text is found by again, so that no copy of the texts or sets is kept."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print")


def _texts_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "set"])


def _sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, set)`` of the asked nodes: each made again from one text."""
    wanted = cut(nodes.select("node", "print").join(asked, "node"))
    found = join_small(docs.select("text", _print()), wanted, "print", "inner").select("node", "text")
    return cut(found.mapInArrow(_texts_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")))


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Near ones of candidate pairs."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("parity").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", (F.col("sa") + F.col("sb")).alias("sizes"))
    open_ = cut(met.mapInArrow(_by_parities, "a long, b long"))
    found = _sets_of(open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct(), nodes, docs)
    both = open_.join(found.select(F.col("node").alias("a"), F.col("set").alias("ta")), "a").join(found.select(F.col("node").alias("b"), F.col("set").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"))


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``(doc_id, component_id)`` for every row: documents whose five-word shingle sets have a similarity of 4/5 are linked.

    Equal sets are one node, so copies cost one posting; texts without a word, null ones too, are
    equal. Postings of BYTES-byte fingerprints name candidates (see ``plan`` for what they miss), tallies of shared
    bytes, bits, sizes and parities reject, and only the shingles' 64-bit hashes link. Pairs
    inside one component are not all compared. Crowded postings are settled where they meet:
    the first lists return a spanning forest, the others only open pairs between components.
    Very long texts are hashed whole. Repeated rows each return a row; a null doc_id names no
    component unless it has no other member (then component_id is null). An empty table gives
    an empty result; other columns are ignored.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = {"print": T.StringType(), "digest": T.BinaryType(), "size": T.LongType(), "code": T.BinaryType(), "parity": T.BinaryType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds.items())])
    rows = cut(docs.select("doc_id", "text", _print()).mapInArrow(_sets, schema))
    nodes = cut(
        rows.groupBy("digest").agg(F.first(F.struct("print", "size", "code", "parity")).alias("s"), F.min("doc_id").alias("least"))
        .select("digest", "least", "s.*").withColumn("node", F.monotonically_increasing_id())
    )
    size, lists = plan(count := nodes.count())
    masks, most = _masks(lists), small + 4 * (count >> (8 * size))
    posting = "band int, key long, node long, code binary, size long, root long"

    def index(of: DataFrame, root, own: list) -> DataFrame:
        return spread(of.where("size > 0").select("node", "code", "size", root.alias("root")), count * len(own)).mapInArrow(_index(own), posting)

    early = index(nodes, F.col("node"), lists[:FIRST])
    hot = crowded(early, most, block)
    known = None
    if hot.limit(1).count():
        _, warm = deal(early, hot)
        sets = _sets_of(warm.select("node").distinct(), nodes, docs)
        first = cut(gather(warm.join(sets, "node"), "node", "code", "size", "set").mapInArrow(_first_links, "a long, b long"))
        known = cut(components(first))
        placed = nodes.join(known, "node", "left")
    else:
        placed = nodes.withColumn("root", F.lit(None).cast("long"))
    postings = index(placed, F.coalesce("root", "node"), lists)
    hot = crowded(postings, most, block)
    cold, warm = deal(postings, hot)
    pairs = gather(cold, "node", "code", "size", "root").mapInArrow(_pairs(masks, most), "a long, b long")
    if hot.limit(1).count():
        full = gather(warm.join(nodes.select("node", "parity"), "node"), "node", "code", "size", "root", "parity")
        pairs = pairs.unionByName(full.mapInArrow(_rest(masks), "a long, b long"))
    links = _links(pairs, nodes, docs)
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links)
    placed = nodes.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "digest").join(placed.join(lowest, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the smallest of its component.

    Rows that share a doc_id, a null one too, are one document: they stay or go together.
    Null ids stay if one of them is alone in its component. Texts are not shuffled as long
    as the ids that go are few enough to be broadcast.
    """
    found = near_components(df, doc_id, text)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut(found.groupBy("doc_id").agg(stays.alias("stays")).where(~F.col("stays")).select(F.col("doc_id").alias("_mr_gone")))
    return join_small(df, gone, df[doc_id].eqNullSafe(F.col("_mr_gone")), "left_anti")
