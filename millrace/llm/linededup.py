"""Line de-duplication: two Bloom filters pick suspected repeats, which alone are confirmed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_small

BLANK = b" \t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Filter bits per byte of input as planned, and the bounds of a filter. The upper bound,
#: 128 MB, bounds what is broadcast; a fuller filter only suspects more, the result stays exact.
BITS_PER_BYTE, LEAST_BITS, MOST_BITS = 0.25, 1 << 23, 1 << 30
#: Bits of one part of a filter, merged in one task.
PART_BITS = 1 << 22
#: Stands for a null doc_id, below every other.
NO_ID = -(1 << 63)


def _long(key: bytes, least: int) -> bool:
    """Whether a key has that many code points; a code point has 4 bytes at most."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode(errors="replace")) >= least)


def line_keys(data: bytes) -> list[bytes]:
    """The key of each line of a text in UTF-8: without white space (09-0D, 20) at both ends, A-Z lower-cased."""
    return [line.strip(BLANK) for line in data.translate(_FOLD).split(b"\n")]


def long_keys(data: bytes | None, least: int) -> set[bytes]:
    return {k for k in line_keys(data or b"") if _long(k, least)}


def filter_bits(df: DataFrame) -> int:
    """A power of two that follows the planned size of the input, within the bounds."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # the plan's statistics are a hint; any filter size gives the same result
        size = 0
    if size > 1 << 55:  # unknown
        size = 0
    wanted = max(LEAST_BITS, min(MOST_BITS, int(size * BITS_PER_BYTE)))
    return 1 << (wanted - 1).bit_length()


def _positions(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key and its probes inside that part, from one 64-bit hash."""
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(k) for k in keys], np.uint64)
    parts = (h >> np.uint64(44)) % np.uint64(max(1, bits // PART_BITS))
    width = np.uint64(min(bits, PART_BITS) - 1)
    probes = np.stack([h & width, (h >> np.uint64(22)) & width], axis=1).astype(np.uint32)
    return parts.astype(np.int32), probes


def _seen(bits: int, least: int):
    """Per task and part: the bits that keys set once, and those set again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        count = 0

        def flush():
            rows = []
            for part, pieces in held.items():
                once, n = np.unique(np.concatenate(pieces), return_counts=True)
                rows.append((part, once.astype("<u4").tobytes(), once[n > 1].astype("<u4").tobytes()))
            held.clear()
            if rows:
                p, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "once", "twice"])

        for batch in batches:
            keys = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                keys += long_keys(text, least)
            if not keys:
                continue
            parts, probes = _positions(keys, bits)
            order = np.argsort(parts, kind="stable")
            parts, probes = parts[order], probes[order]
            at = np.flatnonzero(np.diff(parts)) + 1
            for piece, part in zip(np.split(probes, at), parts[np.concatenate(([0], at))]):
                held.setdefault(int(part), []).append(piece.ravel())
            count += len(keys)
            if count >= 1 << 21:
                yield from flush()
                count = 0
        yield from flush()

    return run


def _merge(bits: int):
    """Merge partial filters of a part: what one has set once and another too is set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, pack = min(bits, PART_BITS), zstandard.ZstdCompressor(level=1)
        now, once, twice = None, None, None

        def out():
            data = pack.compress(np.packbits(twice).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], names=["part", "filter"])

        for batch in batches:
            for part, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != now:
                    if now is not None:
                        yield out()
                    now, once, twice = part, np.zeros(width, bool), np.zeros(width, bool)
                a = np.frombuffer(a, "<u4")
                twice[a[once[a]]] = True
                once[a] = True
                twice[np.frombuffer(b, "<u4")] = True
        if now is not None:
            yield out()

    return run


def twice_filter(docs: DataFrame, least: int, bits: int) -> dict[int, bytes]:
    """The twice-seen filter, by part. At most ``MOST_BITS`` bits, whatever the input."""
    partial = docs.select("text").mapInArrow(_seen(bits, least), "part int, once binary, twice binary")
    whole = partial.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(bits), "part int, filter binary")
    return {row["part"]: bytes(row["filter"]) for row in whole.collect()}


_open: dict = {}


def _filter(shared) -> dict[int, np.ndarray]:
    """The broadcast filter, unpacked once a worker."""
    if _open.get("of") is not shared.value:
        unpack = zstandard.ZstdDecompressor()
        _open.update(of=shared.value, parts={k: np.frombuffer(unpack.decompress(v), np.uint8) for k, v in shared.value.items()})
    return _open["parts"]


def _suspects(shared, bits: int, least: int):
    """Keys whose probes are all in the twice-seen filter, once a row: (digest, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = _filter(shared)
        for batch in batches:
            keys, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = long_keys(text, least)
                keys += found
                docs += [NO_ID if doc is None else doc] * len(found)
            if not keys:
                continue
            parts, probes = _positions(keys, bits)
            hit = np.zeros(len(keys), bool)
            for part in np.unique(parts):
                if (data := parts_of.get(int(part))) is not None:
                    own = np.flatnonzero(parts == part)
                    p = probes[own]
                    hit[own] = ((data[p >> 3] >> (7 - (p & 7))) & 1).all(axis=1)
            own = np.flatnonzero(hit)
            if len(own):
                digests = [hashlib.blake2b(keys[i], digest_size=16).digest() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([docs[i] for i in own], pa.int64())], names=["key", "doc"])

    return run


def repeats(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """``(doc, drop)``: per document the digests of the keys it must lose."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = filter_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, least, bits))
    held = cut(docs.mapInArrow(_suspects(shared, bits, least), "key binary, doc long").distinct())
    spread = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where(F.col("n") >= documents).drop("n"))
    return join_small(held, spread, "key", "inner").where("doc < last").groupBy("doc").agg(F.collect_list("key").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """Add ``kept`` (text), ``n_lines`` and ``n_dropped`` to every row of ``docs``.

    Lines are cut at ``\\n``; null and empty texts are one empty line and keep "".
    A key of at least ``least`` code points held by at least ``documents`` different
    doc_ids goes from all documents but the largest holding it, repeats inside a
    document included. Rows that share a doc_id are one document; null ids are one
    document below all others. An empty table gives an empty result; all other
    columns pass through.
    """
    lists = cut(repeats(docs, least, documents))
    rows = docs.withColumn("_mr_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = rows.join(lists.select(F.col("doc").alias("_mr_doc"), F.col("drop").alias("_mr_drop")), "_mr_doc", "left")

    @F.pandas_udf("kept string, n_lines long, n_dropped long")
    def clean(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops):
            text = text or ""
            if drop is None or not len(drop):
                out.append((text, text.count("\n") + 1, 0))
                continue
            gone, data = {bytes(x) for x in drop}, text.encode()
            lines = list(zip(data.split(b"\n"), line_keys(data)))
            kept = [line for line, key in lines if not _long(key, least) or hashlib.blake2b(key, digest_size=16).digest() not in gone]
            out.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    return rows.withColumn("_mr_r", clean("text", "_mr_drop")).drop("_mr_drop", "_mr_doc").withColumns(
        {c: F.col(f"_mr_r.{c}") for c in ("kept", "n_lines", "n_dropped")}
    ).drop("_mr_r")


def line_dedup_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the op7 query."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{upper}', '{lower}') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}) AS s,
    LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) AS n),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (WHERE last IS NOT NULL AND doc_id <> last)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN r USING (k) GROUP BY doc_id"""
