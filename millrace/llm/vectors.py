"""What the vector operators share: valid unit vectors, packed blocks, seeded rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column that take part, as double precision, and their positions: one pair for each length.

    Null vectors, vectors with null or non-finite components, zero vectors and empty ones take no part.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    widths = np.diff(offsets)
    if not len(widths):
        return []
    values = column.values
    flat = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
    if values.null_count:
        flat = np.where(np.asarray(values.is_null()), np.nan, flat)
    if column.null_count:
        widths = np.where(np.asarray(column.is_null()), 0, widths)
    out = []
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        data = flat[offsets[at][:, None] + np.arange(width)]
        good = np.isfinite(data).all(axis=1) & (np.abs(data).max(axis=1) > 0)
        if good.any():
            out.append((data[good], at[good]))
    return out


def unit(data: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    data = data / np.abs(data).max(axis=1, keepdims=True)
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def rotation(rows: int, columns: int, seed: int) -> np.ndarray:
    """Orthonormal random columns; several rotations side by side if there are more columns than rows."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < columns:
        q, r = np.linalg.qr(rng.standard_normal((rows, rows)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)[:, :columns]


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of unsigned 64-bit words."""
    pad = -signs.shape[1] % 64
    if pad:
        signs = np.concatenate([signs, np.zeros((len(signs), pad), bool)], axis=1)
    return np.packbits(signs, axis=1).view(">u8").astype(np.uint64)
