"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pieces of a generation whose ids a worker remembers; two generations are held.
REMEMBERED = 300_000
#: Bytes of text split at a time.
STRETCH = 1 << 20


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("packed ids are native unsigned integers of 4 bytes, lowest first")


class Coder:
    """Encodes pieces of the pattern by the ranks, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(path), byte_characters()
        name = lambda token: "".join(letters[b] for b in token)
        merges = [
            (name(token[:i]), name(token[i:]))
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {r: t for t, r in ranks.items()}
        # White space as Unicode defines it, which \s is in the library that the ranks were made for.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, parts: list[list[str]]) -> None:
        """Make every piece known. What one generation of pieces used lives on in the next."""
        known, older = self.known, self.older
        fresh = [p for p in set().union(*parts) if p not in known]
        if not fresh:
            return
        if len(known) + len(fresh) > REMEMBERED:
            self.older, self.known = older, known = known, {}
            fresh = set().union(*parts)
        unseen = []
        for piece in fresh:
            if (ids := older.get(piece)) is None:
                unseen.append(piece)
            else:
                known[piece] = ids
        found = self.tokenizer.encode_batch_fast(unseen, add_special_tokens=False)
        known.update({piece: array("I", e.ids).tobytes() for piece, e in zip(unseen, found)})

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; empty for null.

        What the texts of a batch have not in common with earlier ones goes to the library at once.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            self.learn([pieces for _, pieces in held])
            for i, pieces in held:
                out[i].append(b"".join(map(self.known.__getitem__, pieces)))
            held.clear()

        for i, text in enumerate(texts):
            for part in stretches(text or ""):
                held.append((i, self.split(part)))
                size += len(part)
                if size >= STRETCH:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Each token's code points, [start, end): a character split over tokens belongs to each of them."""
        data = np.frombuffer(text.encode(), np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return [(int(point[s]), int(point[e - 1]) + 1) for s, e in zip(starts, ends)]


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """Cut a long text before a space that follows and precedes other characters.

    No match of the pattern runs over such a place: every alternative takes a space
    only at its start or among white space.
    """
    at = 0
    place = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
    while len(text) - at > most:
        found = place.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def text_pieces(coder: Coder, chunks) -> Iterator[str]:
    """Decode id arrays to text as they come; a character split over tokens waits for its rest."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in chunks:
        yield decoder.decode(coder.decode_bytes(ids))
    yield decoder.decode(b"", True)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids array<int>`` (and ``offsets``): no special tokens, none for null and empty texts."""
    kind = "ids array<int>" + (", offsets array<struct<start:int,end:int>>" if offsets else "")

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = coder(path, pattern), []
        for text, packed in zip(texts, own.encode_many(texts)):
            ids = np.frombuffer(packed, "<u4").astype(np.int32)
            rows.append((ids, own.offsets(text or "", ids)) if offsets else (ids,))
        return pd.DataFrame(rows, columns=["ids", "offsets"][: 1 + offsets])

    names = ["ids", "offsets"][: 1 + offsets]
    return df.withColumn("_bpe", run(F.col(text))).withColumns({n: F.col(f"_bpe.{n}") for n in names}).drop("_bpe")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; bytes that are not UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        own = coder(path, pattern)
        return pd.Series([None if x is None else "".join(text_pieces(own, np.array_split(np.asarray(x), max(1, len(x) >> 16)))) for x in lists])

    return df.withColumn(out, run(F.col(ids)))


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` beside the columns of ``df``.

    Ids are encoded, packed, unpacked and decoded again; the last digest is of the
    decoded bytes. Null and empty texts have no tokens and the digest of nothing.
    Each row stands alone: repeated rows repeat, an empty table stays empty, other
    columns pass through.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = coder(path, pattern), []
        for packed in own.encode_many(texts):
            ids, digest = np.frombuffer(packed, "<u4"), hashlib.sha256()
            for i in range(0, len(ids), 1 << 16):
                digest.update(own.decode_bytes(ids[i : i + (1 << 16)]))
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), digest.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn("_bpe", run(F.col(text))).withColumns({n: F.col(f"_bpe.{n}") for n in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_bpe")
