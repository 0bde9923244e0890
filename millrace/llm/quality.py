"""Quality by compression: zstandard dictionaries of good and bad text, calibrated sizes."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

THRESHOLD = 0.3
#: Texts are compressed in pieces of this many bytes, so that the dictionary weighs on all of a text.
PIECE = 8192
#: Size of a dictionary, and the level that both are used at.
DICTIONARY, LEVEL = 112_640, 3
#: The bounded training sample: labelled documents of each class, smallest hashes first. Half of them build
#: its dictionary: whole texts of at most so many code points. The others, of any length, calibrate.
SAMPLE_DOCS, SAMPLE_POINTS = 3000, 8192
#: Bytes that a text counts as longer, and the power of its length that a difference is divided by.
SHORT, POWER = 100, 0.7


@dataclass
class Model:
    """Two dictionaries and the calibration of the features, a constant last."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self):
        return [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            for d in (self.good, self.bad)
        ]


def features(text: str | None, compressors) -> tuple[float, float, float]:
    """The normalised difference of the sizes under the two dictionaries, the size per byte, and how short the text is.

    The difference of a text of one kind grows with its length n, its noise with the root of n: it is
    divided by ``(n + SHORT) ** POWER``. What a difference says depends on how far the text compresses at
    all and on how much of it there is, so the calibration is told both. Of the whole text, a piece at a time; (0, 0, 1) if it is empty.
    """
    data = memoryview((text or "").encode())
    good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, data.nbytes, PIECE)) for c in compressors)
    length = data.nbytes + SHORT
    return (bad - good) / length**POWER, good / length, SHORT / length


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def score(text: str | None, model: Model, compressors) -> float:
    return _sigmoid(sum(w * x for w, x in zip(model.weights, (*features(text, compressors), 1.0))))


def _dictionary(texts: list[str]) -> bytes:
    pieces = [d[i : i + PIECE] for d in (t.encode() for t in texts) for i in range(0, len(d), PIECE)]
    total = sum(map(len, pieces))
    for size in (DICTIONARY, DICTIONARY // 4, DICTIONARY // 16):
        if total >= 8 * size and len(pieces) >= 16:
            try:
                return zstandard.train_dictionary(size, pieces).as_bytes()
            except zstandard.ZstdError:
                continue
    return b"".join(pieces)  # too little to train on: the texts themselves


def _own_lines(texts: dict[int, list[str]]) -> dict[int, list[str]]:
    """The texts, each once, without lines that two of them hold, whatever their class.

    Boilerplate tells nothing about quality, and a dictionary that holds a common line makes
    any short text with it look like its class. Copies count as one text.
    """
    holders = Counter(line for t in {*texts[0], *texts[1]} for line in {*t.split("\n")})
    kept = {label: ["\n".join(x for x in t.split("\n") if holders[x] == 1) for t in dict.fromkeys(own)] for label, own in texts.items()}
    return {label: own if any(own) else texts[label] for label, own in kept.items()}


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton steps; y has both classes."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        hess = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 20 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, h, length, quality)`` of the labelled documents that have a text.

    Labels that contradict each other say nothing. Of rows that share an id, the text of the smallest hash counts.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    marked = marked.where("quality = most").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = docs.where("length(text) > 0").select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("length")).alias("t")).join(marked, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("t").alias("t"), F.first("quality").alias("quality")).select("doc_id", "t.*", "quality")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, points: int = SAMPLE_POINTS) -> Model:
    """Fit on the texts of ``labels`` (doc_id, quality 0 or 1).

    The sample is drawn from the labelled documents that have a text: of each class, and of
    each half of the ids by their hash, the ``sample / 2`` of the smallest hashes. One half builds the class's
    dictionary, from whole texts of at most ``points`` code points, so at most ``sample * points`` code
    points reach the driver; the other half calibrates, whole texts of any length being compressed where
    they lie. If a class lacks texts in either half there is nothing to learn: every text then scores
    the share of good labels (0.5 without labels).
    """
    known = cut(_known(docs, labels))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    build = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    drawn = lambda half: [r for label in (0, 1) for r in known.where((F.col("quality") == label) & half).orderBy(*order).limit(sample // 2).collect()]
    halves = [drawn(build & (F.col("length") <= points)), drawn(~build)]

    def texts_of(rows: list) -> DataFrame:
        ids = docs.sparkSession.createDataFrame(rows, known.schema)
        return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(ids), ["doc_id", "h"])

    if min(sum(r["quality"] == label for r in half) for half in halves for label in (0, 1)) == 0:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(b"", b"", (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    found = {r["doc_id"]: r["text"] for r in texts_of(halves[0]).select("doc_id", "text").collect()}
    built = _own_lines({label: [found[r["doc_id"]] for r in halves[0] if r["quality"] == label] for label in (0, 1)})
    model = Model(_dictionary(built[1]), _dictionary(built[0]), ())
    measured = with_features(texts_of(halves[1]), model).select("doc_id", "quality", "_mr_x.*").distinct().orderBy("doc_id").collect()
    x, y = np.array([(r["difference"], r["size"], r["short"]) for r in measured]), np.array([r["quality"] for r in measured], float)
    *weights, constant = _calibrate(x, y)
    # The sample holds as many of both classes; the constant restores their share among the labels.
    constant += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(model.good, model.bad, (*weights, constant))


def with_features(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``_mr_x``: the features of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("difference double, size double, short double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        compressors = shared.value.compressors()
        return pd.DataFrame([features(t, compressors) for t in texts], columns=["difference", "size", "short"])

    return df.withColumn("_mr_x", measured(F.col(text)))


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1; empty and null texts get the score of a text of no length."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        compressors = shared.value.compressors()
        return pd.Series([score(t, shared.value, compressors) for t in texts], dtype="float64")

    return df.withColumn(out, scored(F.col(text)))


def remainder(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents whose crc32(doc_id) leaves a remainder."""
    wanted = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    return fit(docs, wanted)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores depend on the text alone, all of it however long. Null and empty texts score alike, repeated rows
    each return a row, a null doc_id is held out of nothing (held_out is false), an
    empty table gives an empty result; labels of unknown documents and labels that
    contradict each other are ignored. A score equal to the threshold is accepted.
    """
    scored = with_score(docs.select("doc_id", "text"), fit_on_labels(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return with_score(docs, fit_on_labels(docs, labels), out="_score").where(F.col("_score") >= threshold).drop("_score")
