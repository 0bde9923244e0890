"""Near-duplicates of five-word similarity 0.8 against all pairs."""

import random

import numpy as np
import pytest
from test_text_operators import plain_components

import corpus_pipeline as pipeline
from millrace.llm import shingles


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_near(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    return [(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 5 * len(a & b) >= 4 * len(a | b)]


def edited():
    """Texts, edits of them on both sides of the threshold, a group of near copies, and odd ones."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.choice([6, 40, 150, 400]))] for _ in range(60)]
    for base in list(texts):
        for share in (0.005, 0.01, 0.02, 0.03):
            texts.append([rng.choice(words) if rng.random() < share else w for w in base])
    group = [rng.choice(words) for _ in range(200)]
    texts += [[rng.choice(words) if rng.random() < 0.01 else w for w in group] for _ in range(60)]
    said = [" ".join(t) for t in texts] + ["", None, " ", "one two", "ONE two", "a b c d e"]
    return {i: t for i, t in enumerate(said)}


def odd_ones(texts):
    return [(i, j) for i in texts for j in texts if i < j and not plain_set(texts[i]) and not plain_set(texts[j])]


@pytest.mark.parametrize(("small", "block"), [(shingles.SMALL, shingles.BLOCK), (3, 1000), (3, 4)])
def test_near_components(spark, small, block):
    """Whether postings return their pairs, are settled whole or in blocks."""
    texts = edited()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_components(df, small=small, block=block).collect()}
    assert got == plain_components([*plain_near(texts), *odd_ones(texts)], texts)


def test_stage_drops_edited_copies(spark):
    texts = edited()
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in pipeline.simhash_stage(spark, df, "").collect()}
    assert left == set(plain_components([*plain_near(texts), *odd_ones(texts)], texts).values()) and len(left) < len(texts) - 100


def test_pairs_at_the_threshold_meet():
    """Of pairs of similarity 0.8 to 0.82, made from random sets, some 3 % meet in no list or are rejected."""
    rng, met, n = np.random.default_rng(11), 0, 1500
    _, lists = shingles.plan(10**5)
    for _ in range(n):
        size = int(rng.integers(30, 600))
        both = rng.integers(0, 1 << 63, size + 2 * (size // 10), np.int64).astype(np.uint64)
        own = size // 10
        a, b = both[: size + own], np.concatenate([both[:size], both[size + own :]])
        assert shingles.near(np.unique(a), np.unique(b))
        code = np.stack([shingles.fingerprint(a), shingles.fingerprint(b)])
        x = (code[0] ^ code[1]).view(np.uint8)
        met += bool(len(shingles._open(code, np.array([len(a), len(b)]), np.array([0]), 1))) and any((x[list(p)] == 0).all() for p in lists)
    assert met / n > 0.96


def test_null_ids_and_repeats(spark):
    said = "a b c d e f g h"
    data = [(None, said), (3, said), (None, "one of its own"), (5, "x"), (5, said), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, component_id string")
    got = sorted(map(repr, ((r["doc_id"], r["component_id"]) for r in shingles.near_components(df).collect())))
    assert got == sorted(map(repr, [(None, 3), (3, 3), (None, None), (5, 5), (5, 3), (7, 7), (8, 7)]))
    left = sorted(map(repr, ((r["doc_id"], r["text"]) for r in shingles.keep_one(df).collect())))
    assert left == sorted(map(repr, [(None, said), (None, "one of its own"), (3, said), (5, "x"), (5, said), (7, None)]))
    assert shingles.near_components(df.limit(0)).count() == 0
