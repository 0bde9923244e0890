"""The stages against plain Python, one after the other, and the registered SQL of the operators."""

import os
import re
from collections import defaultdict

import duckdb
import pytest
from conftest import ROOT  # noqa: F401
from test_shingles import odd_ones, plain_near
from test_text_operators import plain_components, plain_lines, plain_targets

import corpus_pipeline as pipeline
from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage returned, in order; the first is the input."""
    where = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{where}/{name}")
        frames.append(spark.read.parquet(f"{where}/{name}"))
    return [[r.asDict() for r in f.collect()] for f in frames]


def test_quality_stage(spark, staged):
    docs, kept = staged[0], staged[1]
    predicted = {r["doc_id"]: r["predicted"] for r in QUERIES["op5_quality"](spark, SF).collect()}
    assert sorted(kept, key=repr) == sorted((d for d in docs if predicted[d["doc_id"]]), key=repr)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {d["doc_id"] for d in kept}
    good = [i for i, q in labels.items() if q]
    assert sum(i in left for i in good) / len(good) > 0.95


def test_line_stage(staged):
    before, after = staged[1], staged[2]
    assert sorted((d["doc_id"], d["text"]) for d in after) == sorted((r[0], r[3]) for r in plain_lines([(d["doc_id"], d["text"]) for d in before]))
    assert all(d["n_chars"] == len(d["text"]) for d in after) and set(after[0]) == set(before[0])


def test_simhash_stage(staged):
    """One document of each group of five-word similarity 0.8, as the job sets it for stages on word shingles."""
    before, after = staged[2], staged[3]
    texts = {d["doc_id"]: d["text"] for d in before}
    lowest = set(plain_components([*plain_near(texts), *odd_ones(texts)], texts).values())
    assert sorted(after, key=repr) == sorted((d for d in before if d["doc_id"] in lowest), key=repr) and len(after) < len(before)


def test_mix_stage(staged):
    before, after = staged[3], staged[4]
    words = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in before:
        size[d["source"]] += words(d)
        largest[d["source"]] = max(largest[d["source"]], words(d))
    copies = defaultdict(int)
    for d in after:
        taken[d["source"]] += words(d)
        copies[d["doc_id"]] += 1
    assert all(abs(taken[s] - t) <= largest[s] / 2 for s, t in plain_targets(size).items()) and max(copies.values()) <= 3
    assert set(after[0]) == set(before[0])


def test_encode_stage(staged):
    import hashlib

    texts = {d["doc_id"]: d["text"] for d in staged[4]}
    assert sorted(d["doc_id"] for d in staged[5]) == sorted(d["doc_id"] for d in staged[4])
    assert all(d["decoded_sha256"] == hashlib.sha256(texts[d["doc_id"]].encode()).hexdigest() and d["n_tokens"] > 0 for d in staged[5])


def test_run_is_the_stages(spark, staged):
    assert sorted((r.asDict() for r in pipeline.run(spark, SF).collect()), key=repr) == sorted(staged[5], key=repr)


def test_stages_take_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, a very long text and a clashing column; then no rows at all."""
    long = "w " * 50_000
    data = [(1, None, None, None, None, "x"), (None, "some text", None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, long, "en", "a", 100_000, "x"), (2, long, "en", "a", 100_000, "x"), (4, "some text", "en", "b", 9, "x")]
    odd = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string")
    stages = dict(pipeline.STAGES)
    got = lambda name, docs: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, SF).collect()), key=repr)
    want = sorted(((d[0], d[1]) for d in data), key=repr)
    kept = got("quality", odd)
    assert set(kept) <= set(want) and all(kept.count(d) == want.count(d) for d in kept)
    assert got("lines", odd) == sorted(((i, t or "") for i, t in want), key=repr)
    # Rows of one id stay together: 1 holds both empty texts, and the null id goes for document 4.
    assert got("simhash", odd) == sorted([(1, None), (1, ""), (2, long), (2, long), (4, "some text")], key=repr)
    assert set(got("mix", odd)) <= set(want)
    encoded = stages["encode"](spark, odd, SF).collect()
    assert len(encoded) == len(data) and sorted(r["n_tokens"] > 0 for r in encoded) == [False, False, True, True, True, True]
    for name in stages:
        assert stages[name](spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    show = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(got.select(*columns).collect()) == show(want)


def test_ten_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))
