import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import ann, embdedup, urls, vectors, warc

VEC = "vec_id long, embedding array<float>, label int"


def frame(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in data], VEC)


def units(data):
    a = np.array(data, np.float32).astype(float)
    return a / np.linalg.norm(a, axis=1)[:, None]


def plain_dedup(ids, data, cosine=0.95):
    near = units(data) @ units(data).T >= cosine
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(near[a]):
            x, y = find(ids[a]), find(ids[int(b)])
            parent[max(x, y)] = min(x, y)
    return {i: (int(near[k].sum()) - 1, find(i), find(i) == i) for k, i in enumerate(ids)}


def cloud(seed=1, n=400, dims=64):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dims))
    for k in range(0, n // 2):
        data[k] = data[k % 12] + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.3])
    return data


@pytest.mark.parametrize(("block", "small"), [(4096, 48), (4096, 4), (2, 4)])
def test_embedding_dedup(spark, block, small):
    """Whether buckets return their pairs, are settled whole or in blocks."""
    data = cloud()
    ids = list(range(len(data)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.embedding_dedup(frame(spark, zip(ids, data)).withColumn("node", F.lit("x")), block=block, small=small).collect()}
    want = plain_dedup(ids, data)
    assert got == want and sum(v[0] for v in want.values()) > 500


def two_lengths(long_share):
    """Vectors of 64 and of 16 dimensions side by side, most of them of either length, every vector twice."""
    rng, out = np.random.default_rng(8), []
    many, few = cloud(3, 120), cloud(4, 40, 16)
    if not long_share:
        many, few = cloud(4, 120, 16), cloud(3, 40)
    for k, v in enumerate(rng.permutation(160)):
        out.append((k, many[v] if v < 120 else few[v - 120]))
    return out + [(1000 + i, v) for i, v in out]


def by_length(data):
    return [[(i, v) for i, v in data if len(v) == n] for n in sorted({len(v) for _, v in data})]


@pytest.mark.parametrize("long_share", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_embedding_dedup_of_two_lengths(spark, long_share, parts):
    data = two_lengths(long_share)
    want = {}
    for own in by_length(data):
        want |= plain_dedup([i for i, _ in own], [v for _, v in own])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.embedding_dedup(frame(spark, data).repartition(parts), small=4).collect()}
    assert got == want


def test_crowded_buckets_return_no_pairs(spark):
    """A group's rows come back as counts and a forest, not as its pairs, whatever its size."""
    rng = np.random.default_rng(9)
    data = vectors.unit(rng.standard_normal(64) + 0.01 * rng.standard_normal((300, 64)))
    got = embdedup.embedding_dedup(frame(spark, enumerate(data))).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}
    turn = embdedup._turn(64)
    r = data @ turn
    code, factor = vectors.pack_bits(r > 0), np.abs(r).sum(axis=1) / 16
    masks, zeros = embdedup._band_masks(8, 1), np.zeros(300, np.int32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(zeros.astype(np.int64)), pa.array(zeros.astype(np.int64)), pa.array(zeros), pa.array(zeros), pa.array(zeros), pa.array(np.arange(300)), pa.array([c.tobytes() for c in code]), pa.array([u.tobytes() for u in data]), pa.array(factor), pa.array(np.ones(300, np.int64))],
        names=list("abcdefghij"),
    )
    out = [row for b in embdedup._settle(masks, 0.95)([batch]) for row in b.to_pylist()]
    assert len(out) == 300 + 299 and sum(row["others"] for row in out) == 300 * 299


def test_embedding_dedup_odd_rows(spark):
    v = [1.0, 2.0, 3.0, -4.0]
    data = [(0, v), (1, [2 * x for x in v]), (2, v), (2, v), (3, None), (4, [0.0] * 4), (5, [None, 1.0, 1.0, 1.0]), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf")] * 4), (None, v), (8, []), (9, [1.0, 0.0, 0.0, 0.0])]
    got = rows(embdedup.embedding_dedup(frame(spark, data)), "vec_id", "n_links", "component_id", "kept")
    linked = [(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (2, 4, 0, False), (None, 4, 0, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)], key=repr)
    assert embdedup.embedding_dedup(frame(spark, [])).count() == 0
    assert rows(embdedup.embedding_dedup(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_estimates_are_near_and_bounded():
    data = vectors.unit(np.random.default_rng(0).standard_normal((500, 64)))
    turn = embdedup._turn(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    r = data @ turn
    code, factor = vectors.pack_bits(r > 0), np.abs(r).sum(axis=1) / 16
    other = vectors.unit(data + 0.03 * np.random.default_rng(1).standard_normal(data.shape))
    true = (data * other).sum(axis=1)
    value, slack = embdedup.estimate(code, factor, other, 0.95)
    assert abs((value - true).mean()) < 0.005
    near = true >= 0.95
    assert near.all() and (value + slack >= 0.95)[near].all()
    far, _ = embdedup.estimate(code, factor, np.roll(data, 1, axis=0), 0.95)
    assert (far + slack < 0.95).mean() > 0.99


def test_bands_follow_the_rows():
    assert embdedup.plan_bands(1)[0] == 8 and embdedup.plan_bands(10**9)[0] == 28
    for n in (10, 10**4, 10**6, 10**9):
        bits, bands = embdedup.plan_bands(n)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** bands <= embdedup.MISSED * 1.001


def test_codes_at_the_threshold_meet_in_a_band():
    """Distances of real codes, not of independent bands: no more is missed as rows grow."""
    rng = np.random.default_rng(3)
    one, other = vectors.unit(rng.standard_normal((100_000, 64))), rng.standard_normal((100_000, 64))
    other = vectors.unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    turn = embdedup._turn(64)
    two = 0.95 * one + np.sqrt(1 - 0.95**2) * other
    differ = np.bincount(((one @ turn > 0) != (two @ turn > 0)).sum(axis=1), minlength=257)
    for n in (51_282, 3 * 10**6):
        bits, bands = embdedup.plan_bands(n)
        alike = np.array([np.prod([(256 - d - i) / (256 - i) for i in range(bits)]) if 256 - d >= bits else 0.0 for d in range(257)])
        assert (differ * (1 - alike) ** bands).sum() / differ.sum() < 1e-5


# -- nearest neighbours --------------------------------------------------------------


def plain_nearest(ids, data, every=50, k=5):
    u, out = units(data), {}
    for q, i in enumerate(ids):
        if i % every == 0:
            scores = (u * u[q]).sum(axis=1)
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-scores[j], ids[j]))[:k]
            out[i] = [(ids[j], scores[j]) for j in order]
    return out


@pytest.mark.parametrize(("block", "queries"), [(16_384, 2_048), (130, 3)])
def test_search_recall(spark, block, queries):
    data = np.random.default_rng(2).standard_normal((900, 64))
    ids = list(range(900))
    df = frame(spark, zip(ids, data)).repartition(3).withColumn("rank", F.lit("x"))
    got = ann.search(df, block=block, queries=queries).collect()
    want, hit = plain_nearest(ids, data), 0
    for r in got:
        assert r["vec_id"] != r["query_id"]
        hit += r["vec_id"] in {v for v, _ in want[r["query_id"]]}
        if r["rank"] == 1 and r["vec_id"] == want[r["query_id"]][0][0]:
            assert abs(r["score"] - want[r["query_id"]][0][1]) < 1e-12
    assert len(got) == 18 * 5 and hit / len(got) >= 0.9


def test_search_ties_and_odd_rows(spark):
    v = [1.0, 1.0, 0.0]
    data = [(0, v), (3, v), (1, v), (2, [2.0, 2.0, 0.0]), (4, [0.0, 0.0, 1.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (8, [float("nan")] * 3), (None, v), (50, None), (9, [1.0, 2.0])]
    got = rows(ann.search(frame(spark, data)), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert ann.search(frame(spark, [])).count() == 0 and ann.search(frame(spark, [(0, v)])).count() == 0
    twice = rows(ann.search(frame(spark, [(0, v), (0, v), (1, v), (1, v), (2, [1.0, 0.0, 0.0])])), "query_id", "rank", "vec_id")
    assert twice == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_search_of_rows_six_times_over(spark, parts):
    data = np.random.default_rng(6).standard_normal((160, 64))
    ids = list(range(160))
    df = frame(spark, [(i, data[i]) for i in ids] * 6).repartition(parts)
    got = {}
    for r in ann.search(df, radius=1.0, block=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [v for v, _ in found] for q, found in plain_nearest(ids, data).items()}


@pytest.mark.parametrize("long_share", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_search_of_two_lengths(spark, long_share, parts):
    data = two_lengths(long_share)
    want = {}
    for own in by_length(data):
        want |= plain_nearest([i for i, _ in own], [v for _, v in own], every=20)
    got = {}
    for r in ann.search(frame(spark, data).repartition(parts), every=20, radius=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [v for v, _ in found] for q, found in want.items()} and len(want) == 16


def test_search_repeated_rows_take_one_place(spark):
    v = [1.0, 1.0, 0.0]
    data = [(0, v)] + [(i, [1.0, 1.0, 0.01 * i]) for i in (1, 2)] * 3 + [(i, [1.0, 1.0, 0.1 * i]) for i in range(3, 9)]
    got = rows(ann.search(frame(spark, data).coalesce(1)), "query_id", "rank", "vec_id")
    assert got == [(0, k, k) for k in range(1, 6)]


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    index, query = ann.Index(codes), codes[17] ^ np.array([1, 0, 0, 3, 0, 0, 128, 0], np.uint8)
    bits = np.unpackbits(codes ^ query, axis=1).sum(axis=1)
    for radius in (0, 4, 9, 20, 27, 30, 64):
        assert index.within(query, radius).tolist() == np.flatnonzero(bits <= radius).tolist()


# -- URLs ------------------------------------------------------------------------------


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER))
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [
    None, "", "no scheme", "http://", "https://net/", "https://a.net", "https://a.NET/x", "https://planet/x", "http://example.net/en/a", "http://b.example.net/en", "http://b.example.net/en/?q#f", "https://Example.com/de/x", "https://x.org/fr/", "https://x.org/fr",
    "https://a.com?x=http://b.net/", "ftp://u@h.net:80/p;x", "http://foo.com/x.net/y", "http://ads.a.com/", "http://a.com/ads/x", "http://ünï.net/é", "http://a.b/" + "x" * 100_000 + ".exe", "http://a.net/\nb", "://net/", "a://b://c.net/d",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, path string")
    for r in urls.filter_urls(df).collect():
        host, path, rule, verdict = plain_judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    by_url = {r["url"]: r["verdict"] for r in urls.filter_urls(df).collect()}
    assert by_url["http://ads.a.com/"] == by_url["http://a.com/ads/x"] == by_url["http://a.b/" + "x" * 100_000 + ".exe"] == "block" and by_url["http://foo.com/x.net/y"] == by_url[None] == "allow"
    assert urls.filter_urls(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab/*?", min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.text(alphabet="ab/é", max_size=12), min_size=1, max_size=8))
def test_automaton_like_regular_expressions(globs, texts):
    import re

    machine = urls.compile_globs(globs)
    got = urls.run(machine, texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert got[i, j] == bool(re.fullmatch(urls._like(glob)[1:-1], text)), (glob, text)


def test_patterns_run_over_words():
    globs = [f"host{i}.test/**" for i in range(40)] + ["*z" * 40]
    got = urls.run(urls.compile_globs(globs), ["host39.test/x", "host3.test/", "z" * 40, "z" * 39, ""])
    assert np.argwhere(got).tolist() == [[0, 39], [1, 3], [2, 40]]


# -- archives --------------------------------------------------------------------------


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "x\r\nWARC-Type: evil", ""), (5, "http://ü/", "é" * 3000), (6, "u", "same"), (7, "big", "0123456789" * 20_000), (8, "u", "WARC/1.1\r\n\r\n\r\n")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, sha string")
    for points, block in ((1 << 20, 1 << 20), (7, 5)):
        got = {r["page_id"]: r for r in warc.round_trip(df, chunk=points, block=block).collect()}
        for i, _, html in PAGES:
            assert got[i]["payload_bytes"] == len((html or "").encode()) and got[i]["payload_digest"] == digest(html)
        assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 6, 2: 6, 3: 4}


def test_least_size_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "v", "abcd"), (None, "u", "abcd"), (None, "u", "zz")], "page_id long, url string, html string")
    got = rows(warc.round_trip(df, least=3), "page_id", "record_type", "refers_to")
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None), (None, "revisit", 4), (None, "response", None)], key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunks_and_real_archives(spark, tmp_path):
    import gzip

    where = f"file://{tmp_path}/w"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df, where, chunk=500, most=300).collect()
    assert len(files) > 1 and sum(f["records"] for f in files) == len(PAGES)
    raw = b"".join(gzip.decompress(open(f["archive"], "rb").read()) for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)
    listed = spark.createDataFrame([("file://" + f["archive"],) for f in files], "archive string")
    chunks = warc.read_archives(listed, block=700).orderBy("archive", "record_id", "chunk_no").collect()
    big = [c for c in chunks if c["page_id"] == 7]
    assert [c["chunk_no"] for c in big] == list(range(len(big))) and max(len(c["data"]) for c in big) <= 700 and len(big) > 100
    assert b"".join(bytes(c["data"]) for c in big).decode() == PAGES[6][2] and [c["last"] for c in big].count(True) == 1


def test_damage_is_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload text")], "page_id long, url string, html string")
    import gzip

    path = warc.write_archives(df, f"file://{tmp_path}/w").first()["archive"]
    data = gzip.decompress(open(path, "rb").read())
    for change in (data.replace(b"payload text", b"payload texT"), data[:-8]):
        with open(path, "wb") as out:
            out.write(gzip.compress(change))
        with pytest.raises(Exception, match="digest|ends inside|no end"):
            warc.read_archives(spark.createDataFrame([("file://" + path,)], "archive string")).collect()


def test_a_list_of_hosts_and_globs(spark, tmp_path, monkeypatch):
    """A list of one's own, on URLs that no fixture holds, against plain matching; also a few states at a time."""
    rng = np.random.default_rng(5)
    name = lambda: "".join(rng.choice(list("abcxyz-"), 6)).strip("-") + "." + str(rng.choice(["test", "example"]))
    hosts = sorted({name() for _ in range(300)})
    (tmp_path / "list.txt").write_text("# hosts\n\n" + "\n".join([*hosts, hosts[0].upper(), "**/banner?.gif", "*.shop/buy/*"]))
    globs = urls.read_globs(spark, f"file://{tmp_path}/list.txt")
    assert len(globs) == 4 * len(hosts) + 2
    said = [f"http://{p}{h}{t}" for h in hosts[::7] + [name() for _ in range(60)] for p in ("", "www.", "not") for t in ("", "/a/b", "/x/banner1.gif", "?q=/banner1.gif")]
    said += ["http://cheap.shop/buy/now", "http://cheap.shop/buy/now/or/never", "http://shop/buy/x", "http://long.test/" + "a/" * 20_000 + "banner2.gif", None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(said)], "page_id long, url string")

    def blocked(u):
        rest = u.split("://")[1] if u else ""
        whole = rest.split("?")[0]
        host = whole.split("/")[0]
        path = whole[len(host):]
        banner = "/" in whole and (last := whole.rsplit("/", 1)[1]).startswith("banner") and last.endswith(".gif") and len(last) == 11
        return any(host == h or host.endswith("." + h) for h in hosts) or banner or (host.endswith(".shop") and path.startswith("/buy/") and path.count("/") == 2)

    for states in (1 << 23, 1000):
        monkeypatch.setattr(urls, "STATES", states)
        got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, rules=(), block=globs).collect()}
        assert got == {i: "block" if blocked(u) else "allow" for i, u in enumerate(said)}
    assert 20 < sum(v == "block" for v in got.values()) < len(said) - 20
    with pytest.raises(ValueError):
        urls.read_globs(spark, f"file://{tmp_path}/list.txt", most=10)
