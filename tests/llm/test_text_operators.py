import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, linededup, mixing, pii, quality, simhash
from millrace.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, more=""):
    data = [(i, t, None, (sources or [None] * len(texts))[i], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def clashing(df):
    """The same rows with columns that are named like an operator's own."""
    names = ("drop", "kept", "n_lines", "key", "value", "row", "seen", "spans", "size", "slice", "weight", "target", "count", "fingerprint", "score", "ids", "times", "tie")
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


# -- personal data -------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(x):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()x%é\n", max_size=60) | st.text(alphabet="12.@a", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" + "(" * 300_000, "@" * 100_000):
        pii.mentions(text, pii.base_spans(text))
    assert pii.base_spans("0000255.1.1.1")[0] == (1, 0, 13) and pii.base_spans("9" * 5000 + ".1.1.1") == []


CALLS = ["reach the desk phone: +1 (988) 555-24%02d today" % i for i in range(20)]


def test_contexts_find_unseen_identifiers(spark):
    texts = [*CALLS[:6], "reach the desk phone: 988-555-2471 today", "order number 988-555-2472 today", "no digits here", None, ""]
    got = {r["doc_id"]: r for r in pii.pii(clashing(docs(spark, texts))).collect()}
    assert got[6]["spans"] == "phone:22:34" and got[6]["n_phone"] == 0 and got[6]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["spans"] == "" and got[9]["spans"] == "" and got[10]["spans"] == ""
    assert got[0]["spans"] == "phone:22:39" and got[0]["n_phone"] == 1


def test_contexts_shared_with_other_values_find_nothing(spark):
    texts = [*CALLS[:6], *[f"reach the desk phone: ticket{i}x today" for i in range(6)], "reach the desk phone: 988-555-2471 today"]
    assert {r["doc_id"]: r["spans"] for r in pii.pii(docs(spark, texts)).collect()}[12] == ""


def test_found_values_seed_the_next_round(spark):
    texts = [*CALLS, *[f"reach the desk phone: 988-555-24{i} today" for i in range(71, 75)], *[f"my landline is 988-555-24{i} ok" for i in range(71, 75)], "my landline is 401-555-0000 ok"]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(docs(spark, texts)).collect()}
    assert [got[i] for i in range(20, 24)] == ["phone:22:34"] * 4 and [got[i] for i in range(24, 29)] == ["phone:15:27"] * 5


def plain_found(texts):
    """All spans by an independent scorer: plain sets, the whole table at once."""
    import string

    blank, seen = ".,;:!?\"'<>[]{}|*#", []
    for n, text in enumerate(texts):
        text = text or ""
        marks = sorted((s, e, k) for k, s, e in plain_spans(text))
        cells, at = [], 0
        for s, e, k in [*marks, (len(text), len(text), None)]:
            cells += [(m.start(), m.end(), None) for m in re.finditer(r"\n|[^\s]+", text[:s]) if m.start() >= at] if at < s else []
            cells += [(s, e, k)] if k is not None else []
            at = max(at, e)

        def word(i):
            if not 0 <= i < len(cells):
                return ""
            s, e, k = cells[i]  # noqa: B023
            w = text[s:e].lower()  # noqa: B023
            return f"<{k}>" if k is not None else re.sub("[0-9]", "0", w.strip(blank + "()") or w[:1])

        for i, (s, e, k) in enumerate(cells):
            value = text[s:e]
            if k is None:
                if not re.search("[0-9@]", value):
                    continue
                s, e = e - len(value.lstrip(blank)), s + len(value.rstrip(blank))
                if (value := text[s:e]) == "":
                    continue
            digits, form = sum(c in string.digits for c in value), re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "0", value))
            could = k if k is not None else 0 if re.fullmatch(r"[^\s@]+@[^\s@]+", value) else -1 if "@" in value else 1 if re.fullmatch(r"\d+([.:_-]\d+){3}", value, re.A) and digits <= 12 else 2 if 13 <= digits <= 19 and re.fullmatch(r"\d[\d./_-]*", value, re.A) else 3 if 7 <= digits <= 15 and re.fullmatch(r"[+(]?\d[\d()./_-]*", value, re.A) else -1
            before, left, right = word(i - 2), word(i - 1), word(i + 1)
            found = {(1, left)} if left else set()
            found |= ({(2, before, left)} if left and before else set()) | ({(3, right)} if right else set()) | ({(4, left, right)} if left and right else set()) | ({(5, left, form)} if left else set())
            seen.append((n, k, could, s, e, value.lower(), found))
    met, known = defaultdict(set), {(v, k) for _, k, _, _, _, v, _ in seen if k is not None}
    for *_, v, found in seen:
        for f in found:
            met[f].add(v)
    while True:
        sure = {(f, k): len(own) / len(values) for f, values in met.items() for k in range(4) if len(own := {v for v in values if (v, k) in known}) >= 3 and len(own) >= 0.8 * len(values)}
        reasons = defaultdict(set)
        for _, k, could, _, _, v, found in seen:
            reasons[v, could] |= {(f, could) for f in found if k is None and (f, could) in sure}
        fresh = set()
        for key, why in reasons.items():
            doubt = 1.0
            for r in why:
                doubt *= max(1 - sure[r], 1e-9)
            if why and 1 - doubt >= 0.9:
                fresh.add(key)
        if fresh <= known:
            break
        known |= fresh
    out = defaultdict(set)
    for n, k, could, s, e, v, _ in seen:
        if k is not None or (v, could) in known:
            out[n].add((could, s, e))
    return {n: ",".join(f"{['email', 'ip', 'card', 'phone'][k]}:{s}:{e}" for k, s, e in sorted(out[n])) for n in range(len(texts))}


def planted():
    """Base values and unseen ones in the same phrases, unseen ones in phrases of their own, decoys and noise."""
    rng, out = np.random.default_rng(12), []
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    phrases = {0: "write to mailbox {} soon", 1: "the server at {}; is up", 2: "charged to card no. {} today", 3: "ring our desk: {} please"}
    base = {0: lambda: f"u{d(4)}@host.org", 1: lambda: f"10.{rng.integers(9)}.{rng.integers(99)}.{rng.integers(99)}", 2: lambda: "4000 0000 0000 0002", 3: lambda: f"+1 (988) 555-{d(4)}"}
    unseen = {0: lambda: f"u{d(4)}@localhost", 1: lambda: f"10-{d(1)}-{d(2)}-{d(2)}", 2: lambda: f"4{d(3)}.{d(4)}.{d(4)}.{d(4)}", 3: lambda: f"555-{d(4)}"}
    luhn_card = lambda: next(c for c in ("4" + d(15) for _ in range(1000)) if luhn(c))
    base[2] = luhn_card
    for k, phrase in phrases.items():
        out += [phrase.format(base[k]()) for _ in range(20)] + [phrase.format(unseen[k]()) for _ in range(3)]
    out += [f"order number {d(8)} shipped" for _ in range(10)] + [f"my landline ({unseen[3]()}) rings" for _ in range(2)] + [f"page {d(16)} of {d(3)}" for _ in range(10)]
    out += [f"{d(3)} {'x' * 300}{d(2)} @ {d(7)}", "w" * 50_000 + " ring our desk: 555-0000 please " + "9" * 50_000, None, ""]
    out += [out[21], out[21]]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_discovery_against_a_plain_scorer(spark, parts):
    texts = planted()
    got = {r["doc_id"]: r for r in pii.pii(docs(spark, texts).repartition(parts)).collect()}
    want = plain_found(texts)
    assert {i: r["spans"] for i, r in got.items()} == want
    base = {i: sum(r[f"n_{k}"] for k in pii.KINDS) for i, r in got.items()}
    added = [i for i in got if len([x for x in want[i].split(",") if x]) > base[i]]
    assert len(added) >= 13 and all(base[i] == 0 for i in added)


def test_pii_repeated_and_empty(spark):
    df = docs(spark, ["a@b.co x"])
    both = df.unionByName(df).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["spans"] for r in pii.pii(both).collect()] == ["email:0:6"] * 2
    assert pii.pii(df.limit(0)).count() == 0


# -- simhash -------------------------------------------------------------------

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBÀé \t\x0b\x1c\u00a0\n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_over_pieces(monkeypatch):
    text = "The quick  BROWN\tfox über jumps " * 300
    whole = plain_fingerprint(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "_CHUNK", size)
        assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_any_three_bytes_leave_a_plane():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    for differ in combinations(range(8), 3):
        assert sum(not set(p) & set(differ) for p in simhash.PLANES) == 1


@pytest.mark.parametrize("hot", [1 << 18, 8])
def test_links_connect_all_that_are_near(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres[:20]:
        for _ in range(30):
            v = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    for _ in range(150):  # one long posting: 4 shared bytes, near and far members
        values.append(int(centres[0]) ^ int(rng.integers(0, 1 << 32)))
    values = sorted({simhash._signed(v & (1 << 64) - 1) for v in values})
    df = spark.createDataFrame([(v,) for v in values], "value long")
    links = [tuple(r) for r in simhash.fingerprint_links(df, "value", hot).collect()]
    u = np.array(values, np.int64).view(np.uint64)
    near = [(values[i], values[j]) for i in range(len(u)) for j in i + 1 + np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3)]
    true = set(near)
    assert all((min(a, b), max(a, b)) in true for a, b in links)
    assert plain_components(links, values) == plain_components(near, values)


def test_simhash_components(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base + " tail", base, "A b", "a B", None, "", " \n", base.replace("word7 ", "other "), " ".join(f"else{i}" for i in range(50)), "x" * 100_000]
    got = {r["doc_id"]: r for r in simhash.simhash_components(clashing(docs(spark, texts))).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    pairs = [(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(pairs, prints)
    assert got[4]["component_id"] == got[6]["component_id"] == 4
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == {r["component_id"] for r in got.values()}


def test_simhash_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert rows(simhash.simhash_components(df), "doc_id", "component_id") == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=repr)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    assert simhash.keep_one(df).count() == 4 and simhash.keep_one(df.where("text = 'a b c'")).count() == 2


# -- lines ---------------------------------------------------------------------


def plain_lines(data, least=20, most=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(_FOLD)
    holders = defaultdict(set)
    for doc, text in data:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    gone = {k: max(d) for k, d in holders.items() if len(d) >= most}
    out = []
    for doc, text in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LONG = "This line is long enough to count"


def test_line_dedup(spark):
    data = [
        (0, f"{LONG}\nown line zero is here ok\n{LONG}"), (1, f"  {LONG.upper()}\t\nshort"), (2, f"{LONG}\r\n{LONG}"), (3, "short\nshort"), (4, "short"),
        (5, None), (6, ""), (7, "only two share this line"), (8, "only two share this line"), (9, "ÀÉÎ " * 8 + "\nx"), (10, "ÀÉÎ " * 8), (11, " ÀÉÎ" * 8), (12, "y" * 200_000 + "\n" + LONG[:19]),
        (13, "àéî " * 8), (14, "\x1cunit separators are not blank"), (15, "unit separators are not blank"), (16, "unit separators are not blank"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(linededup.dedup_lines(clashing(df)), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == plain_lines(data) and sum(r[2] for r in got) > 4


def test_line_dedup_counts_documents_not_rows(spark):
    data = [(1, LONG), (1, LONG), (1, f"{LONG}\n{LONG}"), (2, LONG)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sum(r["n_dropped"] for r in linededup.dedup_lines(df).collect()) == 0
    more = spark.createDataFrame([*data, (None, LONG)], "doc_id long, text string")
    got = rows(linededup.dedup_lines(more), "doc_id", "n_dropped")
    assert got == sorted([(1, 1), (1, 1), (1, 2), (2, 0), (None, 1)], key=repr)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_a_small_filter_only_suspects_more(spark, monkeypatch):
    rng = np.random.default_rng(0)
    lines = [f"line number {i} that is long enough" for i in range(400)]
    data = [(i, "\n".join(rng.choice(lines, 12))) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(linededup, "filter_bits", lambda d: 256)
    assert rows(linededup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept") == plain_lines(data)


# -- quality -------------------------------------------------------------------


def test_quality_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality(clashing(d).drop("score"), labels).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.9
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[texts[i]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def plain_scores(texts, labels, points):
    """Scores of all texts, recomputed without Spark from the labels of the training fold."""
    import math
    import zlib

    import xxhash
    import zstandard

    place = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) + (1 << 63)) % (1 << 64)
    known = sorted((i for i in labels if texts[i] and zlib.crc32(str(i).encode()) % 5), key=place)
    halves = [[[i for i in known if labels[i] == c and place(i) % 2 == half and (half or len(texts[i]) <= points)] for c in (0, 1)] for half in (0, 1)]
    own, seen = [list(dict.fromkeys(texts[i] for i in x)) for x in halves[0]], defaultdict(set)
    for t in {*own[0], *own[1]}:
        for line in t.split("\n"):
            seen[line].add(t)
    coders = []
    for x in own:
        data = ["\n".join(line for line in t.split("\n") if len(seen[line]) == 1).encode() for t in x]
        data = [d[i : i + 8192] for d in data for i in range(0, len(d), 8192)]
        size = next((n for n in (112_640, 28_160, 7_040) if sum(map(len, data)) >= 8 * n and len(data) >= 16), 0)
        made = zstandard.train_dictionary(size, data) if size else zstandard.ZstdCompressionDict(b"".join(data))
        coders.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made.as_bytes()), write_content_size=False, write_dict_id=False))

    def x(t):
        data = (t or "").encode()
        bad, good = (sum(len(c.compress(data[i : i + 8192])) for i in range(0, len(data), 8192)) for c in coders)
        return [(bad - good) / (len(data) + 100) ** 0.7, good / (len(data) + 100), 100 / (len(data) + 100), 1.0]

    rows = [(x(texts[i]), c) for c in (0, 1) for i in halves[1][c]]
    design, y, w = np.array([r for r, _ in rows]), np.array([c for _, c in rows]), np.zeros(4)
    for _ in range(200):  # the ridge logistic optimum by plain Newton steps, halved until they help
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(4), design.T @ (p - y) + 1e-3 * w)
        loss = lambda v: np.logaddexp(0, np.where(y == 1, -1, 1) * (design @ v)).sum() + 5e-4 * v @ v
        scale = 1.0
        while scale > 1e-9 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
    n = [sum(labels[i] == c for i in known) for c in (0, 1)]
    w[3] += math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return {i: 1 / (1 + math.exp(-min(max(float(np.dot(w, x(t))), -700), 700))) for i, t in texts.items()}


def test_quality_against_plain_scores(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    texts, marks = {r["doc_id"]: r["text"] for r in d.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    want = plain_scores(texts, marks, quality.SAMPLE_POINTS)
    # Labels that contradict each other count as none, whichever way round they come.
    torn = [i for i in sorted(texts) if i not in marks][:20]
    both = labels.unionByName(spark.createDataFrame([(i, c) for i in torn for c in (0, 1)], labels.schema))
    for given in (labels, both, labels.unionByName(labels).repartition(7)):
        got = {r["doc_id"]: r["score"] for r in quality.quality(d, given).collect()}
        assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_quality_without_labels_or_texts(spark):
    df = docs(spark, ["some text", None, "", "some text"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (0, None), (99, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    got = quality.quality(df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))), odd).collect()
    assert len(got) == 8 and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.quality(df.limit(0), none).count() == 0
    assert quality.reject(df, none).count() == 4


def test_quality_of_a_long_text():
    model = quality.Model(b"the and of " * 400, b"@@@ ### " * 400, (10.0, 0.0, 0.0, 0.0))
    good, bad = (quality.score(t * 20_000, model, model.compressors()) for t in ("the of and ", "### @@@ "))
    assert 0 <= bad <= good <= 1
    assert quality.score("", model, model.compressors()) == quality.score(None, model, model.compressors()) == 0.5


# -- byte-level BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(*vocabulary())


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SAMPLES = ["", " ", "  \n\t x", "don't we'll I'VE", "Straße 東京 👩‍👩‍👧 Ωмир", "a\u00a0b\u2003c\x1cd\x85e", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "1234567890 ½ ②", "é" * 50, "\u0000\ufffe", "x" * 5000]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_encoding_like_the_other_library(coder, reference_encoding, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference_encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", SAMPLES)
def test_encoding_samples(coder, reference_encoding, text, monkeypatch):
    for size in (1 << 20, 3):
        monkeypatch.setattr(bpe, "STRETCH", size)
        monkeypatch.setattr(bpe.stretches, "__defaults__", (size,))
        ids = np.frombuffer(coder.encode(text), "<u4")
        assert ids.tolist() == reference_encoding.encode_ordinary(text) and coder.decode_bytes(ids) == text.encode()


def test_forgetting_changes_nothing(coder, reference_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    text = "one two three four five six " * 3
    assert [np.frombuffer(coder.encode(text), "<u4").tolist() for _ in range(2)] == [reference_encoding.encode_ordinary(text)] * 2


def test_offsets_cover_split_characters(coder):
    text = "a 東👩 é"
    ids = np.frombuffer(coder.encode(text), "<u4")
    spans = coder.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[0] <= b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    for i, (s, e) in zip(ids, spans):
        assert coder.bytes_of[int(i)] in text[s:e].encode()
    assert "".join(bpe.text_pieces(coder, [[i] for i in ids] and [ids[k : k + 1] for k in range(len(ids))])) == text


def test_bpe_columns(spark, coder):
    texts = ["héllo wörld", None, "", "héllo wörld", "long " * 50_000]
    df = clashing(docs(spark, texts))
    got = {r["doc_id"]: r for r in bpe.token_digests(df, *vocabulary()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[2]["decoded_sha256"] == empty and got[0]["ids_sha256"] == got[3]["ids_sha256"]
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    back = bpe.decode(bpe.encode(docs(spark, texts), *vocabulary(), offsets=True), *vocabulary())
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.token_digests(df.limit(0), *vocabulary()).count() == 0


# -- mixing ---------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rate = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if rate * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rate * w[s] for s in order}
        full |= over


def test_mix(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 600)]
    sources = [["a", "b", "é", "zz", None, "Z"][int(k)] for k in rng.choice(6, 600, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02])]
    df = clashing(docs(spark, texts, sources))
    got = [r.asDict() for r in mixing.mix(df.drop("size", "target", "weight", "slice", "times", "tie", "key")).collect()]
    again = [r.asDict() for r in mixing.mix(df.repartition(9)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    size = defaultdict(int)
    for t, s in zip(texts, sources):
        size[s] += len(t.split())
    want, taken = plain_targets(size), defaultdict(int)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in size) and abs(sum(taken.values()) - sum(size.values())) < 120


def test_mix_extremes(spark):
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0
    none = [r.asDict() for r in mixing.mix(docs(spark, [None, "", " "], ["a", "a", None])).collect()]
    assert {(r["size"], r["target"], r["taken"]) for r in none} == {(0, 0.0, 0)}
    alone = mixing.mix(docs(spark, ["a b", "c"], ["x", "x"])).collect()
    assert {r["taken"] for r in alone} == {2, 1} and {r["target"] for r in alone} == {3.0}
    twins = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", "x"), (None, "e", "x")], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.mix(twins).collect()) == 8


def test_better_documents_come_first(spark):
    texts = ["plain words are here now"] * 400 + ["#$%& ### $$$ %%% &&&"] * 400 + ["other words fill it"] * 1200
    df = docs(spark, texts, ["a"] * 800 + ["b"] * 1200)
    got = mixing.mix(df).where("doc_id < 800").collect()
    good, bad = (np.mean([r["times"] for r in got if (r["doc_id"] < 400) == g]) for g in (True, False))
    assert good > bad + 0.2


def test_repeat_gives_whole_copies(spark):
    df = docs(spark, ["a b", "c", "d e f", None], ["x", "x", "y", "y"])
    lot = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()}
    out = mixing.repeat(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, n in lot.items() for _ in range(n))
