"""Personal data: base patterns, then bootstrapped contextual extraction over the whole corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: The base forms. A run of digits is tried from its start only: a try inside it fails alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
#: A pattern needs this many different known entities, at this share of all that it meets;
#: an unseen value needs this score from its patterns.
SUPPORT, CONFIDENCE, ACCEPT = 3, 0.8, 0.9
#: Rounds go on until one finds nothing new; so many would mean a fault.
ROUNDS = 1000
#: Longer words of a pattern are named by a digest of all of them.
_SPELT = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the widest run before an ``@`` that a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            free = found.end()
        else:
            free = at  # nothing before this sign can start a later match
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    text = text or ""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(value: str) -> int:
    """The kind that an unseen word could be, by form: -1 if none."""
    digits = len(_digits(value))
    if "@" in value:
        return 0 if re.fullmatch(r"[^\s@]+@[^\s@]+", value) else -1
    if re.fullmatch(r"[0-9]+(?:[.:_-][0-9]+){3}", value) and digits <= 12:
        return 1
    if 13 <= digits <= 19 and re.fullmatch(r"[0-9][0-9./_-]*", value):
        return 2
    if 7 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9()./_-]*", value):
        return 3
    return -1


_TRIM = ".,;:!?\"'<>[]{}|*#"
_WORD = re.compile(r"\n|[^\s]+")
_RUNS = ((re.compile(r"[0-9]+"), "0"), (re.compile(r"[^\W\d_]+"), "a"))


def _mark(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _name(word: str) -> str:
    """A word of a pattern: folded, without punctuation at its ends, digits as 0."""
    word = re.sub(r"[0-9]", "0", word.lower().strip(_TRIM + "()") or word[:1])
    return word if len(word) <= _SPELT else _mark(word)


def _form(value: str) -> str:
    """The character shape of a value: runs of digits and letters as one character each."""
    for runs, one in _RUNS:
        value = runs.sub(one, value)
    return value if len(value) <= _SPELT else _mark(value)


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of spans and of the words between them, in order; a line's end is a word, kind is -1 for words."""
    out, at = [], 0
    for start, end, kind in [*sorted((s, e, k) for k, s, e in spans), (len(text), len(text), -1)]:
        if at < start:
            out += [(m.start(), m.end(), -1) for m in _WORD.finditer(text, at, start)]
        if kind >= 0:
            out.append((start, end, kind))
        at = max(at, end)
    return out


def mentions(text: str | None, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """``(kind, shape, start, end, value, left, before, right, form)`` of the base spans and of other words with a digit or ``@``.

    ``left`` is the word before, ``before`` the one before that, ``right`` the word after, whole words of
    any length; another span counts as a word of its kind. Punctuation around a word is not part of it.
    A value is kept as a digest, so that no personal data is written anywhere.
    """
    text = text or ""
    if not _SIGN.search(text):
        return []
    tokens, out = _tokens(text, spans), []

    def named(i: int) -> str:
        if not 0 <= i < len(tokens):
            return ""
        start, end, kind = tokens[i]
        return f"<{KINDS[kind]}>" if kind >= 0 else _name(text[start:end])

    for i, (start, end, kind) in enumerate(tokens):
        if kind < 0:
            if not _SIGN.search(text, start, end):
                continue
            word = text[start:end]
            start, end = end - len(word.lstrip(_TRIM)), start + len(word.rstrip(_TRIM))
            if start >= end:
                continue
        value = text[start:end]
        out.append((kind, kind if kind >= 0 else shape(value), start, end, _mark(value.lower()), named(i - 1), named(i - 2), named(i + 1), _form(value)))
    return out


_MENTION = "kind int, shape int, start int, end int, value string, left string, before string, right string, form string"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base spans and mentions, without the texts."""

    @F.pandas_udf(f"spans array<struct<kind:int,start:int,end:int>>, seen array<struct<{_MENTION.replace(' ', ':').replace(',:', ',')}>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        keys, names, rows = ("kind", "start", "end"), _MENTION.replace(",", "").split()[::2], []
        for text in texts:
            spans = base_spans(text)
            rows.append(([dict(zip(keys, s)) for s in spans], [dict(zip(names, m)) for m in mentions(text, spans)]))
        return pd.DataFrame(rows, columns=["spans", "seen"])

    found = docs.select(F.col("doc_id"), run("text").alias("r"))
    return found.select("doc_id", F.monotonically_increasing_id().alias("row"), "r.spans", "r.seen")


def _patterns(mention: DataFrame) -> DataFrame:
    """Lexical patterns of each mention: words before at two widths, the word after, words on both sides, and the word before with the value's shape."""
    left, right, bar = F.col("left"), F.col("right"), F.lit("|")
    forms = F.array(
        F.when(left != "", F.concat(F.lit("1|"), left)),
        F.when((left != "") & (F.col("before") != ""), F.concat(F.lit("2|"), F.col("before"), bar, left)),
        F.when(right != "", F.concat(F.lit("a|"), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("b|"), left, bar, right)),
        F.when(left != "", F.concat(F.lit("f|"), left, bar, F.col("form"))),
    )
    return mention.select("kind", "shape", "value", F.explode(F.array_compact(forms)).alias("pattern")).distinct()


def discover(mention: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """``(value, kind)`` of unseen identifiers, by rounds over the pattern-instance graph.

    A pattern's score for a kind is the share of its distinct values that are known to
    be of that kind, if ``support`` of them are. A value's score is one minus the
    product of its patterns' doubts (no doubt counts as less than 1e-9); a value of the kind's form at ``accept`` or more
    becomes known, and so a seed of the next round. Rounds end when one finds nothing new.
    """
    graph = cut(_patterns(mention))
    known = cut(graph.where("kind >= 0").select("value", "kind").distinct())
    seeds, met = known, cut(graph.groupBy("pattern").agg(F.count_distinct("value").alias("all")))
    pairs = graph.select("pattern", "value").distinct()
    for _ in range(rounds):
        own = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("own"))
        strong = own.where(F.col("own") >= support).join(met, "pattern").withColumn("score", F.col("own") / F.col("all")).where(F.col("score") >= confidence)
        doubt = F.sum(F.log(F.greatest(F.lit(1) - F.col("score"), F.lit(1e-9))))
        fresh = (
            graph.where("kind < 0").join(strong.withColumnRenamed("kind", "as"), "pattern").where("shape = `as`")
            .groupBy("value", F.col("as").alias("kind")).agg((F.lit(1) - F.exp(doubt)).alias("score"))
            .where(F.col("score") >= accept).select("value", "kind")
        )
        fresh = cut(fresh.join(known, ["value", "kind"], "left_anti"))
        if not fresh.limit(1).count():
            return known.join(seeds, ["value", "kind"], "left_anti")
        known = cut(known.unionByName(fresh))
    raise RuntimeError(f"discovery did not settle in {rounds} rounds")


def find(docs: DataFrame, **limits) -> DataFrame:
    """``(doc_id, base, spans)``: base spans, and those with the discovered ones, as arrays of structs.

    Null and empty texts have none; very long texts and words are read whole. Rows stand alone: repeated rows repeat, and copies
    of a value count once as evidence. A pattern or value that just reaches a threshold passes it; a value may be
    found as several kinds, a span each. An empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    scanned = cut(scan(docs.select("doc_id", "text")))
    each = scanned.select("row", F.explode("seen").alias("m")).select("row", "m.*")
    unseen = discover(each.drop("row", "start", "end"), **limits)
    added = (
        each.where("kind < 0").drop("kind").join(unseen, "value").where("shape = kind")
        .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    )
    spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return scanned.join(added, "row", "left").select("doc_id", F.array_sort("spans").alias("base"), spans.alias("spans"))


def joined(spans):
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii(docs: DataFrame) -> DataFrame:
    """The digest of ``find``: counts and digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
