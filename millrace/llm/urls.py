"""URL filters: globs packed in multiword Shift-And masks, all simulated at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict): for the host and its subdomains; the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What blocks a URL that no rule fits, unless a list of one's own is given (``read_globs``): common words
#: of advertising, tracking and spam hosts and paths, chosen by general knowledge and without a licence or source to follow. ``**`` matches any characters, ``*`` any but ``/``,
#: ``?`` one character but ``/``; the glob is held against the host and the path, joined.
#: Host labels that are one of these words, or begin with one and a dash, are blocked, and so are some paths.
WORDS = ("ads", "track", "tracker", "spam", "casino", "adult")
BLOCK = tuple(g for w in WORDS for g in (f"{w}.**", f"*.{w}.**", f"{w}-*.**", f"*.{w}-*.**")) + (
    "**/ads/**", "**/advert*/**", "**/track/**", "**/pixel.*", "**.exe", "**.apk",
)


@dataclass
class Automaton:
    """Bit-parallel globs: state i of a pattern is one bit, set while its first i items match.

    ``step[c]`` has the bits whose item character class c can be, ``stay[c]`` those that
    loop on it, because a wildcard follows their item. ``start`` has the first bit of each
    pattern, ``accept`` and ``last`` its last.
    """

    alphabet: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: np.ndarray
    last: np.ndarray


def _items(glob: str) -> list[tuple[str | None, str | None]]:
    """``(character, loop)`` per literal; loop is the wildcard after it. A first pair has no character."""
    out: list[tuple] = [("", None)]
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            wide = glob.startswith("**", i)
            out[-1] = (out[-1][0], "**" if wide or out[-1][1] == "**" else "*")
            i += 1 + wide
        else:
            out.append((glob[i], None))
            i += 1
    return out


def compile_globs(globs) -> Automaton:
    """Pack globs one after the other into words of 64 bits; a glob takes its literals and one more bit."""
    patterns = [_items(g) for g in globs]
    alphabet = np.array(sorted({ord(c) for p in patterns for c, _ in p if c and c != "?"} | {ord("/")}), np.uint32)
    total = sum(map(len, patterns))
    words, classes = max(1, -(-total // 64)), len(alphabet) + 1
    step, stay = np.zeros((classes, words), np.uint64), np.zeros((classes, words), np.uint64)
    start, accept = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    slash, last, at = int(np.searchsorted(alphabet, ord("/"))), [], 0
    for pattern in patterns:
        for i, (char, loop) in enumerate(pattern):
            word, bit = divmod(at, 64)
            mask = np.uint64(1 << bit)
            if i == 0:
                start[word] |= mask
            elif char == "?":
                step[np.arange(classes) != slash, word] |= mask
            else:
                step[np.searchsorted(alphabet, ord(char)), word] |= mask
            if loop:
                rows = np.ones(classes, bool)
                rows[slash] = loop == "**"
                stay[rows, word] |= mask
            at += 1
        accept[(at - 1) // 64] |= np.uint64(1 << ((at - 1) % 64))
        last.append(at - 1)
    return Automaton(alphabet, step, stay, start, accept, np.array(last, np.int64))


def run(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """Which glob matches which whole text: rows of booleans. Memory follows the sum of lengths."""
    n, words = len(texts), automaton.step.shape[1]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    place = np.searchsorted(automaton.alphabet, points)
    other = len(automaton.alphabet)
    place = np.where(automaton.alphabet[np.minimum(place, other - 1)] == points, place, other).astype(np.int32)
    order = np.argsort(-lengths, kind="stable")
    sizes, begins = lengths[order], (np.cumsum(lengths) - lengths)[order]
    state = np.tile(automaton.start, (n, 1))
    live = n
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-sizes[:live], -t, side="left"))
        now = state[:live]
        c = place[begins[:live] + t]
        moved = now << np.uint64(1)
        if words > 1:
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        # A pattern's first bit has no step, so what is shifted out of the pattern before it dies.
        state[:live] = (moved & automaton.step[c]) | (now & automaton.stay[c])
    out = np.zeros((n, len(automaton.last)), bool)
    out[order] = ((state[:, automaton.last // 64] >> (automaton.last % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return out


#: Words of automaton states that a batch holds at once.
STATES = 1 << 23


def read_globs(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """Block globs from a text file, one a line, for ``filter_urls``; more than ``most`` lines are an error.

    A line without ``*``, ``?`` and ``/`` names a host and stands for it and its subdomains. Empty
    lines and those that start with ``#`` say nothing; repeats count once.
    """
    line = F.trim("value")
    found = [r[0] for r in spark.read.text(path).select(F.lower(line).alias("g")).where("g <> '' and not startswith(g, '#')").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} globs in {path}")
    whole = lambda host: (host, f"{host}/**", f"*.{host}", f"*.{host}/**")
    return tuple(g for x in sorted(found) for g in ((x,) if set("*?/") & set(x) else whole(x)))


def canonical(url):
    """``(host, path)`` columns: host A-Z lower-cased; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def rule_name(rule) -> str:
    return rule[0] + rule[1]


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, block=BLOCK) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Null and empty URLs and those without ``://`` have an empty host and path, fit no
    rule and are allowed. Very long URLs are read to their end. Of rules that fit, the longest wins. Each row stands alone: repeated rows repeat and an empty
    table stays empty. Columns of the four names are replaced; all others pass through.
    """
    escape = {g for rule in rules for g in rule[0] + rule[1] if g in "*?"}
    if escape:
        raise ValueError("a rule's host and path are literal")
    globs = [g for host, path, _ in rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block)
    names = [rule_name(r) for r in rules]
    best = sorted(range(len(rules)), key=lambda i: (-len(names[i]), names[i]))
    verdicts = [r[2] for r in rules]
    automaton = compile_globs(globs)

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        texts = [h + p for h, p in zip(hosts, paths)]
        some = max(1, STATES // automaton.step.shape[1])
        hit = np.concatenate([run(automaton, texts[i : i + some]) for i in range(0, len(texts), some)] or [run(automaton, [])])
        fits = hit[:, 0 : 2 * len(names) : 2] | hit[:, 1 : 2 * len(names) : 2]
        blocked = hit[:, 2 * len(names) :].any(axis=1)
        rule = [next((i for i in best if row[i]), None) for row in fits]
        return pd.DataFrame({
            "rule": [None if i is None else names[i] for i in rule],
            "verdict": [("block" if b else "allow") if i is None else verdicts[i] for i, b in zip(rule, blocked)],
        })

    host, path = canonical(F.col(url))
    return (
        df.withColumns({"host": host, "path": path})
        .withColumn("_mr_judged", judge("host", "path"))
        .withColumns({"rule": F.col("_mr_judged.rule"), "verdict": F.col("_mr_judged.verdict")})
        .drop("_mr_judged")
    )


def _like(glob: str) -> str:
    """The regular expression of a glob, anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            wide = glob.startswith("**", i)
            out, i = out + ("(.|\\n)*" if wide else "[^/]*"), i + 1 + wide
        else:
            out, i = out + ("[^/]" if glob[i] == "?" else ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i])), i + 1
    return "^" + out + "$"


def filter_sql(pages: str = "pages", rules=RULES, block=BLOCK) -> str:
    """DuckDB SQL of the op4 query."""
    best = sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r)))
    fits = lambda r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))"
    rule = " ".join(f"WHEN {fits(r)} THEN '{rule_name(r)}'" for r in best)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[2]}'" for r in best)
    blocked = " OR ".join(f"regexp_matches(host || path, '{_like(g)}')" for g in block)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
