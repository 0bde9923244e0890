"""Scalar text functions as pure Column expressions: names, slugs, addresses, subtitle lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a name falls back to.
UNTITLED, UNKNOWN = "Untitled meeting", "Unknown"
UNKNOWN_DATE, UNKNOWN_ID = "unknown-date", "unknown-id"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def meeting_title(title: Column, app: Column) -> Column:
    """A trimmed title, else ``<app> meeting``, else a fixed name."""
    return F.coalesce(blank_to_null(F.trim(title)), F.concat(blank_to_null(F.trim(app)), F.lit(" meeting")), F.lit(UNTITLED))


def export_title(title: Column, app: Column) -> Column:
    """The two-step variant: nothing is trimmed and nothing is invented."""
    title, app = _text(title), _text(app)
    return F.when((title == "") & (app != ""), F.concat(app, F.lit(" meeting"))).otherwise(title)


def _strip(value: Column, char: str) -> Column:
    return F.regexp_replace(value, f"^[{char}]+|[{char}]+$", "")


def slug(value: Column, most: int = 60, default: str = "meeting") -> Column:
    """ASCII slug. The cut comes after the strip, so a dash can end it."""
    made = F.substring(_strip(F.regexp_replace(F.lower(_text(value)), "[^a-z0-9]+", "-"), "-"), 1, most)
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def wide_slug(value: Column, most: int = 90, default: str = "video") -> Column:
    """Slug that keeps Cyrillic and drops a scheme."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))), "^https?://", "")
    made = F.substring(_strip(F.regexp_replace(bare, "[^a-z0-9а-яё]+", "-"), "-"), 1, most)
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def safe_file_name(value: Column, default: str = "contract") -> Column:
    """A file name: runs of forbidden characters to a dash, of white space to one underscore, no ``._-`` at the ends."""
    made = F.regexp_replace(F.regexp_replace(_text(value), r"^\s+|\s+$", ""), r'[\\/:*?"<>|]+', "-")
    made = F.regexp_replace(F.regexp_replace(made, r"\s+", "_"), "_+", "_")
    return F.coalesce(F.nullif(_strip(made, r"._\-"), F.lit("")), F.lit(default))


def output_stem(started: Column, title: Column, identifier: Column) -> Column:
    """``<date>-<slug>-<id>``, with fixed words for what is missing."""
    date = F.when(F.length(started) >= 10, F.substring(started, 1, 10)).otherwise(F.lit(UNKNOWN_DATE))
    return F.concat_ws("-", date, slug(title), F.coalesce(identifier.cast("string"), F.lit(UNKNOWN_ID)))


def speaker(value: Column) -> Column:
    """Line breaks to spaces, trimmed, a fixed name if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.translate(_text(value), "\r\n", "  ")), F.lit("")), F.lit(UNKNOWN))


def participant(name: Column, email: Column) -> Column:
    name, email = F.trim(_text(name)), F.trim(_text(email))
    both = F.concat(name, F.lit(" <"), email, F.lit(">"))
    return F.when((name != "") & (email != ""), both).when(name != "", name).when(email != "", email).otherwise(F.lit(UNKNOWN))


# -- names of the domain system -------------------------------------------------


def domain(raw: Column) -> Column:
    """Trimmed, lower-cased, without one trailing dot; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(raw)), r"\.$", ""), F.lit(""))


def domain_problem(name: Column) -> Column:
    """Why a normalised name is not an exact domain name; null if it is."""
    return (
        F.when(name.contains("://") | name.contains("/") | name.contains("?") | name.contains("#"), F.lit("URLs, paths and queries are not allowed"))
        .when(name.rlike(r"\s"), F.lit("spaces are not allowed"))
    )


def host_of(raw: Column) -> Column:
    """The lenient form: scheme and path dropped, lower-cased; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "(?i)^https?://", ""), "/.*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def tld(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def is_url(value: Column) -> Column:
    return value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")


def is_http(value: Column) -> Column:
    return value.rlike(r"(?i)^https?://")


def is_youtube(value: Column) -> Column:
    return value.rlike(r"(?i)(^|\.)youtu\.be/") | value.rlike(r"(?i)(^|\.)youtube\.com/")


# -- subtitles, words, secrets --------------------------------------------------

#: Fixed patterns of subtitle lines that carry no speech.
NO_SPEECH = (
    r"^WEBVTT$",
    r"(?i)^Kind:",
    r"(?i)^Language:",
    r"^[0-9]+$",
    r"^[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s+-->",
    r"^[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s+-->",
    r"(?i)^NOTE\b",
)


#: White space as \\s has it, for trims that need no expression.
BLANK = " \t\n\x0b\x0c\r"


def strip_markup(value: Column) -> Column:
    """Tags out, three entities decoded, white space runs to one space; text without markup skips the tags."""
    clean = value
    for pattern, by in ((r"<[^>]+>", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        clean = F.regexp_replace(clean, pattern, by)
    bare = F.when(value.contains("<") | value.contains("&"), clean).otherwise(value)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def spoken_line(line: Column) -> Column:
    """A cleaned subtitle line; null for cues, numbers, notes and ``[sounds]``."""
    bare = F.btrim(line, F.lit(BLANK))
    silent = bare.rlike("|".join(f"(?:{p})" for p in NO_SPEECH))
    # One mention of the cleaned line, so that its expressions run once.
    clean = F.regexp_replace(strip_markup(bare), r"^\[.*\]$", "")
    return F.when(~silent, F.nullif(clean, F.lit("")))


def word_count(value: Column) -> Column:
    return F.size(F.filter(F.split(_text(value), r"\s+"), lambda w: w != ""))


def redact(key: Column, value: Column, secret: str = "llmApiKey") -> Column:
    """Hide the value of a secret key unless it only names a variable."""
    return F.when((key == secret) & ~value.startswith("env:"), F.lit("<redacted>")).otherwise(value)


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def markdown_table(rows: Column, escape: bool = True) -> Column:
    """A pipe table of an array of rows, the first being its header.

    Escaping keeps ``|`` and line breaks inside cells; without it rows are padded or cut to the header.
    """
    width = F.size(rows[0])
    if escape:
        cell = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
        shaped = F.transform(rows, lambda r: F.transform(r, cell))
    else:
        shaped = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    body = F.transform(F.slice(shaped, 2, F.greatest(F.size(shaped) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(shaped[0]), rule), body), "\n")).otherwise(F.lit(""))


def heading_level(style: Column, outline: Column) -> Column:
    """``Title`` and ``Heading n`` by style, else outline level + 1 under 6; null for body text."""
    number = F.regexp_extract(style, r"(?i)^heading\s*([1-9])$", 1)
    return (
        F.when(F.lower(style) == "title", F.lit(1))
        .when(number != "", number.cast("int"))
        .when(outline < 6, (outline + 1).cast("int"))
    )
