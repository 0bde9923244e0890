"""Meetings: raw envelopes to the canonical record, people, selection and the exchange with transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import export_title, meeting_title, output_stem
from ..session import cut

PERSON = "struct<name:string,email:string>"
#: Fixed value: the only version of an envelope that is understood.
VERSION = 1
#: Fixed value: records a page.
PAGE = 100


def person(text: Column) -> Column:
    """``Name <mail>``, a bare mail or a bare name as (name, email); null for blank text."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    both = r"(?s)^(.*?)\s*<([^<>\s]+@[^<>\s]+)>\s*$"
    made = lambda n, e: F.struct(n.alias("name"), e.alias("email"))
    return (
        F.when(text == "", F.lit(None).cast(PERSON))
        .when(text.rlike(both), made(F.trim(F.regexp_extract(text, both, 1)), F.regexp_extract(text, both, 2)))
        .when(text.rlike(r"^[^\s@]+@[^\s@]+$"), made(F.lit(""), text))
        .otherwise(made(text, F.lit("")))
    )


def participants(value: Column) -> Column:
    """People of an attendees field: a JSON object, array or string, else text split at ``;`` and line breaks.

    The first of each e-mail (else of each name), case aside, stays; a fold keeps the order.
    """
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    listed = F.from_json(text, "array<string>")
    items = (
        F.when(parsed.isNull() | kind.isNull(), F.filter(F.split(text, r"[;\n]+"), lambda p: F.trim(p) != ""))
        .when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT"), F.array(text))
        .when(kind == "STRING", F.array(F.try_variant_get(parsed, "$", "string")))
        .otherwise(F.array().cast("array<string>"))
    )
    blank = F.lit("")
    read = lambda i: F.from_json(i, PERSON)
    one = lambda i: F.when(
        F.ltrim(i).startswith("{"),
        F.when((F.coalesce(read(i)["name"], blank) != "") | (F.coalesce(read(i)["email"], blank) != ""), F.struct(F.coalesce(read(i)["name"], blank).alias("name"), F.coalesce(read(i)["email"], blank).alias("email"))),
    ).otherwise(person(i))
    people = F.filter(F.transform(F.filter(items, lambda i: i.isNotNull()), one), lambda p: p.isNotNull())
    key = lambda p: F.lower(F.coalesce(F.nullif(p["email"], blank), p["name"]))
    first = F.aggregate(
        people, F.array().cast(f"array<{PERSON}>"),
        lambda seen, p: F.when(F.exists(seen, lambda s: key(s) == key(p)), seen).otherwise(F.concat(seen, F.array(p))),
    )
    return F.when(text == "", F.array().cast(f"array<{PERSON}>")).otherwise(first)


def export(raw: DataFrame, origin: str = "recorder") -> DataFrame:
    """The canonical record of each envelope, with an ``error`` where there is none: another version, or nothing said or noted.

    ``raw`` has (schema_version, meeting struct, transcript array of structs); see the tests.
    Absent times and speakers are empty text and never guessed.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    m = lambda f: F.col(f"meeting.{f}")
    said = F.transform(
        F.coalesce(F.filter("transcript", lambda s: s.isNotNull()), F.expr("slice(transcript, 1, 0)")),
        lambda s: F.struct(text(s["capturedAt"]).alias("started_at"), F.lit("").alias("ended_at"), text(s["speakerName"]).alias("speaker"), text(s["transcript"]).alias("text")),
    )
    turn = "array<struct<started_at:string,ended_at:string,speaker:string,text:string>>"
    said = F.coalesce(said, F.array().cast(turn))
    note = text(m("note"))
    has_note = F.regexp_replace(note, r"\s+", "") != ""
    notes = F.when(has_note, F.array(F.struct(F.lit(f"{origin.capitalize()} note").alias("title"), note.alias("text")))).otherwise(F.array().cast("array<struct<title:string,text:string>>"))
    links = F.when(m("id").isNotNull(), F.array(F.struct(F.lit(f"{origin.capitalize()} meeting").alias("label"), F.concat(F.lit(f"{origin}://meeting/"), m("id").cast("string")).alias("target")))).otherwise(F.array().cast("array<struct<label:string,target:string>>"))
    error = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), F.lit(f"unsupported schema_version; expected {VERSION}"))
        .when((F.size(said) == 0) & ~has_note, F.lit("a meeting needs transcript entries or a note"))
    )
    return raw.select(
        F.lit(1).alias("schema_version"), F.to_json(F.struct("schema_version", "meeting", "transcript")).alias("raw"), F.lit(origin).alias("source"),
        export_title(m("title"), m("meeting_app")).alias("title"), text(m("meeting_start")).alias("started_at"), text(m("meeting_end")).alias("ended_at"),
        participants(m("attendees")).alias("participants"), said.alias("transcript"), notes.alias("notes"), links.alias("resources"), error.alias("error"), m("id").alias("meeting_id"),
    )


def stems(meetings: DataFrame) -> DataFrame:
    """Add ``stem``, the name that a meeting's files start with."""
    return meetings.withColumn("stem", output_stem(F.col("meeting_start"), meeting_title(F.col("title"), F.col("meeting_app")), F.col("id")))


def search(meetings: DataFrame, query: str = "", start: str | None = None, end: str | None = None) -> DataFrame:
    """Text anywhere in title, attendees, note or app, case aside, inside a range of starts; nulls match nothing."""
    rows = meetings
    if start is not None:
        rows = rows.where(F.col("meeting_start") >= start)
    if end is not None:
        rows = rows.where(F.col("meeting_start") <= end)
    if query:
        rows = rows.where(F.lower(F.concat_ws("\n", "title", "attendees", "note", "meeting_app")).contains(query.lower()))
    return rows


def page(df: DataFrame, order: list, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def select_by_position(df: DataFrame, order: list, answer: str) -> DataFrame:
    """The rows at 1-based positions, in the order typed, each once; ``all`` takes every row."""
    if answer.strip().lower() == "all":
        return df.orderBy(*order)
    parts = [p.strip() for p in answer.split(",")]
    if not all(p.isdigit() and int(p) >= 1 for p in parts):
        raise ValueError(f"invalid selection: {answer!r}")
    wanted = list(dict.fromkeys(int(p) for p in parts))
    # Only the rows up to the last position asked for are ordered in one place.
    first = df.orderBy(*order).limit(max(wanted))
    numbered = first.withColumn("_position", F.row_number().over(Window.orderBy(*order)))
    picks = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(wanted)], "_position int, _typed int")
    return numbered.join(F.broadcast(picks), "_position").orderBy("_typed").drop("_typed", "_position")


def with_transcripts(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Meetings with their segments in order; meetings without any keep an empty array."""
    own = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("captured_at", "id", "speaker_name", "transcript"))).alias("segments"))
    rows = meetings.join(own, meetings["id"] == own["meeting_id"], "left").drop("meeting_id")
    return rows.withColumn("segments", F.coalesce("segments", F.array().cast(own.schema["segments"].dataType)))


def resolve_people(names: DataFrame, people: DataFrame) -> DataFrame:
    """Add ``person``: whose name or alias it is, if only one person's. ``people`` is (name, aliases)."""
    known = people.select(F.col("name").alias("person"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    unique = known.groupBy(F.lower("alias").alias("_key")).agg(F.count_distinct("person").alias("n"), F.min("person").alias("person")).where("n = 1").drop("n")
    return names.withColumn("_key", F.lower(F.trim("speaker"))).join(unique, "_key", "left").drop("_key")


def comment_threads(comments: DataFrame) -> DataFrame:
    """Add ``root`` and ``level`` by following ``parent`` until no row moves, twice as far each round.

    A parent that is not there ends the thread. Parents in a circle have no root: an error.
    """
    links = comments.select("path", "id", "parent").distinct()
    now = cut(links.select("*", F.col("id").alias("root"), F.col("parent").alias("_next"), F.lit(0).alias("level")))
    # After n rounds every row is 2**n - 1 hops up, or at its root.
    for _ in range(now.count().bit_length() + 1):
        up = now.select(F.col("path").alias("_p"), F.col("id").alias("_i"), F.col("root").alias("_root"), F.col("_next").alias("_up"), F.col("level").alias("_level"))
        moving = now.where("_next is not null")
        met = moving.join(up, (moving["path"] == up["_p"]) & (moving["_next"] == up["_i"]), "left")
        there = F.col("_i").isNotNull()
        moved = met.select("path", "id", "parent", F.when(there, F.col("_root")).otherwise(F.col("root")).alias("root"), F.col("_up").alias("_next"), (F.col("level") + F.coalesce(F.col("_level") + 1, F.lit(0))).alias("level"))
        now = cut(now.where("_next is null").unionByName(moved))
        if not now.where("_next is not null").limit(1).count():
            break
    else:
        raise ValueError("parents form a circle")
    found = now.select(*[F.col(c).alias(f"_{c}") for c in ("path", "id", "parent")], "root", "level")
    same = [comments[c].eqNullSafe(found[f"_{c}"]) for c in ("path", "id", "parent")]
    return comments.join(found, same).select(*comments.columns, "root", "level")


def record_issues(records: DataFrame) -> DataFrame:
    """``(meeting_id, location, issue)`` of canonical records, sorted by location: versions, types and texts that must be there."""
    at = lambda where, bad, what: F.when(bad, F.struct(F.lit(where).alias("location"), F.lit(what).alias("issue")))
    nothing = (F.size("transcript") <= 0) & (F.size("notes") <= 0)
    found = F.array_compact(F.array(
        at("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "unknown version"),
        *[at(f, F.col(f).isNull(), "missing") for f in ("source", "title", "started_at", "ended_at", "participants", "transcript", "notes", "resources")],
        at("participants", F.exists("participants", lambda p: (p["name"] == "") & (p["email"] == "")), "a participant without name and e-mail"),
        at("transcript", F.exists("transcript", lambda t: t["text"].isNull()), "an entry without text"),
        at("transcript", nothing, "neither entries nor notes"),
    ))
    return records.select("meeting_id", F.explode(F.array_sort(found)).alias("i")).select("meeting_id", "i.location", "i.issue")
