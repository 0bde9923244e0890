"""Conversations: collapsing turns, merging overlaps, rendering and parsing transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import participant, speaker


def islands(df: DataFrame, group: list[str], order: list, same: Column, out: str = "island") -> DataFrame:
    """Number runs of consecutive rows of a group whose ``same`` value does not change."""
    w = Window.partitionBy(*group).orderBy(*order)
    broken = F.when(same.eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_broken", broken).withColumn(out, F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_broken")


def collapse_turns(df: DataFrame, meeting: str = "meeting_id", order: str = "turn") -> DataFrame:
    """``(meeting, turn, speaker, text)``: neighbours of one speaker merged, first spelling kept, texts joined by newlines."""
    rows = df.withColumns({"speaker": speaker(F.col("speaker")), "text": F.coalesce("text", F.lit(""))})
    rows = islands(rows, [meeting], [order], F.lower("speaker"))
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    merged = rows.groupBy(meeting, "island").agg(F.min_by("speaker", order).alias("speaker"), F.array_join(F.transform(said, lambda s: s["t"]), "\n").alias("text"))
    return merged.select(meeting, F.col("island").cast("int").alias("turn"), "speaker", "text")


def merge_runs(df: DataFrame, paragraph: list[str], order: str = "ord") -> DataFrame:
    """Adjacent plain runs of equal formatting become one; a complex run is always a break of its own."""
    w = Window.partitionBy(*paragraph).orderBy(order)
    goes_on = F.col("plain") & F.lag("plain").over(w) & F.col("format").eqNullSafe(F.lag("format").over(w))
    rows = df.withColumn("_broken", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    text = F.array_join(F.transform(parts, lambda s: s["t"]), "")
    merged = rows.groupBy(*paragraph, "island").agg(F.min(order).alias(order), F.bool_and("plain").alias("plain"), F.min_by("format", order).alias("format"), text.alias("text"))
    return merged.withColumn("preserve_space", F.col("text") != F.trim("text")).drop("island")


def merge_overlaps(lines: Column) -> Column:
    """Join lines, dropping of each line the longest prefix of words that the text so far ends with, case aside.

    A fold over the array of one document's lines; the overlap tried is never longer than the line.
    """
    words_of = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != "")

    def add(done, words):
        low = F.transform(words, lambda w: F.lower(w))
        sizes = F.sequence(F.least(F.size(done), F.size(words)), F.lit(0))
        ends = lambda n: F.transform(F.slice(done, F.size(done) - n + 1, n), lambda w: F.lower(w))
        last = F.lower(F.get(done, F.size(done) - 1))  # an overlap ends with it, so that few sizes are compared whole
        fits = F.filter(sizes, lambda n: (n == 0) | ((F.get(low, n - 1) == last) & (ends(F.greatest(n, F.lit(1))) == F.slice(low, 1, F.greatest(n, F.lit(1))))))
        overlap = fits[0]
        return F.concat(done, F.slice(words, overlap + 1, F.greatest(F.size(words), F.lit(1))))

    folded = F.aggregate(F.transform(lines, words_of), F.array().cast("array<string>"), add)
    return F.array_join(folded, " ")


#: Fixed format of a transcript; ``{{x}}`` are filled in.
TEMPLATE = """---
type: source
created: {{created_date}}
updated: {{created_date}}
source:
  - {{source}}
tags: []
aliases: []
---

# Transcript: {{title}}

## Metadata

- Meeting date: {{meeting_date}}
- Started: {{started_at}}
- Ended: {{ended_at}}
- Participants: {{participants}}

## Transcript

{{transcript_body}}"""
#: Fixed grammar of a transcript, and of a turn in its body.
GRAMMAR = (
    r"(?s)\A---\n(.*?)\n---\n\n# Transcript: ([^\n]+)\n\n## Metadata\n\n- Meeting date: ([^\n]*)\n- Started: ([^\n]*)\n"
    r"- Ended: ([^\n]*)\n- Participants: ([^\n]*)\n\n## Transcript\n\n(.*)\z"
)
TURN = r"(?ms)([^:\n]+): (.+?)(?=\n\n(?=[^:\n]+: )|\z)"


def render_transcript(meetings: DataFrame, turns: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """``(meeting, content, error)``: the template filled in from a meeting and its collapsed turns.

    A meeting without turns, or with a placeholder left over, has an error and no content.
    """
    one_line = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))), lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n\n")
    rows = meetings.join(turns.groupBy(meeting).agg(body.alias("transcript_body")), meeting, "left")
    started, ended = F.coalesce("started_at", F.lit("")), F.coalesce("ended_at", F.lit(""))
    people = F.array_join(F.transform(F.coalesce("participants", F.array().cast("array<struct<name:string,email:string>>")), lambda p: participant(p["name"], p["email"])), ", ")
    or_unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    values = {
        "source": one_line(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))),
        "created_date": F.coalesce(F.nullif(F.substring(started, 1, 10), F.lit("")), F.current_date().cast("string")),
        "title": one_line(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled meeting"))),
        "meeting_date": or_unknown(F.substring(started, 1, 10)),
        "started_at": or_unknown(started),
        "ended_at": or_unknown(ended),
        "participants": or_unknown(people),
        "transcript_body": F.col("transcript_body"),
    }
    made = F.lit(TEMPLATE)
    for key, value in values.items():
        made = F.replace(made, F.lit("{{" + key + "}}"), value)
    rows = rows.withColumn("_made", F.concat(F.regexp_replace(made, r"\s+\z", ""), F.lit("\n")))
    error = F.when(F.col("transcript_body").isNull(), "a meeting needs transcript entries").when(F.col("_made").rlike(r"\{\{\s*[^}]+\s*\}\}"), "a placeholder is left over")
    return rows.withColumn("error", error).select(meeting, F.when(F.col("error").isNull(), F.col("_made")).alias("content"), "error")


def parse_transcript(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``title``, ``meeting_date``, ``started_at``, ``ended_at``, ``participants``, ``source``, ``turns`` and ``error``.

    The grammar is strict: what is left between turns is an error, and instructions
    inside speech are speech. Turns are an array of ``(speaker, text)``.
    """
    text = F.regexp_replace(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), r"\n+\z", "")
    part = lambda i: F.regexp_extract(F.col("_text"), GRAMMAR, i)
    rows = files.withColumn("_text", text).withColumn("_body", part(7))
    turns = F.transform(F.regexp_extract_all("_body", F.lit(TURN), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, r"(?s)^([^:\n]+): ", 1).alias("speaker"), F.regexp_replace(t, r"^[^:\n]+: ", "").alias("text")))
    left = F.regexp_replace("_body", TURN, "")
    source = F.regexp_extract(part(1), r"(?m)^source:\n  - ([^\n]+)$", 1)
    error = (
        F.when(~F.col("_text").rlike(GRAMMAR) | F.col("_text").isNull(), "the transcript does not match its template")
        .when(~part(1).rlike(r"(?m)^type: source$"), "the front matter needs type: source")
        .when(source == "", "the front matter needs one source")
        .when(F.trim(F.regexp_replace(left, r"\s+", "")) != "", "an entry is not '<speaker>: <speech>'")
        .when(F.size(turns) == 0, "a transcript needs an entry")
    )
    names = ("title", "meeting_date", "started_at", "ended_at", "participants")
    return rows.withColumns({"error": error, "source": source, "turns": turns, **{n: part(i + 2) for i, n in enumerate(names)}}).drop("_text", "_body")


def carry_marker(df: DataFrame, group: list[str], order: str, marker: Column, out: str = "section") -> DataFrame:
    """The last marker seen so far, carried down the lines of a group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(w))
