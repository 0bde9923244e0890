"""Layered configuration, preset ranking, subtitle tracks and flag lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_http, is_url, is_youtube, redact
from .turns import carry_marker

# Options with a value and options that are switches, in the order they are given.
VALUE_FLAGS = {
    "threshold": "--threshold", "max": "--max", "min": "--min", "fps": "--fps", "strategy": "--strategy", "width": "--width",
    "format": "--format", "gpu": "--gpu", "dedup": "--dedup", "dedupDistance": "--dedup-distance", "adaptive": "--adaptive",
    "transcribe": "--transcribe", "start": "--start", "duration": "--duration", "portrait": "--portrait", "vr": "--vr",
    "ocrLang": "--ocr-lang", "ocrPsm": "--ocr-psm", "describe": "--describe", "embedModel": "--embed-model", "blur": "--blur",
    "blurStrength": "--blur-strength",
}
SWITCHES = {
    "ocr": "--ocr", "diarise": "--diarise", "forceWhisper": "--force-whisper", "stabilise": "--stabilise", "ignoreChapters": "--ignore-chapters",
    "noTonemap": "--no-tonemap", "embedFrames": "--embed-frames", "noReport": "--no-report", "noManifest": "--no-manifest",
    "noIndex": "--no-index", "noAudio": "--no-audio",
}
# Languages preferred after the one asked for, and file endings beside a video. MOST_PRESETS bounds what is broadcast.
LANGUAGES = ("ru-orig", "en-orig", "ru", "en")
MOST_PRESETS = 1000
LOCAL_ENDINGS = (".vtt", ".srt", ".txt")
REMOTE_ENDINGS = (".vtt", ".srt", ".txt", ".ru.vtt", ".en.vtt", ".ru.srt", ".en.srt")


def stack_layers(layers: list[DataFrame]) -> DataFrame:
    """Union of layers, highest first; the first has the highest ``priority``."""
    return reduce(DataFrame.unionByName, [d.withColumn("priority", F.lit(len(layers) - i)) for i, d in enumerate(layers)])


def merge_layers(rows: DataFrame, tie: Column | None = None) -> DataFrame:
    """``(collection, name, value)``: an entry of a higher priority replaces the whole one of a lower."""
    order = F.struct(F.col("priority"), tie if tie is not None else F.lit(0))
    return rows.groupBy("collection", "name").agg(F.max_by("value", order).alias("value"))


def redacted(rows: DataFrame) -> DataFrame:
    """Entries as (collection, name, key, value) with secrets hidden."""
    return rows.withColumn("value", redact(F.col("key"), F.col("value")))


def rank_presets(inputs: DataFrame, presets: DataFrame) -> DataFrame:
    """``(input_id, name, score, description, reasons)``, best first by name.

    +2 per token found in the input's text, +3 for a video site's preset on its address, +1 each for
    subtitles and sidecars where the preset prefers them; a general preset scores at least 1.
    The presets are configuration: more than ``MOST_PRESETS`` rows are refused, so their broadcast is bounded.
    ``inputs`` has (input_id, input, text, n_subtitles, n_sidecars), text being all that is known of it.
    """
    if presets.limit(MOST_PRESETS + 1).count() > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    low = F.lower(F.concat_ws(" ", "input", "text"))
    hits = F.filter(F.coalesce("match", F.array().cast("array<string>")), lambda t: F.contains(F.col("_low"), F.lower(t)))
    rows = inputs.withColumn("_low", low).crossJoin(F.broadcast(presets))
    video = is_youtube(F.col("input")) & F.concat_ws(" ", "name", "description").rlike("(?i)youtube")
    prefers = F.coalesce("preferSubtitles", F.lit(False))
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = 2 * F.size(hits) + plus(video, 3) + plus(prefers & (F.col("n_subtitles") > 0), 1) + plus(prefers & (F.col("n_sidecars") > 0), 1)
    rows = rows.withColumn("score", score).withColumn("reasons", F.transform(hits, lambda t: F.concat(F.lit("matched "), t)))
    floor = F.when((F.col("score") == 0) & F.col("name").rlike("(?i)general"), 1).otherwise(F.col("score"))
    return rows.select("input_id", "name", floor.alias("score"), F.coalesce("description", F.lit("")).alias("description"), "reasons")


def best_first() -> list:
    return [F.col("score").desc(), F.col("name").asc()]


def subtitle_tracks(lines: DataFrame) -> DataFrame:
    """``(input_id, ord, code, name, formats, source)`` from a listing of (input_id, ord, line)."""
    line = F.col("line")
    marker = F.when(line.rlike("(?i)Available automatic captions"), "automatic").when(line.rlike("(?i)Available subtitles"), "manual")
    rows = carry_marker(lines, ["input_id"], "ord", marker, "source")
    row = r"^([a-zA-Z0-9._-]+)\s+(.+?)\s{2,}(.+)$"
    keep = F.col("source").isNotNull() & marker.isNull() & ~line.rlike(r"(?i)^Language\s+Name\s+Formats") & line.rlike(row)
    part = lambda i: F.trim(F.regexp_extract("line", row, i))
    return rows.where(keep).select("input_id", "ord", part(1).alias("code"), part(2).alias("name"), part(3).alias("formats"), "source")


def choose_language(tracks: DataFrame, requested: str | None = None) -> DataFrame:
    """One track per input: the language asked for, then the fixed ones, then the first manual, then the first.

    Of tracks with one code the last wins, as long as the code is what it is chosen by.
    """
    asked = [f"{requested.lower()}-orig", requested.lower()] if requested else []
    codes = [*asked, *LANGUAGES]
    place = F.coalesce(*[F.when(F.lower("code") == c, F.lit(i)) for i, c in enumerate(codes)], F.when(F.col("source") == "manual", F.lit(len(codes))), F.lit(len(codes) + 1))
    order = F.struct(place.alias("p"), F.when(place < len(codes), -F.col("ord")).otherwise(F.col("ord")))
    return tracks.groupBy("input_id").agg(F.min_by(F.struct("code", "name", "formats", "source"), order).alias("t")).select("input_id", "t.*")


def flag_list(options: DataFrame) -> DataFrame:
    """``(name, args)`` from options as (name, key, value, kind), kind being the JSON type of the value.

    False and null give nothing, ``transcribe`` read from the environment neither; ``multiRes`` is a switch or a number.
    """
    places = [(k, f, i) for i, (k, f) in enumerate([*VALUE_FLAGS.items(), *SWITCHES.items(), ("multiRes", "--multi-res")])]
    table = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.struct(F.lit(f).alias("flag"), F.lit(i).alias("place"))) for k, f, i in places]))
    rows = options.withColumn("_f", F.try_element_at(table, F.col("key"))).where("_f is not null and value is not null")
    true, false = (F.col("kind") == "boolean") & (F.col("value") == "true"), (F.col("kind") == "boolean") & (F.col("value") == "false")
    valued = F.col("key").isin(*VALUE_FLAGS) & ~false & ~((F.col("key") == "transcribe") & (F.col("value") == "env"))
    alone = F.col("key").isin(*SWITCHES, "multiRes") & true
    number = (F.col("key") == "multiRes") & (F.col("kind") == "number")
    args = F.when(valued | number, F.array("_f.flag", "value")).when(alone, F.array("_f.flag"))
    kept = rows.withColumn("_args", args).where("_args is not null")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_f.place", "_args"))), lambda s: s["_args"]))
    return options.select("name").distinct().join(kept.groupBy("name").agg(listed.alias("args")), "name", "left").withColumn("args", F.coalesce("args", F.array().cast("array<string>")))


def local_sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, sidecar)``: files of the same folder whose name starts with a video's stem and ends as text."""
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    own = videos.select("path", folder.alias("dir"), F.regexp_replace(name, r"(.)\.[^.]*$", "$1").alias("stem")).where(~is_url(F.col("path")))
    beside = files.select(F.col("path").alias("sidecar"), folder.alias("dir"), name.alias("file")).where(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*LOCAL_ENDINGS))
    return own.join(beside, "dir").where(F.col("file").startswith(F.col("stem"))).select("path", "sidecar")


def remote_candidates(videos: DataFrame, url: str = "path") -> DataFrame:
    """``(url, ord, candidate)``: the addresses that a text beside a video could have; asking them is the caller's part."""
    stem = F.regexp_extract(url, r"^(https?://[^/?#]+/[^?#]*[^/?#.][^/?#]*)\.[^./?#]+([?#].*)?$", 1)
    rest = F.regexp_extract(url, r"^https?://[^/?#]+/[^?#]*([?#].*)?$", 1)
    rows = videos.where(is_http(F.col(url))).withColumns({"_stem": stem, "_rest": rest}).where("_stem <> ''")
    endings = F.array(*[F.lit(e) for e in REMOTE_ENDINGS])
    return rows.select(F.col(url).alias("url"), "_stem", "_rest", F.posexplode(endings).alias("ord", "ending")).select("url", "ord", F.concat("_stem", "ending", "_rest").alias("candidate"))
