"""Office packages: files, members, a safety gate, part contents and XML nodes as tables."""

from __future__ import annotations

import fnmatch
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the safety gate.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 10_000, 2 * 1024**3, 100
# The first bytes of the two containers.
OLE_MAGIC, ZIP_MAGIC = "D0CF11E0", "504B0304"
WORD_SUFFIXES = (".doc", ".docx", ".docm")
#: Files that decompress at once in a task share its memory; rows of a batch of contents.
CONTENT_ROWS = 4
MEMBER = "path string, ord int, name string, compressed_size long, size long, utf8 boolean, error string"
PART = "path string, name string, compressed_size long, size long, content binary, error string"
NODE = (
    "path string, part string, ord int, parent int, tags array<string>, ords array<int>, tag string, "
    "attrs map<string,string>, text string, tail string, error string"
)


def find_files(spark: SparkSession, root: str, suffixes: tuple = WORD_SUFFIXES, exclude: list[str] = ()) -> DataFrame:
    """Package files under ``root``: known suffixes, no lock files, none whose path under ``root`` a shell pattern excludes, each once.

    The content column is pruned where only the listing is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    keep = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*suffixes) & ~name.startswith("~$")
    inside = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/").partition("://")[2] or root.rstrip("/")) + "/", "")
    for glob in exclude:
        keep = keep & ~inside.rlike(glob_expression(glob))
    return files.where(keep).dropDuplicates(["path"])


def glob_expression(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole text."""
    return "^" + re.sub(r"\\[Zz]$", "", fnmatch.translate(pattern)) + r"\z"


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == OLE_MAGIC, "ole").when(head == ZIP_MAGIC, "zip").otherwise("unknown")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                    for i, info in enumerate(archive.infolist()):
                        sound = info.filename.isascii() or info.filename.encode("utf-8", "ignore").decode() == info.filename
                        rows.append((path, i, info.filename.encode("utf-8", "replace").decode(), info.compress_size, info.file_size, sound, None))
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as problem:
                rows = [(path, None, None, None, None, None, f"bad zip: {problem}")]
            if rows:
                yield _batch(rows, MEMBER)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ", 1) for f in ddl.replace(", ", "|").split("|")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def members(files: DataFrame) -> DataFrame:
    """One row per archive member, with both sizes; one row with an error for an unreadable file. Nothing is inflated."""
    return files.select("path", "content").mapInArrow(_members, MEMBER)


def safety(listing: DataFrame) -> DataFrame:
    """The safety report of each file: totals, the largest ratio, and issues in member order."""
    name, shown = F.col("name"), F.concat(F.lit("'"), F.col("name"), F.lit("'"))
    ratio = F.when(F.col("compressed_size") > 0, F.col("size") / F.col("compressed_size"))
    first = listing.groupBy("path", "name").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    rows = listing.join(first, ["path", "name"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), F.col("error")),
        F.when(name.startswith("/") | name.startswith("\\"), F.concat(F.lit("absolute path: "), shown)),
        F.when(F.array_contains(F.split(name, "/"), ".."), F.concat(F.lit("path traversal: "), shown)),
        F.when(F.col("ord") > F.col("first_ord"), F.concat(F.lit("duplicate entry: "), shown)),
        F.when(~F.col("utf8"), F.concat(F.lit("non-UTF8 entry name: "), shown)),
        F.when(ratio > MAX_RATIO, F.concat(F.lit("high compression ratio "), F.format_string("%.0f", ratio), F.lit("x: "), shown)),
    ))
    totals = rows.groupBy("path").agg(
        F.count("ord").alias("entry_count"),
        F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("total_compressed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_uncompressed"),
        F.round(F.coalesce(F.max(ratio), F.lit(0.0)), 2).alias("max_ratio"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(-1)).alias("o"), found.alias("i")))).alias("_found"),
    )
    own = F.flatten(F.transform("_found", lambda f: f["i"]))
    more = F.array_compact(F.array(
        F.when(F.col("entry_count") > MAX_ENTRIES, F.concat(F.lit("entry count "), F.col("entry_count").cast("string"), F.lit(f" exceeds limit {MAX_ENTRIES}"))),
        F.when(F.col("total_uncompressed") > MAX_BYTES, F.concat(F.lit("uncompressed size "), F.col("total_uncompressed").cast("string"), F.lit(f" exceeds limit {MAX_BYTES}"))),
    ))
    return totals.withColumn("issues", F.concat(own, more)).withColumn("ok", F.size("issues") == 0).drop("_found")


def contained(name: Column) -> Column:
    """Whether a member name stays inside the folder it is unpacked to: no step of ``..`` leaves it."""
    depth = F.aggregate(
        F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda d, part: F.struct(
            (d["now"] + F.when(part == "..", -1).when((part == "") | (part == "."), 0).otherwise(1)).alias("now"),
            F.least(d["low"], d["now"] + F.when(part == "..", -1).otherwise(0)).alias("low"),
        ),
    )
    return (depth["low"] >= 0) & ~name.startswith("/") & ~name.startswith("\\")


def detect_format(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``(path, format)``: doc or ppt by magic are ``ole``; docm, docx, pptm, pptx by members; else unknown."""
    seen = listing.groupBy("path").agg(
        F.bool_or(F.col("name").endswith("vbaProject.bin")).alias("macros"),
        F.bool_or(F.col("name") == "[Content_Types].xml").alias("typed"),
        F.bool_or(F.col("name").startswith("ppt/")).alias("slides"),
    )
    rows = files.select("path", magic(F.col("content")).alias("magic")).join(seen, "path", "left")
    kind = (
        F.when(F.col("magic") == "ole", F.when(F.lower("path").endswith(".ppt"), "ppt").otherwise("doc"))
        .when((F.col("magic") == "zip") & F.col("slides") & F.col("macros"), "pptm")
        .when((F.col("magic") == "zip") & F.col("slides") & F.col("typed"), "pptx")
        .when((F.col("magic") == "zip") & F.col("macros"), "docm")
        .when((F.col("magic") == "zip") & F.col("typed"), "docx")
        .otherwise("unknown")
    )
    return rows.select("path", kind.alias("format"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows, held = [], 0
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                    for info in archive.infolist():
                        if info.is_dir() or (wanted is not None and not info.filename.endswith(tuple(wanted))):
                            continue
                        try:
                            data, problem = archive.read(info), None
                        except Exception as exc:  # a damaged member is a row with an error
                            data, problem = None, str(exc)
                        rows.append((path, info.filename, info.compress_size, info.file_size, data, problem))
                        held += len(data or b"")
                        if held > 1 << 24:
                            yield _batch(rows, PART)
                            rows, held = [], 0
            except zipfile.BadZipFile as problem:
                rows = [(path, None, None, None, None, f"bad zip: {problem}")]
            if rows:
                yield _batch(rows, PART)


def parts(files: DataFrame, report: DataFrame | None = None, endings: list[str] | None = None) -> DataFrame:
    """Member contents of the files that pass the gate. Names are filtered before anything is inflated."""
    if report is not None:
        files = files.join(report.where("ok").select("path"), "path", "left_semi")
    wanted = F.lit(None).cast("array<string>") if endings is None else F.array(*[F.lit(e) for e in endings])
    return files.select("path", "content", wanted.alias("wanted")).mapInArrow(_parts, PART)


def parse(data: bytes) -> tuple[ET.Element, dict[str, str]]:
    """The root of a part and the namespaces of all its prefixes; a part with a document type is refused.

    The parser itself reports declarations, so it does not matter where they stand, what
    encoding the part has or what comments say.
    """
    spaces: dict[str, str] = {}

    def refuse(*_) -> None:
        raise ET.ParseError("document type declarations are not allowed")

    reader = expat.ParserCreate(namespace_separator="}")
    reader.StartDoctypeDeclHandler = reader.EntityDeclHandler = refuse
    reader.StartNamespaceDeclHandler = lambda prefix, uri: spaces.setdefault(prefix or "", uri or "")
    try:
        reader.Parse(data, True)
    except expat.ExpatError as problem:
        raise ET.ParseError(str(problem)) from problem
    return ET.fromstring(data), spaces


def _walk(path: str, part: str, data: bytes) -> Iterator[tuple]:
    stack: list[tuple] = [(parse(data)[0], -1, [], [])]
    number = 0
    while stack:
        node, parent, tags, ords = stack.pop()
        own, number = number, number + 1
        yield path, part, own, parent, tags, ords, node.tag, list(node.attrib.items()), node.text, node.tail, None
        stack.extend((child, own, [*tags, node.tag], [*ords, own]) for child in reversed(node))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, part, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = []
            try:
                for row in _walk(path, part, data or b""):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield _batch(rows, NODE)
                        rows = []
            except ET.ParseError as problem:
                rows.append((path, part, -1, None, [], [], None, [], None, None, str(problem)))
            if rows:
                yield _batch(rows, NODE)


def xml_nodes(contents: DataFrame) -> DataFrame:
    """Every element of the XML parts in document order, with the tags and numbers of its ancestors.

    Ancestor tests are then array predicates, and no join or recursion is needed. A part
    that is not well formed has a row with an error, numbered -1. Tags are ``{namespace}local``.
    """
    wanted = contents.where(F.lower("name").rlike(r"\.(xml|rels)$") & F.col("content").isNotNull())
    return wanted.select("path", "name", "content").mapInArrow(_nodes, NODE)


# Namespaces of packages.
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CP = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
DC = "{http://purl.org/dc/elements/1.1/}"
TERMS = "{http://purl.org/dc/terms/}"
APP = "{http://schemas.openxmlformats.org/officeDocument/2006/extended-properties}"


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def relationships(nodes: DataFrame) -> DataFrame:
    """``(path, source, ord, id, type, type_full, target, targetMode)`` of all relationship parts."""
    own = nodes.where(F.col("part").endswith(".rels") & (F.col("tag") == REL + "Relationship"))
    text = lambda n: F.coalesce(attr(n), F.lit(""))
    return own.select(
        "path", F.col("part").alias("source"), "ord", text("Id").alias("id"), F.element_at(F.split(text("Type"), "/"), -1).alias("type"),
        text("Type").alias("type_full"), text("Target").alias("target"), attr("TargetMode").alias("targetMode"),
    )


def resolve(source: Column, target: Column) -> Column:
    """The part that a relationship of ``source`` points at; null if it leaves the package."""
    base = F.regexp_replace(F.regexp_replace(source, r"/?[^/]*$", ""), r"/?_rels$", "")
    full = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), target))
    none = F.lit(None).cast("array<string>")
    folded = F.aggregate(
        F.split(full, "/"), F.array().cast("array<string>"),
        lambda done, step: F.when(done.isNull(), none)
        .when((step == "") | (step == "."), done)
        .when((step == "..") & (F.size(done) == 0), none)
        .when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.array_join(folded, "/")


def content_types(nodes: DataFrame) -> DataFrame:
    """``(path, kind, key, content_type)``: defaults by extension, overrides by part."""
    own = nodes.where((F.col("part") == "[Content_Types].xml") & F.col("tag").isin(TYPES + "Default", TYPES + "Override"))
    default = F.col("tag") == TYPES + "Default"
    key = F.when(default, F.lower(attr("Extension"))).otherwise(F.regexp_replace(attr("PartName"), "^/+", ""))
    return own.select("path", F.when(default, "default").otherwise("override").alias("kind"), key.alias("key"), attr("ContentType").alias("content_type")).where("key <> ''")


# Property fields of the two families.
CORE = {
    "creator": DC, "lastModifiedBy": CP, "created": TERMS, "modified": TERMS, "revision": CP, "description": DC,
    "subject": DC, "title": DC, "keywords": CP, "category": CP, "contentStatus": CP, "language": DC,
}
WORD_APP = {"application": "Application", "appVersion": "AppVersion", "company": "Company", "manager": "Manager", "template": "Template", "pages": "Pages", "words": "Words", "characters": "Characters"}
SLIDE_APP = {"application": "Application", "appVersion": "AppVersion", "company": "Company", "presentationFormat": "PresentationFormat", "slides": "Slides", "notes": "Notes", "hiddenSlides": "HiddenSlides"}


def metadata(nodes: DataFrame, slides: bool = False) -> DataFrame:
    """``(path, metadata)``: non-empty core and app properties, trimmed; app wins over core."""
    app = SLIDE_APP if slides else WORD_APP
    core = {k: ns + k for k, ns in CORE.items() if not (slides and k == "contentStatus")}
    names = F.create_map(*[F.lit(x) for k, tag in core.items() for x in ("docProps/core.xml" + tag, k)], *[F.lit(x) for k, local in app.items() for x in ("docProps/app.xml" + APP + local, k)])
    own = nodes.where(F.col("part").isin("docProps/core.xml", "docProps/app.xml") & (F.col("parent") == 0))
    own = own.withColumn("key", names[F.concat("part", "tag")]).where("key is not null and text is not null and text <> ''")
    rank = F.struct(F.when(F.col("part") == "docProps/core.xml", 0).otherwise(1), -F.col("ord"))
    one = own.groupBy("path", "key").agg(F.max_by(F.trim("text"), rank).alias("value"))
    return one.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def word_flags(listing: DataFrame, contents: DataFrame, rels: DataFrame) -> DataFrame:
    """Eight flags and the media count of Word packages, by member name and by substring of the main part."""
    name = F.col("name")
    by_name = listing.groupBy("path").agg(
        F.bool_or(name.endswith("vbaProject.bin")).alias("has_macros"),
        F.bool_or(name == "word/comments.xml").alias("has_comments"),
        F.bool_or(name.startswith("word/embeddings/")).alias("has_embedded_objects"),
        F.bool_or(name.startswith("customXml/")).alias("has_custom_xml"),
        F.count_if(name.startswith("word/media/")).alias("media_count"),
    )
    main = contents.where(name == "word/document.xml").select("path", F.decode("content", "UTF-8").alias("x"))
    has = lambda *subs: F.bool_or(F.greatest(*[F.col("x").contains(s) for s in subs]) if len(subs) > 1 else F.col("x").contains(subs[0]))
    by_text = main.groupBy("path").agg(
        has("<w:ins ", "<w:del ").alias("has_tracked_changes"), has("<w:vanish").alias("has_hidden_text"), has("w:commentReference", "w:commentRangeStart").alias("has_comment_refs"),
    )
    external = rels.groupBy("path").agg(F.bool_or(F.coalesce(F.col("targetMode") == "External", F.lit(False))).alias("has_external_links"))
    joined = by_name.join(by_text, "path", "left").join(external, "path", "left")
    return joined.fillna(False)


def slide_flags(listing: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Seven flags and the slide count of presentations."""
    name = F.col("name")
    by_name = listing.groupBy("path").agg(
        F.bool_or(name.endswith("vbaProject.bin")).alias("has_macros"),
        F.bool_or(name.startswith("ppt/notesSlides/") & name.endswith(".xml")).alias("has_speaker_notes"),
        F.bool_or(name.startswith("ppt/comments/")).alias("has_comments"),
        F.bool_or(name.startswith("ppt/embeddings/")).alias("has_embedded_objects"),
        F.bool_or(name.startswith("ppt/charts/")).alias("has_charts"),
        F.bool_or(name.startswith("ppt/media/")).alias("has_media"),
    )
    count = nodes.where((F.col("part") == "ppt/presentation.xml") & (F.col("tag") == P + "sldId")).groupBy("path").agg(F.count(F.lit(1)).alias("slide_count"))
    external = rels.groupBy("path").agg(F.bool_or(F.coalesce(F.col("targetMode") == "External", F.lit(False))).alias("has_external_links"))
    return by_name.join(external, "path", "left").join(count, "path", "left").fillna(False).fillna(0, ["slide_count"])


def unpack(files: DataFrame, listing: DataFrame, report: DataFrame, transform=None, force: bool = False) -> DataFrame:
    """``(path, name, content, sha256, format)``: members that stay inside their folder, of files that pass the gate
    (of all readable files if forced), with ``transform`` applied to the contents table and the digest of the source file."""
    sound = report if force else report.where("ok")
    gated = files.join(sound.select("path"), "path", "left_semi")
    inside = parts(gated).where("error is null").where(contained(F.col("name")))
    inside = transform(inside) if transform else inside
    meta = gated.select("path", F.sha2("content", 256).alias("sha256")).join(detect_format(files, listing), "path")
    return inside.select("path", "name", "content").join(meta, "path")
