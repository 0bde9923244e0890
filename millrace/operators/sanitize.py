"""Copies without private parts: categories by part name and relationship in DataFrames, edits of XML in one pass."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator


import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.package import APP, CP, DC, REL, TYPES, W, members, parse, parts, safety, xml_nodes
from .checks import validate

# The categories of either format.
WORD_CATEGORIES = ("metadata", "comments", "revisions", "hidden-text", "custom-xml", "external-rels", "macros", "embedded-objects")
SLIDE_CATEGORIES = ("metadata", "notes", "comments", "macros", "embedded-objects", "external-rels", "custom-xml")
# Property fields that are blanked.
WORD_CORE = tuple(CP + f for f in ("lastModifiedBy", "keywords", "category", "contentStatus", "revision")) + tuple(DC + f for f in ("creator", "description"))
SLIDE_CORE = (*WORD_CORE, DC + "subject", DC + "language")
WORD_APP, SLIDE_APP = tuple(APP + f for f in ("Company", "Manager", "HyperlinkBase")), tuple(APP + f for f in ("Company", "Manager", "Template"))
# Content types of a Word main part with and without macros.
MACRO_TYPE = "application/vnd.ms-word.document.macroEnabled.main+xml"
PLAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
OLE_OBJECT = "{urn:schemas-microsoft-com:office:office}OLEObject"
COMMENT_PARTS = ("word/comments.xml", "word/commentsExtended.xml", "word/commentsExtensible.xml", "word/commentsIds.xml", "word/people.xml")
CHANGES = tuple(W + t for t in ("rPrChange", "pPrChange", "sectPrChange", "tblPrChange"))

def unknown_categories(requested: list[str], known: tuple) -> list[str]:
    return sorted(set(requested) - set(known))

def removed_part(name: Column, slides: bool = False) -> Column:
    """The category that a part falls to; null for parts of no category."""
    if slides:
        return (
            F.when(name.startswith("ppt/notesSlides/"), "notes").when(name.startswith("ppt/comments/"), "comments").when(name.contains("vbaProject"), "macros")
            .when(name.startswith("ppt/embeddings/"), "embedded-objects").when(name.startswith("customXml/"), "custom-xml")
        )
    return (
        F.when(name.isin(*COMMENT_PARTS), "comments").when(name.contains("vbaProject"), "macros")
        .when(name.startswith("word/embeddings/"), "embedded-objects").when(name.startswith("customXml/"), "custom-xml")
    )

def _drop(root: ET.Element, gone) -> int:
    count = 0
    for parent in root.iter():
        for child in [c for c in parent if gone(c)]:
            parent.remove(child)
            count += 1
    return count

def _unwrap(root: ET.Element, tag: str) -> int:
    """Replace elements of a tag by their children, nested ones too."""
    count = 0
    for parent in root.iter():
        at = 0
        while at < len(parent):
            child = parent[at]
            if child.tag == tag:
                parent[at : at + 1] = list(child)
                count += 1
            else:
                at += 1
    return count

def settle_changes(root: ET.Element, accept: bool = True) -> tuple[int, int]:
    """Accept or reject tracked changes in place: ``(insertions, deletions)`` met."""
    insertions, deletions = (sum(1 for _ in root.iter(W + t)) for t in ("ins", "del"))
    _drop(root, lambda e: e.tag == W + ("del" if accept else "ins"))
    if not accept:
        for text in root.iter(W + "delText"):
            text.tag = W + "t"
    _unwrap(root, W + ("ins" if accept else "del"))
    _drop(root, lambda e: e.tag in CHANGES)
    return insertions, deletions

def edit_part(name: str, data: bytes, categories: frozenset, slides: bool, gone: frozenset, accept: bool = True) -> tuple[bytes | None, list[str]]:
    """A part without what the categories name, and what was taken. Parts that are not XML by name come back as they are.

    An XML part that cannot be read, or has a document type, may hide what was to be taken:
    it is dropped and reported, if anything was to be taken.
    """
    if not categories or not re.search(r"\.(xml|rels)$", name, re.IGNORECASE):
        return data, []
    try:
        root, spaces = parse(data)
    except ET.ParseError as problem:
        return None, [f"unreadable: {problem}"]
    for prefix, uri in spaces.items():
        if not re.fullmatch(r"(ns\d+|xml)?", prefix):
            ET.register_namespace(prefix, uri)
    report: list[str] = []
    if "metadata" in categories and name in ("docProps/core.xml", "docProps/app.xml"):
        fields = (SLIDE_CORE if slides else WORD_CORE) if name.endswith("core.xml") else (SLIDE_APP if slides else WORD_APP)
        for child in root.iter():
            if child.tag in fields and child.text:
                child.text = ""
                report.append(f"metadata: {child.tag.rpartition('}')[2]}")
    if name.endswith(".rels"):
        for child in [c for c in root if c.tag == REL + "Relationship"]:
            target = child.get("Target", "")
            if child.get("TargetMode") == "External":
                if "external-rels" in categories:
                    root.remove(child)
                    report.append(f"external-rels: {target}")
            elif (found := _target(name, target)) in gone:
                root.remove(child)
                report.append(f"relationship: {found}")
    if name == "[Content_Types].xml":
        _drop(root, lambda e: e.tag == TYPES + "Override" and e.get("PartName", "").lstrip("/") in gone)
        if "macros" in categories and not slides:
            for child in root:
                if child.get("ContentType") == MACRO_TYPE:
                    child.set("ContentType", PLAIN_TYPE)
    if not slides and re.match(r"word/(document|header\d*|footer\d*)\.xml$", name):
        if "comments" in categories and (n := _drop(root, lambda e: e.tag in (W + "commentRangeStart", W + "commentRangeEnd", W + "commentReference"))):
            report.append(f"comments: {n} markers")
    if not slides and name == "word/document.xml":
        if "revisions" in categories:
            ins, dels = settle_changes(root, accept)
            if ins or dels:
                report.append(f"revisions: {'accepted' if accept else 'rejected'} {ins} insertions, {dels} deletions")
        if "hidden-text" in categories:
            hidden = lambda e: e.tag == W + "r" and (p := e.find(W + "rPr")) is not None and p.find(W + "vanish") is not None
            if n := _drop(root, hidden):
                report.append(f"hidden-text: {n} runs")
        if "external-rels" in categories:
            _unwrap(root, W + "hyperlink")
        if "embedded-objects" in categories:
            _drop(root, lambda e: e.tag == OLE_OBJECT)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True), report

def _target(source: str, target: str) -> str | None:
    steps = [] if target.startswith("/") else source.split("/")[:-2]
    for step in target.split("/"):
        if step == "..":
            if not steps:
                return None
            steps.pop()
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)

def sanitize(contents: DataFrame, categories: list[str], slides: bool = False, accept: bool = True) -> DataFrame:
    """``(path, name, content, category, report)``: parts with their category null stay, edited; others are gone (content null).

    XML parts that cannot be read are gone too, as category ``unreadable``. Parts to go are told by name in the JVM; only XML that stays is edited in Python.
    """
    if bad := unknown_categories(categories, SLIDE_CATEGORIES if slides else WORD_CATEGORIES):
        raise ValueError(f"unknown categories: {', '.join(bad)}")
    kind = removed_part(F.col("name"), slides)
    rows = contents.where("error is null and name is not null").withColumn("category", F.when(kind.isin(*categories) if categories else F.lit(False), kind))
    gone = rows.where("category is not null").groupBy("path").agg(F.collect_set("name").alias("gone"))
    rows = rows.join(gone, "path", "left")
    own = frozenset(categories)

    @F.pandas_udf("content binary, report array<string>")
    def edit(names: pd.Series, data: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = [edit_part(n, d, own, slides, frozenset(g if g is not None else ()), accept) for n, d, g in zip(names, data, lost)]
        return pd.DataFrame(out, columns=["content", "report"])

    kept = rows.where("category is null").withColumn("_e", edit("name", "content", "gone")).select(
        "path", "name", "_e.content", F.when(F.get("_e.report", F.lit(0)).startswith("unreadable: "), "unreadable").alias("category"), "_e.report"
    )
    left = rows.where("category is not null").select("path", "name", F.lit(None).cast("binary").alias("content"), "category", F.array(F.concat("category", F.lit(": "), "name")).alias("report"))
    return kept.unionByName(left)

def carry_over(edited: DataFrame, original: DataFrame) -> DataFrame:
    """The edited parts and those of the original that they lack."""
    lost = original.where("error is null and name is not null").select("path", "name", "content").join(edited.select("path", "name"), ["path", "name"], "left_anti")
    return edited.select("path", "name", "content").unionByName(lost)

# The two headers of a member and the end of an archive, 1980-01-01, made on Unix for its owner.
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s4B4H3I5H2I"), struct.Struct("<4s4H2IH")


def _archive(parts: Iterable[tuple[str, bytes]], kind: int) -> bytes:
    """The bytes that ``zipfile`` writes for plain names and sizes, without its objects, which cost more than the copying; anything else is left to it."""
    rows = sorted(parts, key=lambda r: (r[0] != "[Content_Types].xml", r[0]))
    plain = len(rows) < 1 << 16 and sum(len(c) + 2 * len(n) + 128 for n, c in rows) < 1 << 31 and len({n for n, _ in rows}) == len(rows)
    if not plain or not all(n and n.isascii() and "\0" not in n and not n.endswith("/") for n, _ in rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as archive:
            for name, content in rows:
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, kind)
        return out.getvalue()
    body, ends, at = [], [], 0
    for name, content in rows:
        content, size, crc, own = bytes(content), len(content), zlib.crc32(content), name.encode()
        if kind == zipfile.ZIP_DEFLATED:
            press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
            content = press.compress(content) + press.flush()
        body += (_LOCAL.pack(b"PK\3\4", 20, 0, kind, 0, 33, crc, len(content), size, len(own), 0), own, content)
        ends += (_CENTRAL.pack(b"PK\1\2", 20, 3, 20, 0, 0, kind, 0, 33, crc, len(content), size, len(own), 0, 0, 0, 0, 0o600 << 16, at), own)
        at += 30 + len(own) + len(content)
    tail = b"".join(ends)
    return b"".join(body) + tail + _END.pack(b"PK\5\6", 0, 0, len(rows), len(rows), len(tail), at, 0)


def pack(contents: DataFrame, compress: bool = True) -> DataFrame:
    """``(path, content)``: one deterministic archive per path, the content types first, then by name.

    A package is one row's worth of bytes by its nature, and bounded by the safety gate.
    """

    kind = zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["content"].notna()]
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "content": [_archive(zip(pdf["name"], pdf["content"]), kind)] * min(1, len(pdf))})

    return contents.select("path", "name", "content").groupBy("path").applyInPandas(build, "path string, content binary")


def pack_rows(rows: DataFrame, compress: bool = True) -> DataFrame:
    """``pack`` of ``(path, parts)``, parts an array of (name, content): where the parts of a file lie in one row, nothing is shuffled."""

    kind = zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, made, held, at = [], [], 0, 0
            flat = batch.column(1).flatten()  # values as they lie: a scalar for each part would cost more than its archive
            names, contents = flat.field(0), flat.field(1)
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist()):
                size = size or 0
                sound = [p for p in zip(names.slice(at, size).to_pylist(), contents.slice(at, size).to_pylist()) if p[1] is not None]
                at += size
                if sound:
                    paths.append(path)
                    made.append(_archive(sound, kind))
                    held += len(made[-1])
                if held >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "content"])
                    paths, made, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.select("path", "parts").mapInArrow(run, "path string, content binary")


def repair_parts(contents: DataFrame, step) -> DataFrame:
    """Add ``repairs`` and change ``content``: ``step(name, bytes)`` gives a part's bytes and what it mended; XML parts alone."""

    @F.pandas_udf("content binary, repairs array<string>")
    def run(names: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([step(n, d) for n, d in zip(names, data)], columns=["content", "repairs"])

    rows = contents.withColumn("_xml", F.coalesce(F.lower("name").rlike(r"\.(xml|rels)$") & F.col("content").isNotNull(), F.lit(False)))
    other = rows.where("not _xml").drop("_xml").withColumn("repairs", F.array().cast("array<string>"))
    done = rows.where("_xml").withColumn("_r", run("name", "content")).withColumns({"content": F.col("_r.content"), "repairs": F.col("_r.repairs")})
    return other.unionByName(done.drop("_r", "_xml"))

def pack_valid(contents: DataFrame, slides: bool = False, keep_invalid: bool = False, extra_checks: tuple = (), compress: bool = True) -> DataFrame:
    """``(path, content, ok, details)``: packed, read back and checked; what fails has no content unless ``keep_invalid``.

    Each of ``extra_checks`` takes (files, listing, contents, nodes) of the packed files and gives rows of
    ``(path, check, ok, details)`` beside those of ``checks.validate``. A path without any content gives no row.
    """
    files = cut(pack(contents, compress))
    listing = cut(members(files))
    report = cut(safety(listing))
    inside = cut(parts(files, report))
    nodes = cut(xml_nodes(inside))
    found = validate(files, listing, report, inside, nodes, slides)
    for check in extra_checks:
        found = found.unionByName(check(files, listing, inside, nodes).select("path", "check", "ok", "details"))
    said = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat_ws(": ", "check", "details"))))
    by_path = found.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.array_join(said, "; ").alias("details"))
    kept = F.col("ok") | F.lit(keep_invalid)
    return files.join(by_path, "path").select("path", F.when(kept, F.col("content")).alias("content"), "ok", "details")

# -- XML transforms ---------------------------------------------------------------

def condense(data: bytes) -> bytes:
    """Without white space between elements; text that matters is kept."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return data
    for node in root.iter():
        if len(node) and node.text and not node.text.strip():
            node.text = None
        if node.tail and not node.tail.strip():
            node.tail = None
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)

def pretty(data: bytes) -> bytes:
    """Indented; elements with text of their own are left alone."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return data
    ET.indent(root)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def preserve_spaces(data: bytes) -> bytes:
    """Mark text with white space at its ends, so that readers keep it."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return data
    mark = "{http://www.w3.org/XML/1998/namespace}space"
    for node in root.iter():
        if node.tag in (W + "t", W + "delText") and node.text and node.text != node.text.strip():
            node.set(mark, "preserve")
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)

def transform_xml(contents: DataFrame, step) -> DataFrame:
    """Apply one of the XML transforms to the XML parts; others pass in the JVM."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(step)

    xml = F.lower("name").rlike(r"\.(xml|rels)$")
    return contents.withColumn("content", F.when(xml, run(F.when(xml, F.col("content")))).otherwise(F.col("content")))

def alt_texts(texts: DataFrame) -> DataFrame:
    """``(path, source, alt)``: a map of relationship id to alternative text, for the part rewrite."""
    return texts.groupBy("path", "source").agg(F.map_from_entries(F.collect_set(F.struct("id", "text"))).alias("alt"))


# The elements that name an image and carry its alternative text.
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"


def describe_images(data: bytes, texts: dict) -> bytes:
    """Set the description of each drawing whose image has a text, by relationship id."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return data
    for box in root.iter():
        if box.tag not in (DRAWING + "inline", DRAWING + "anchor"):
            continue
        found = [texts[b.get(EMBED)] for b in box.iter(BLIP) if b.get(EMBED) in texts]
        if found and (props := box.find(DRAWING + "docPr")) is not None:
            props.set("descr", found[0])
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def write_alt_texts(contents: DataFrame, alts: DataFrame) -> DataFrame:
    """Contents with alternative texts written into the parts whose relationships ``alts`` names."""
    owner = F.regexp_replace(F.regexp_replace("source", "_rels/", ""), r"\.rels$", "")
    rows = contents.join(alts.select("path", owner.alias("name"), "alt"), ["path", "name"], "left")

    @F.pandas_udf("binary")
    def edit(data: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([describe_images(d, dict(m)) if m is not None and d is not None else d for d, m in zip(data, maps)])

    named = F.col("alt").isNotNull()
    return rows.withColumn("content", F.when(named, edit(F.when(named, F.col("content")), F.col("alt"))).otherwise(F.col("content"))).drop("alt")


def repair_ids(contents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(path, part, ord, old_id, new_id)`` of the elements whose id is not a number that may stay."""
    from .dedupe import free_ids

    ids = nodes.where(F.col("attrs")[W + "id"].isNotNull()).select("path", "part", "ord", F.concat_ws("|", "path", "part").alias("own"), F.col("attrs")[W + "id"].alias("old_id"))
    ids = ids.join(contents.select("path", F.col("name").alias("part")), ["path", "part"], "left_semi")
    fixed = free_ids(ids, "own", "old_id", "ord")
    return fixed.where(~F.col("old_id").eqNullSafe(F.col("new_id").cast("string"))).select("path", "part", "ord", "old_id", "new_id")
