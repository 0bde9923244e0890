"""Registered queries over packages made of whole tables, one fault or feature a row, and over the remaining record operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, dedupe, domains, interval, meetings, presets, sanitize, templates
from ..session import cut
from ..sources import decks, package, readers
from .queries import query, table

_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SLIDE = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_OFFICE}"'
_CHANGE = 'w:id="7" w:author="A" w:date="2026-01-01T00:00:00Z"'


def _rels(*items: tuple) -> str:
    return f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{t}" Target="{to}"{" TargetMode=" + chr(34) + "External" + chr(34) if out else ""}/>' for i, t, to, out in [(*x, False)[:4] for x in items]) + "</Relationships>"


def _types(main: str = checks.WORD_MAIN, override: bool = True) -> str:
    return (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/x"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Default Extension="bin" ContentType="application/x"/><Default Extension="png" ContentType="image/png"/>' + (f'<Override PartName="/word/document.xml" ContentType="{main}"/>' if override else "") + "</Types>"
    )


def _filled(text: str, **values: Column) -> Column:
    """A text with ``@name@`` replaced by columns, made safe for XML."""
    out = F.lit(text)
    for name, value in values.items():
        safe = value.cast("string")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            safe = F.replace(safe, F.lit(char), F.lit(entity))
        out = F.replace(out, F.lit(f"@{name}@"), F.coalesce(safe, F.lit("")))
    return out


def _packed(rows: DataFrame, path: Column, parts: dict[str, Column]) -> DataFrame:
    """An archive a row; parts that are null are left out."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("binary").alias("content")) for n, c in parts.items()])
    return sanitize.pack(rows.select(path.cast("string").alias("path"), F.explode(each).alias("p")).select("path", "p.*"), compress=False)


def _read(files: DataFrame):
    listing = cut(package.members(files))
    report = cut(package.safety(listing))
    contents = cut(package.parts(files, report))
    return listing, report, contents, cut(package.xml_nodes(contents))


def _variant(n: Column, cases: dict[int, str | None], other: str | None) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(n == k, F.lit(v)) if out is None else out.when(n == k, F.lit(v))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def _word_files(spark, sf_dir) -> DataFrame:
    """A Word file per document; the remainder of its id by 9 says which check it fails: 0 none, 1 the archive, then as in the SQL."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).alias("n"), F.coalesce("lang", F.lit("")).alias("lang"))
    n, head = F.col("n"), f"<w:document {_W}><w:body><w:p><w:r><w:t>@lang@</w:t></w:r></w:p>"
    removed = f"<w:p><w:del {_CHANGE}><w:r><w:t>gone</w:t></w:r></w:del></w:p>"
    noted = '<w:p><w:commentRangeStart w:id="5"/><w:r><w:t>x</w:t></w:r><w:commentRangeEnd w:id="5"/><w:r><w:commentReference w:id="5"/></w:r></w:p>'
    body = F.when(n != 2, F.concat(_filled(head, lang=F.col("lang")), _variant(n, {7: removed, 8: noted}, ""), F.lit("</w:body></w:document>")))
    files = _packed(rows, F.col("doc_id"), {
        "[Content_Types].xml": _variant(n, {5: _types("application/other")}, _types()),
        "_rels/.rels": _variant(n, {3: _rels(("rId1", "other", "word/document.xml"))}, _rels(("rId1", "officeDocument", "word/document.xml"))),
        "word/document.xml": body,
        "word/_rels/document.xml.rels": _variant(n, {6: _rels(("rId1", "image", "media/lost.png"))}, _rels()),
        "word/media/odd.zzz": _variant(n, {4: "x"}, None),
        "word/comments.xml": _variant(n, {8: f"<w:comments {_W}/>"}, None),
    })
    broken = F.col("path").cast("long") % 9 == 1
    return files.withColumn("content", F.when(broken, F.lit("not an archive").cast("binary")).otherwise(F.col("content")))


_NAMES = "(VALUES ('zip_integrity'), ('required_parts'), ('content_types'), ('relationships'), ('wellformed_xml'), ('tracked_changes'), ('comments')) AS c(\"check\")"
_FAILS = """CASE doc_id % 9 WHEN 1 THEN "check" = 'zip_integrity' WHEN 2 THEN "check" IN ('required_parts', 'relationships') WHEN 3 THEN "check" = 'required_parts'
  WHEN 4 THEN "check" = 'content_types' WHEN 5 THEN "check" = 'content_types' WHEN 6 THEN "check" = 'relationships' WHEN 7 THEN "check" = 'tracked_changes' WHEN 8 THEN "check" = 'comments' ELSE false END"""


@query(f"""SELECT doc_id, "check" AS name, NOT ({_FAILS}) AS ok FROM documents, {_NAMES} WHERE doc_id % 9 <> 1 OR "check" = 'zip_integrity'""")
def failing_checks(spark, sf_dir):
    """Every named check of every file; each kind of fault fails its own."""
    files = cut(_word_files(spark, sf_dir))
    listing, report, contents, nodes = _read(files)
    found = checks.validate(files, listing, report, contents, nodes)
    return found.select(F.col("path").cast("long").alias("doc_id"), F.col("check").alias("name"), "ok")


@query("SELECT count(*) AS validated, count(*) FILTER (WHERE doc_id % 9 <> 0) AS failed FROM documents")
def check_totals(spark, sf_dir):
    files = cut(_word_files(spark, sf_dir))
    return checks.totals(checks.validate(files, *_read(files)))


@query("""SELECT doc_id, 'docx' AS format, CASE WHEN doc_id % 9 = 4 THEN 5 WHEN doc_id % 9 = 2 THEN 3 WHEN doc_id % 9 = 8 THEN 5 ELSE 4 END AS members, true AS safe FROM documents WHERE doc_id % 9 <> 1
UNION ALL SELECT doc_id, 'unknown', 0, false FROM documents WHERE doc_id % 9 = 1""")
def package_formats(spark, sf_dir):
    """Formats by magic and members, and what the safety gate counts."""
    files = cut(_word_files(spark, sf_dir))
    listing = cut(package.members(files))
    rows = package.detect_format(files, listing).join(package.safety(listing), "path")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "format", F.col("entry_count").cast("int").alias("members"), F.col("ok").alias("safe"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 IN (4, 8) THEN 5 WHEN doc_id % 9 = 2 THEN 3 ELSE 4 END AS parts, doc_id % 9 <> 2 AS has_main FROM documents WHERE doc_id % 9 <> 1""")
def unpacked_parts(spark, sf_dir):
    files = cut(_word_files(spark, sf_dir))
    listing = cut(package.members(files))
    rows = package.unpack(files, listing, package.safety(listing))
    return rows.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("parts"), F.bool_or(F.col("name") == "word/document.xml").alias("has_main")).select(F.col("path").cast("long").alias("doc_id"), "parts", "has_main")


def _rich_files(spark, sf_dir) -> DataFrame:
    """A Word file per document with a heading, a table, a comment, a header, changes, hidden text, links and private parts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    values = {"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    body = (
        f"<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val=\"Heading2\"/></w:pPr><w:r><w:t>Document @id@</w:t></w:r></w:p>"
        f"<w:tbl><w:tr>{cell('source')}{cell('lang')}</w:tr><w:tr>{cell('@source@')}{cell('@lang@')}</w:tr></w:tbl>"
        f"<w:p><w:r><w:t>from @source@</w:t></w:r><w:ins {_CHANGE}><w:r><w:t> and on</w:t></w:r></w:ins><w:del {_CHANGE.replace('7', '8')}><w:r><w:delText> and off</w:delText></w:r></w:del>"
        "<w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r><w:r><w:commentReference w:id=\"1\"/></w:r></w:p></w:body></w:document>"
    )
    return _packed(rows, F.col("doc_id"), {
        "[Content_Types].xml": F.lit(_types()), "_rels/.rels": F.lit(_rels(("rId1", "officeDocument", "word/document.xml"))),
        "word/document.xml": _filled(body, **values), "word/_rels/document.xml.rels": F.lit(_rels(("rId1", "hyperlink", "http://example.org/", True), ("rId2", "comments", "comments.xml"))),
        "word/comments.xml": _filled(f'<w:comments {_W}><w:comment w:id="1" w:author="@lang@" w:date="2026-01-02T00:00:00Z"><w:p><w:r><w:t>on @id@</w:t></w:r></w:p></w:comment></w:comments>', **values),
        "word/header1.xml": _filled(f"<w:hdr {_W}><w:p><w:r><w:t>top @id@</w:t></w:r></w:p></w:hdr>", **values),
        "word/media/a.png": F.when(F.col("doc_id") % 2 == 0, F.lit("png")), "word/vbaProject.bin": F.when(F.col("doc_id") % 3 == 0, F.lit("macro")),
        "customXml/item1.xml": F.when(F.col("doc_id") % 5 == 0, F.lit("<a/>")), "word/embeddings/o.bin": F.when(F.col("doc_id") % 7 == 0, F.lit("ole")),
    })


@query("""SELECT doc_id, 2 AS paragraphs, 'Document ' || doc_id AS heading, 2 AS level, 'source,lang;' || coalesce(source, '') || ',' || coalesce(lang, '') AS grid, 2 AS columns, 'top ' || doc_id AS header,
  'on ' || doc_id AS note, lang AS author, 'paragraph,table,paragraph' AS blocks, 'Document ' || doc_id || chr(10) || 'from ' || coalesce(source, '') || ' and onsecret' AS body,
  '## Document ' || doc_id || chr(10) || chr(10) || '| source | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(source, '') || ' | ' || coalesce(lang, '') || ' |' || chr(10) || chr(10) || 'from ' || coalesce(source, '') || ' and onsecret'
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || '> **Comment (' || coalesce(lang, '') || ', 2026-01-02):** on ' || doc_id || chr(10) AS markdown FROM documents""")
def word_structures(spark, sf_dir):
    """Paragraphs, headings, tables, headers, comments and body order of every file, and its Markdown."""
    nodes = _read(_rich_files(spark, sf_dir))[3]
    whole = cut(readers.word_structure(nodes))
    rows = F.array_join(F.transform(F.col("tables")[0]["rows"], lambda r: F.array_join(r, ",")), ";")
    return whole.join(readers.word_markdown(whole), "path").select(
        F.col("path").cast("long").alias("doc_id"), F.size("paragraphs").alias("paragraphs"), F.col("headings")[0]["text"].alias("heading"), F.col("headings")[0]["level"].alias("level"), rows.alias("grid"),
        F.col("tables")[0]["column_count"].alias("columns"), F.col("headers")[0].alias("header"), F.col("comments")[0]["text"].alias("note"), F.nullif(F.col("comments")[0]["author"], F.lit("")).alias("author"),
        F.array_join(F.transform("body_blocks", lambda b: b["type"]), ",").alias("blocks"), F.col("body_text").alias("body"), "markdown",
    )


@query("""SELECT doc_id, doc_id % 3 = 0 AS macros, true AS comments, doc_id % 7 = 0 AS embedded, doc_id % 5 = 0 AS custom, (doc_id % 2 = 0)::INT AS media, true AS changes, true AS hidden, true AS refs, true AS links FROM documents""")
def word_features(spark, sf_dir):
    listing, _, contents, nodes = _read(_rich_files(spark, sf_dir))
    flags = package.word_flags(listing, contents, package.relationships(nodes))
    return flags.select(
        F.col("path").cast("long").alias("doc_id"), F.col("has_macros").alias("macros"), F.col("has_comments").alias("comments"), F.col("has_embedded_objects").alias("embedded"), F.col("has_custom_xml").alias("custom"),
        F.col("media_count").cast("int").alias("media"), F.col("has_tracked_changes").alias("changes"), F.col("has_hidden_text").alias("hidden"), F.col("has_comment_refs").alias("refs"), F.col("has_external_links").alias("links"),
    )


_LEFT = "'[Content_Types].xml,_rels/.rels,' || {} || 'word/_rels/document.xml.rels,word/document.xml,' || {} || 'word/header1.xml' || CASE WHEN doc_id % 2 = 0 THEN ',word/media/a.png' ELSE '' END"


@query(f"""SELECT doc_id, 'from ' || coalesce(source, '') || kind AS text, NOT accept AS kept_deletion, {_LEFT.format("''", "''")} AS members FROM documents, (VALUES (' and on', true), (' and off', false)) AS v(kind, accept)""")
def cleaned_files(spark, sf_dir):
    """All categories taken out, changes accepted and rejected; members of the packed copy in their order."""
    contents = _read(_rich_files(spark, sf_dir))[2]
    out = None
    for accept in (True, False):
        clean = cut(sanitize.sanitize(contents, list(sanitize.WORD_CATEGORIES), accept=accept))
        packed = sanitize.pack(clean.select("path", "name", "content"), compress=False)
        members = package.members(packed).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda m: m["name"]), ",").alias("members"))
        kept = clean.where("content is not null and name = 'word/document.xml'").withColumn("error", F.lit(None).cast("string"))
        paras = readers.word_paragraphs(package.xml_nodes(kept)).where("index = 1")
        rows = paras.join(members, "path").select(F.col("path").cast("long").alias("doc_id"), "text", F.lit(not accept).alias("kept_deletion"), "members")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT doc_id, {_LEFT.format("CASE WHEN doc_id % 5 = 0 THEN 'customXml/item1.xml,' ELSE '' END", "CASE WHEN doc_id % 7 = 0 THEN 'word/embeddings/o.bin,' ELSE '' END").replace("word/document.xml,'", "word/comments.xml,word/document.xml,'").replace("'word/_rels/document.xml.rels,word/comments.xml,", "'word/_rels/document.xml.rels,word/comments.xml,")} || CASE WHEN doc_id % 3 = 0 THEN ',word/vbaProject.bin' ELSE '' END AS members FROM documents""")
def carried_parts(spark, sf_dir):
    """Edited main parts joined with all that their original holds besides."""
    contents = _read(_rich_files(spark, sf_dir))[2]
    whole = sanitize.carry_over(contents.where("name = 'word/document.xml'").select("path", "name", "content"), contents)
    members = package.members(sanitize.pack(whole, compress=False))
    return members.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda m: m["name"]), ",").alias("members"))


#: Rows of a table that become packages in one task: a few MB of rows make a hundred times as much work.
PACKED_ROWS = 4096


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Dealt out by the rows' number, before they grow: a table of one small file would else be one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PACKED_ROWS)), key)


def _decks(spark, sf_dir) -> DataFrame:
    """A presentation of two slides per part, shown in reverse; the remainder of the key by 4 says which check it fails."""
    rows = _dealt(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("n"), "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    n = F.col("n")
    values = {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type")}
    shape = lambda ph, text: f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda inner: f"<p:sld {_SLIDE}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    layout = ("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")
    parts = {
        "[Content_Types].xml": F.lit(_types(override=False)), "_rels/.rels": F.lit(_rels(("rId1", "officeDocument", "ppt/presentation.xml"))),
        "ppt/presentation.xml": _variant(n, {1: f'<p:presentation {_SLIDE}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId9"/></p:sldIdLst></p:presentation>'}, f'<p:presentation {_SLIDE}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>'),
        "ppt/_rels/presentation.xml.rels": F.lit(_rels(("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide2.xml"))),
        "ppt/slides/slide1.xml": F.when(F.col("p_size") % 2 == 1, _filled(slide(shape('<p:ph type="title"/>', "@name@") + "<p:pic/>"), **values)).otherwise(_filled(slide(shape('<p:ph type="title"/>', "@name@")), **values)),
        "ppt/slides/slide2.xml": _filled(slide(shape('<p:ph type="ctrTitle"/>', "@brand@") + shape("", "@type@")), **values),
        "ppt/slides/_rels/slide1.xml.rels": _variant(n, {2: _rels()}, _rels(layout)),
        "ppt/slides/_rels/slide2.xml.rels": _variant(n, {3: _rels(("rId1", "slideLayout", "../slideLayouts/lost.xml"), ("rId2", "notesSlide", "../notesSlides/notesSlide1.xml"))}, _rels(layout, ("rId2", "notesSlide", "../notesSlides/notesSlide1.xml"))),
        "ppt/slideLayouts/slideLayout1.xml": F.lit(f"<p:sldLayout {_SLIDE}/>"), "ppt/slideLayouts/_rels/slideLayout1.xml.rels": F.lit(_rels(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml"))),
        "ppt/slideMasters/slideMaster1.xml": F.lit(f"<p:sldMaster {_SLIDE}/>"),
        "ppt/notesSlides/notesSlide1.xml": _filled(f"<p:notes {_SLIDE}>" + shape('<p:ph type="body"/>', "say @brand@") + "</p:notes>", **values),
    }
    each = F.array(*[F.struct(F.lit(name).alias("name"), part.cast("binary").alias("content")) for name, part in parts.items()])
    return sanitize.pack_rows(rows.select(F.col("p_partkey").cast("string").alias("path"), each.alias("parts")), compress=False)


@query("""SELECT p_partkey, 1 AS slide_number, p_brand AS title, p_type AS text, 'say ' || p_brand AS notes, false AS has_images FROM part
UNION ALL SELECT p_partkey, 2, p_name, '', '', p_size % 2 = 1 FROM part WHERE p_partkey % 4 <> 1""")
def deck_slides(spark, sf_dir):
    rows = decks.slides(_decks(spark, sf_dir))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "slide_number", "title", F.array_join("texts", ";").alias("text"), "notes", "has_images")


@query("""SELECT p_partkey, "check" AS name, NOT (CASE p_partkey % 4 WHEN 1 THEN "check" = 'slide_consistency' WHEN 2 THEN "check" = 'layout_master_chain' WHEN 3 THEN "check" IN ('layout_master_chain', 'relationships') ELSE false END) AS ok
FROM part, (VALUES ('zip_integrity'), ('required_parts'), ('content_types'), ('relationships'), ('wellformed_xml'), ('slide_consistency'), ('layout_master_chain')) AS c("check")""")
def deck_checks(spark, sf_dir):
    return decks.validate(_decks(spark, sf_dir)).select(F.col("path").cast("long").alias("p_partkey"), F.col("check").alias("name"), "ok")


@query("""SELECT p_partkey, true AS notes, false AS macros, false AS links, 2 AS slides FROM part""")
def deck_features(spark, sf_dir):
    listing, _, _, nodes = _read(_decks(spark, sf_dir))
    flags = package.slide_flags(listing, nodes, package.relationships(nodes))
    return flags.select(F.col("path").cast("long").alias("p_partkey"), F.col("has_speaker_notes").alias("notes"), F.col("has_macros").alias("macros"), F.col("has_external_links").alias("links"), F.col("slide_count").cast("int").alias("slides"))


@query("""SELECT p_partkey, 'ppt/slides/slide' || s || '.xml' AS slide, CASE WHEN s = 1 AND p_partkey % 4 = 2 THEN NULL WHEN s = 2 AND p_partkey % 4 = 3 THEN 'ppt/slideLayouts/lost.xml' ELSE 'ppt/slideLayouts/slideLayout1.xml' END AS layout,
  CASE WHEN (s = 1 AND p_partkey % 4 = 2) OR (s = 2 AND p_partkey % 4 = 3) THEN NULL ELSE 'ppt/slideMasters/slideMaster1.xml' END AS master FROM part, (VALUES (1), (2)) AS v(s)""")
def deck_chains(spark, sf_dir):
    """What each slide inherits from."""
    return decks.inheritance(_decks(spark, sf_dir)).select(F.col("path").cast("long").alias("p_partkey"), "slide", "layout", "master")


@query("""SELECT p_partkey, p_partkey || chr(10) || repeat('=', length(p_partkey::VARCHAR)) || chr(10) || chr(10) || '--- Slide 1: ' || p_brand || ' ---' || chr(10) || p_type || chr(10) || '[Notes: say ' || p_brand || ']' || chr(10)
  || CASE WHEN p_partkey % 4 <> 1 THEN chr(10) || '--- Slide 2: ' || p_name || ' ---' || chr(10) ELSE '' END AS text, CASE WHEN p_partkey % 4 <> 1 THEN 2 ELSE 1 END AS slides, p_brand AS first_title FROM part""")
def deck_texts(spark, sf_dir):
    """The text and JSON forms of decks."""
    rows = readers.deck_forms(decks.decks(_decks(spark, sf_dir)))
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "text", F.json_array_length("json").alias("slides"), F.get_json_object("json", "$[0].title").alias("first_title"))


@query("""SELECT doc_id, doc_id % 9 = 0 AS ok, doc_id % 9 = 0 AS has_content FROM documents WHERE doc_id % 9 <> 1""")
def packed_if_valid(spark, sf_dir):
    """Packed again and checked: a copy that fails a check has no content."""
    contents = _read(cut(_word_files(spark, sf_dir)))[2]
    made = sanitize.pack_valid(contents.where("error is null and name is not null"), compress=False)
    return made.select(F.col("path").cast("long").alias("doc_id"), "ok", F.col("content").isNotNull().alias("has_content"))


# -- records ------------------------------------------------------------------------------


@query("""SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(nullif(url, ''), 'video')), '^https?://', ''), '[^a-z0-9а-яё]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90), ''), 'video') AS slug FROM pages""")
def page_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.wide_slug(F.col("url")).alias("slug"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || '-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'meeting') || '-' || o_orderkey AS stem FROM orders""")
def order_stems(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("meeting_start"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("meeting_app"))
    return meetings.stems(rows).select("id", "stem")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN '<redacted>' WHEN p_size % 3 = 0 THEN 'env:' || p_name ELSE p_name END AS value FROM part""")
def hidden_values(spark, sf_dir):
    key = F.when(F.col("p_size") % 2 == 0, "llmApiKey").otherwise("other")
    value = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("env:"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.redact(key, value).alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN p_size % 9 + 1 WHEN p_size % 4 = 2 AND p_size % 10 < 6 THEN p_size % 10 + 1 END AS level FROM part""")
def outline_levels(spark, sf_dir):
    size = F.col("p_size")
    style = F.when(size % 4 == 0, "Title").when(size % 4 == 1, F.concat(F.lit("heading "), (size % 9 + 1).cast("string"))).otherwise("Body")
    return table(spark, sf_dir, "part").select("p_partkey", T.heading_level(style, F.when(size % 4 == 2, size % 10)).cast("int").alias("level"))


@query("""SELECT conv_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn)::INT AS place FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system' AND turn % 5 <> 4""")
def screened_turns(spark, sf_dir):
    """Segments without cloud-only and unwanted speakers, in the order of segments."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") % 3).alias("captured_at"), F.when(F.col("role") == "user", "live").otherwise("background").alias("source"), F.col("role").alias("speaker_name"), F.col("text").alias("transcript"), (F.col("turn") % 5 == 4).alias("cloud_only"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*interval.segment_order()))
    return interval.screen_segments(rows, ["System"]).select("conv_id", "id", place.alias("place"))


@query("""SELECT n_nationkey AS id, count(c_custkey)::INT AS segments, min(c_custkey) AS first_id FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_nationkey""")
def nations_with_customers(spark, sf_dir):
    """A left join that keeps those without any."""
    heads = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    own = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("meeting_id"), F.col("c_custkey").alias("captured_at"), F.col("c_custkey").alias("id"), F.col("c_name").alias("speaker_name"), F.col("c_mktsegment").alias("transcript"))
    return meetings.with_transcripts(heads, own).select("id", F.size("segments").alias("segments"), F.get("segments", F.lit(0))["id"].alias("first_id"))


@query("""SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS k FROM nation) WHERE k IN (7, 2, 5)""")
def picked_nations(spark, sf_dir):
    return meetings.select_by_position(table(spark, sf_dir, "nation"), [F.col("n_nationkey").desc()], "7, 2,7,5").select("n_name")


@query("SELECT p_name, p_brand, count(*) AS copies FROM part GROUP BY p_name, p_brand HAVING count(*) > 1")
def repeated_parts(spark, sf_dir):
    return dedupe.duplicates(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("""SELECT count(*) AS records, count(*) FILTER (WHERE p_size % 5 <> 0) AS generated, count(*) FILTER (WHERE p_size % 5 = 0) AS errors, string_agg(CASE WHEN p_size % 5 = 0 THEN p_partkey || ':brand' END, ',' ORDER BY p_partkey) AS gaps FROM part""")
def letter_report(spark, sf_dir):
    """Template keys that records lack, as the report of a batch."""
    fields = F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("name"), F.col("p_name"))).otherwise(F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), fields.alias("fields"))
    made = templates.bulk_report(templates.bulk_fill(rows, "Dear {{ name }}, {{brand}}", "cast(ord as string)"))
    gaps = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["ord"].cast("string"), F.array_join(e["missing"], "+"))), ",")
    return made.select("records", F.col("generated_count").alias("generated"), F.col("error_count").alias("errors"), gaps.alias("gaps"))


@query("""SELECT p_partkey, '/v/' || p_partkey || '.mp4' AS path, '/v/' || p_partkey || e AS sidecar FROM part, (VALUES ('.vtt'), ('.en.srt')) AS v(e) WHERE p_partkey % 10 = 7 AND p_size % 2 = 0""")
def video_sidecars(spark, sf_dir):
    """Texts beside videos, by folder and stem; 7 beside 17 and 70 have other stems or folders."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 10 = 7")
    base = F.concat(F.lit("/v/"), F.col("p_partkey").cast("string"))
    # Stems of which none starts another: the folder is the key, as the files are told apart by it.
    videos = rows.where("p_size % 2 = 0").select("p_partkey", F.concat(base, F.lit("/clip.mp4")).alias("path"))
    files = rows.select(F.explode(F.array(*[F.concat(base, F.lit("/clip" + e)) for e in (".vtt", ".en.srt", ".png")])).alias("path"))
    found = presets.local_sidecars(videos.select("path"), files.unionByName(rows.select(F.concat(base, F.lit("/other.vtt")).alias("path"))))
    flat = lambda c: F.replace(F.replace(F.col(c), F.lit("/clip"), F.lit("")), F.lit("\\"), F.lit(""))
    return found.select(F.regexp_extract("path", "/v/([0-9]+)/", 1).cast("long").alias("p_partkey"), flat("path").alias("path"), flat("sidecar").alias("sidecar"))


@query("""SELECT DISTINCT tag AS tld, 'whois.' || tag AS server FROM (SELECT lower(string_split(regexp_replace(regexp_replace(trim(url), '(?i)^https?://', ''), '/.*$', ''), '.')[-1]) AS tag FROM pages WHERE url LIKE '%.%') WHERE tag <> ''""")
def zone_servers(spark, sf_dir):
    """Lookup servers by zone, with a trailing slash and in either case."""
    names = domains.normalise_hosts(table(spark, sf_dir, "pages"), "url", "page_id").where("contains(domain, '.')").select(T.tld(F.col("domain")).alias("tld")).where("tld <> ''").distinct()
    services = names.select(F.array("tld").alias("tlds"), F.concat(F.lit("whois."), "tld").alias("server"), F.lit(0).alias("service_ord"))
    return domains.lookup_servers(names, services).select("tld", "server")
