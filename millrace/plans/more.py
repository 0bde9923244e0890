"""Further registered queries: conversations, packages, stores and names, each with its DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, dedupe, domains, inventory, meetings, presets, sanitize, turns
from ..session import cut
from ..sinks import collisions, output_path
from ..sources import package, readers
from .queries import query, table


@query("""WITH b AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS broken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, k::INT AS turn, min(event_type) AS speaker, string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) AS text FROM i GROUP BY user_id, k""")
def collapsed_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("turn"), F.col("event_type").alias("speaker"), F.col("event_id").cast("string").alias("text"))
    return turns.collapse_turns(rows, "user_id")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn, role AS speaker, md5(text) AS digest FROM conversations""")
def transcript_round_trip(spark, sf_dir):
    """Conversations are rendered to transcripts and parsed again."""
    said = turns.collapse_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text"), "conv_id")
    people = said.groupBy("conv_id").agg(F.lit("recorder").alias("source"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.lit("2026-01-01").alias("started_at"), F.lit("").alias("ended_at"))
    people = people.withColumn("participants", F.lit(None).cast("array<struct<name:string,email:string>>"))
    parsed = turns.parse_transcript(turns.render_transcript(people, said, "conv_id"))
    each = parsed.where(F.col("error").isNull()).select("conv_id", F.posexplode("turns").alias("n", "t"))
    return each.select("conv_id", (F.col("n") + 1).alias("turn"), F.col("t.speaker").alias("speaker"), F.md5(F.col("t.text").cast("binary")).alias("digest"))


@query("""SELECT conv_id AS meeting_id, 'Chat meeting' AS title, count(*)::INT AS entries, 'recorder://meeting/' || conv_id AS target, count(DISTINCT role)::INT AS people FROM conversations GROUP BY conv_id""")
def canonical_meetings(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    segment = F.struct(F.col("turn").alias("o"), F.col("role").alias("speakerName"), F.col("text").alias("transcript"), F.lit(None).cast("string").alias("capturedAt"))
    by = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("transcript"), F.concat_ws(";", F.collect_list("role")).alias("attendees"))
    none = F.lit(None).cast("string")
    meeting = F.struct(F.col("conv_id").alias("id"), none.alias("meeting_start"), none.alias("meeting_end"), F.lit("Chat").alias("meeting_app"), none.alias("title"), "attendees", none.alias("note"))
    made = meetings.export(by.select(F.lit(1).alias("schema_version"), meeting.alias("meeting"), "transcript")).where("error is null")
    return made.select("meeting_id", "title", F.size("transcript").alias("entries"), F.col("resources")[0]["target"].alias("target"), F.size("participants").alias("people"))


@query("""WITH b AS (SELECT *, CASE WHEN l_linestatus = 'O' AND lag(l_linestatus) OVER w = 'O' AND l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS broken FROM (SELECT *, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS o FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY l_orderkey ORDER BY o ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT l_orderkey, min(o)::BIGINT AS ord, string_agg(l_linenumber::VARCHAR || ' ', '' ORDER BY o) AS text FROM i GROUP BY l_orderkey, k""")
def merged_runs(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (line.cast("long") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"), (F.col("l_linestatus") == "O").alias("plain"), F.col("l_returnflag").alias("format"), F.concat(line.cast("string"), F.lit(" ")).alias("text"))
    return turns.merge_runs(rows, ["l_orderkey"]).select("l_orderkey", "ord", "text")


@query("""SELECT conv_id, turn AS id, min(turn) OVER (PARTITION BY conv_id) AS root, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS level FROM conversations""")
def reply_threads(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"))
    return meetings.comment_threads(rows).select(F.col("path").alias("conv_id"), "id", "root", "level")


@query("""WITH a AS (SELECT n_name AS person, lower(n_name) AS alias FROM nation UNION ALL SELECT n_name, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT alias, min(person) AS person FROM a GROUP BY alias HAVING count(DISTINCT person) = 1)
SELECT speaker, person FROM (SELECT r_name AS speaker FROM region UNION ALL SELECT n_name FROM nation) LEFT JOIN u ON alias = lower(speaker)""")
def known_people(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.array("r_name").alias("aliases"))
    names = region.select(F.col("r_name").alias("speaker")).unionByName(nation.select(F.col("n_name").alias("speaker")))
    return meetings.resolve_people(names, people)


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE contains(lower(concat_ws(chr(10), c_name, c_mktsegment)), 'build')")
def found_customers(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), none.alias("attendees"), none.alias("note"), F.col("c_mktsegment").alias("meeting_app"))
    return meetings.search(rows, "BUILD").select("id", "title")


@query("""WITH v AS (SELECT p_brand, p_partkey, CASE WHEN p_retailprice > 1200 THEN 'x' ELSE p_partkey::VARCHAR END AS id FROM part),
n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM v WHERE id = 'x'),
f AS (SELECT p_brand, g AS free, row_number() OVER (PARTITION BY p_brand ORDER BY g) AS k FROM (SELECT p_brand, unnest(range(1, count(*) + 1)) AS g FROM v GROUP BY p_brand) s
  WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.p_brand = s.p_brand AND v.id = s.g::VARCHAR))
SELECT p_brand, p_partkey, id::BIGINT AS new_id FROM v WHERE id <> 'x' UNION ALL SELECT p_brand, p_partkey, free FROM n JOIN f USING (p_brand, k)""")
def repaired_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_retailprice") > 1200, "x").otherwise(F.col("p_partkey").cast("string")).alias("id"))
    return dedupe.free_ids(rows, "p_brand", "id", "p_partkey").select("p_brand", "p_partkey", "new_id")


@query("""WITH e AS (SELECT p_brand, bool_or(p_size <= 10) AND bool_or(p_size >= 40) AS both_ends FROM part GROUP BY p_brand)
SELECT p_partkey, p_brand AS family, p_size AS bits FROM part JOIN e USING (p_brand) WHERE NOT (both_ends AND p_size > 10 AND p_size < 40)""")
def outer_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("family"), F.col("p_size").alias("bits"))
    return inventory.skip_middle(rows, 10, 40).select("p_partkey", "family", "bits")


@query("SELECT p_partkey AS repo, p_name AS name, p_size AS size FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE 's%' AND p_size BETWEEN 5 AND 45")
def selected_files(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return inventory.select_files(rows, ["*a*"], ["s*"], 5, 45)


@query("SELECT o_orderkey AS repo, o_totalprice AS size FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark, sf_dir):
    return inventory.largest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo"), F.col("o_totalprice").alias("size")), 25)


@query("""WITH a AS (SELECT source AS repo, doc_id::VARCHAR AS name, doc_id::VARCHAR AS blob, length(text) AS size FROM documents),
b AS (SELECT source AS repo, doc_id::VARCHAR AS blob, n_chars + toxic AS blob_size FROM documents JOIN labels USING (doc_id))
SELECT a.repo, a.name, a.blob, CASE WHEN blob_size IS NULL THEN 'missing_blob' WHEN size <> blob_size THEN 'size_mismatch' ELSE 'complete' END AS state FROM a LEFT JOIN b ON a.repo = b.repo AND a.blob = b.blob""")
def link_audit(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    blob = F.col("doc_id").cast("string")
    links = docs.select(F.col("source").alias("repo"), blob.alias("name"), blob.alias("blob"), F.length("text").alias("size"))
    blobs = docs.join(labels, "doc_id").select(F.col("source").alias("repo"), blob.alias("blob"), (F.col("n_chars") + F.col("toxic")).alias("blob_size"))
    return inventory.audit_links(links, blobs)


@query("""SELECT source AS repo, lang AS home, 'complete' AS status FROM (SELECT DISTINCT source, lang FROM documents) d WHERE lang = 'de' AND EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang <> 'de')""")
def removable_copies(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("home"), F.lit("complete").alias("status")).distinct()
    return inventory.removable(held, "de")


@query("""SELECT r_name, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS grid
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def nation_grids(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"]))
    grid = rows.groupBy("r_name").agg(cells.alias("cells"))
    return grid.select("r_name", T.markdown_table(F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), "cells")).alias("grid"))


@query("""SELECT '/out/' || coalesce(nullif(regexp_replace(p_name, '\\s+', '_', 'g'), ''), 'contract') || '.json' AS output, count(*) AS inputs FROM part GROUP BY 1 HAVING count(*) > 1""")
def output_collisions(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(output_path(F.concat(F.lit("/in/"), T.safe_file_name(F.col("p_name"))), "/out", ".json").alias("output"))
    return collisions(paths)


# -- packages made of the documents --------------------------------------------------

_HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/x"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/word/document.xml" ContentType="{checks.WORD_MAIN}"/></Types>'
)
_RELS = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{checks.OFFICE_DOCUMENT}" Target="word/document.xml"/></Relationships>'
_CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>@</dc:creator><dc:language>#</dc:language></cp:coreProperties>'


def packages(spark, sf_dir):
    """A Word package per document: a paragraph per line, the source as creator. Spanish ones lack their package relationship."""

    @F.pandas_udf("string")
    def body(texts: pd.Series) -> pd.Series:
        from xml.sax.saxutils import escape

        return pd.Series(["".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in (t or "").split("\n")) for t in texts])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", F.coalesce("source", F.lit("")).alias("source"), body("text").alias("body"))
    part = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("binary").alias("content"))
    lacking = F.when(F.col("lang") == "es", F.lit("<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'/>")).otherwise(F.lit(_RELS))
    core = F.replace(F.replace(F.lit(_CORE), F.lit("@"), F.col("source")), F.lit("#"), F.col("lang"))
    parts = F.array(
        part("word/document.xml", F.concat(F.lit(_HEAD), "body", F.lit("</w:body></w:document>"))), part("[Content_Types].xml", F.lit(_TYPES)), part("_rels/.rels", lacking), part("docProps/core.xml", core)
    )
    return sanitize.pack(docs.select("path", F.explode(parts).alias("p")).select("path", "p.*"), compress=False)  # repeated text would pass the gate's ratio


@query("""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS paragraphs, md5(coalesce(text, '')) AS digest FROM documents""")
def package_round_trip(spark, sf_dir):
    """Documents are packed as Word files, gated, unpacked, parsed and read back."""
    files = packages(spark, sf_dir)
    report = package.safety(package.members(files))
    nodes = package.xml_nodes(package.parts(files, report, ["word/document.xml"]))
    paras = readers.paragraphs(nodes)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    back = paras.groupBy("path").agg(lines.alias("lines"))
    return back.select(F.col("path").cast("long").alias("doc_id"), F.size("lines").alias("paragraphs"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest"))


@query("""SELECT doc_id, lang <> 'es' AS ok, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS failed_checks FROM documents""")
def package_verdicts(spark, sf_dir):
    files = cut(packages(spark, sf_dir))
    listing = cut(package.members(files))
    report = cut(package.safety(listing))
    contents = package.parts(files, report)
    # Ten checks read these tables: they are written once, the contents only as far as they are damaged.
    damaged = cut(contents.where("error is not null"))
    verdicts = checks.validate(files, listing, report, damaged, cut(package.xml_nodes(contents)))
    return checks.overall(verdicts).select(F.col("path").cast("long").alias("doc_id"), "ok", F.col("failed_checks").cast("int").alias("failed_checks"))


@query("""SELECT doc_id, source AS before, NULL::VARCHAR AS after, lang AS language FROM documents""")
def cleared_metadata(spark, sf_dir):
    """The creator goes, the language stays."""
    files = packages(spark, sf_dir)
    contents = package.parts(files, None, ["docProps/core.xml"])
    clean = sanitize.sanitize(contents, ["metadata"]).withColumn("error", F.lit(None).cast("string"))
    before, after = (package.metadata(package.xml_nodes(c)) for c in (contents, clean))
    rows = before.select("path", F.try_element_at("metadata", F.lit("creator")).alias("before")).join(after, "path")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "before", F.try_element_at("metadata", F.lit("creator")).alias("after"), F.try_element_at("metadata", F.lit("language")).alias("language"))


# -- saved answers and listings, given as values ----------------------------------------


@query("""SELECT * FROM (VALUES (0, 'a.ru', 'available', 'a.ru - Available price: 199.00 RUR'), (1, 'b.ru', 'unavailable', 'b.ru - error (E) [premium]')) AS v(ord, dname, class, line)""")
def registrar_lines(spark, sf_dir):
    answer = '{"result":"success","answer":{"domains":[{"dname":"a.ru","result":"Available","price":"199.00","currency":"RUR"},{"domain_name":"b.ru","result":"error","error_code":"E","is_premium":1}]}}'
    items = domains.registrar_items(spark.createDataFrame([(answer,)], "value string")).where("error is null")
    return items.select("ord", "dname", domains.available(F.col("result")).alias("class"), domains.item_line().alias("line"))


@query("""SELECT * FROM (VALUES (1, 'ru-orig', 'Russian', 'automatic'), (2, 'de', 'German', 'manual')) AS v(input_id, code, name, source)""")
def chosen_tracks(spark, sf_dir):
    first = ["Available automatic captions for x", "Language Name   Formats", "ru-orig  Russian  vtt, srt", "en  English  vtt", "Available subtitles for x", "de  German  vtt"]
    second = ["Available automatic captions for y", "fr  French  vtt", "Available subtitles for y", "de  German  vtt"]
    lines = spark.createDataFrame([(i + 1, n, line) for i, text in enumerate((first, second)) for n, line in enumerate(text)], "input_id int, ord int, line string")
    return presets.choose_language(presets.subtitle_tracks(lines)).select("input_id", "code", "name", "source")


@query("""SELECT * FROM (VALUES ('audio', '--max 4 --multi-res 3'), ('screen', '--threshold 0.2 --width 1600 --ocr')) AS v(name, args)""")
def preset_flags(spark, sf_dir):
    options = [("screen", "ocr", "true", "boolean"), ("screen", "width", "1600", "number"), ("screen", "threshold", "0.2", "number"), ("audio", "transcribe", "env", "string"), ("audio", "noReport", "false", "boolean"), ("audio", "max", "4", "number"), ("audio", "multiRes", "3", "number")]
    made = presets.flag_list(spark.createDataFrame(options, "name string, key string, value string, kind string"))
    return made.select("name", F.array_join("args", " ").alias("args"))
