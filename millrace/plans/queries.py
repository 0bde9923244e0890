"""The registered queries of the record, conversation and name operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe, domains, interval, inventory, meetings, presets, templates, turns
from ..sinks import import_status
from ..streaming import events as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_HOSTS = """hosts AS (SELECT page_id, h FROM (SELECT page_id, nullif(lower(regexp_replace(regexp_replace(trim(url), '(?i)^https?://', ''), '/.*$', '')), '') AS h FROM pages)
  WHERE h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h ORDER BY page_id) = 1)"""


@query(f"WITH {_HOSTS} SELECT page_id, h AS domain, lower(string_split(h, '.')[-1]) AS tld FROM hosts")
def host_names(spark, sf_dir):
    rows = domains.normalise_hosts(table(spark, sf_dir, "pages"), "url", "page_id")
    return rows.select("page_id", "domain", T.tld(F.col("domain")).alias("tld"))


@query(f"""WITH {_HOSTS}, c AS (SELECT page_id, h, CASE string_split(h, '.')[-1] WHEN 'org' THEN 'free' WHEN 'com' THEN 'taken' ELSE 'err' END AS tag FROM hosts)
SELECT tag, count(*) AS n, string_agg(h, ',' ORDER BY page_id) AS names FROM c GROUP BY tag""")
def host_report(spark, sf_dir):
    rows = domains.normalise_hosts(table(spark, sf_dir, "pages"), "url", "page_id").withColumnRenamed("page_id", "ord")
    zone = T.tld(F.col("domain"))
    status = F.when(zone == "org", domains.FREE).when(zone == "com", domains.TAKEN).otherwise(domains.UNKNOWN)
    return domains.report(rows.withColumn("status", status)).withColumn("names", F.array_join("names", ","))


_SERVICES = [(0, ["com", "net"], "https://one.test"), (1, ["net", "org"], "https://two.test")]


@query(f"""WITH {_HOSTS}, s AS (SELECT page_id, h, string_split(h, '.')[-1] AS zone,
  CASE WHEN h LIKE 'www.%' THEN 200 WHEN h LIKE 'm.%' THEN 404 WHEN h LIKE 'blog.%' THEN 500 END AS code,
  CASE WHEN contains(h, 'io') THEN 'free' WHEN contains(h, 'e') THEN 'taken' END AS body FROM hosts),
r AS (SELECT *, zone IN ('com', 'net', 'org') AND code IN (200, 404) AS structured FROM s)
SELECT page_id AS ord, h AS domain, zone AS tld, CASE WHEN structured THEN 'rdap' ELSE 'whois' END AS method,
  CASE WHEN structured THEN CASE code WHEN 200 THEN 'registered' ELSE 'appears_unregistered' END
  ELSE CASE body WHEN 'free' THEN 'appears_unregistered' WHEN 'taken' THEN 'registered' ELSE 'unknown' END END AS status FROM r""")
def name_check(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = domains.normalise_hosts(pages, "url", "page_id")
    names = domains.normalise(hosts, "domain", "page_id").withColumnRenamed("page_id", "ord")
    h = F.col("ascii_domain")
    saved = names.where("problem is null").select(
        F.col("ascii_domain").alias("domain"), F.when(h.startswith("www."), 200).when(h.startswith("m."), 404).when(h.startswith("blog."), 500).alias("http_status"),
        F.when(h.contains("io"), "No match. Domain: x").when(h.contains("e"), "DOMAIN: x").otherwise("hello").alias("whois_body"), F.lit(0).alias("ns"), F.lit(0).alias("soa"),
    )
    services = spark.createDataFrame(_SERVICES, "service_ord int, tlds array<string>, server string")
    return domains.check(names, saved, services).select("ord", "domain", "tld", "method", "status")


@query("""SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'meeting') AS slug FROM documents""")
def document_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("""WITH s AS (SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[\\\\/:*?"<>|]+', '-', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'contract') AS n FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY p_partkey) AS k FROM s)
SELECT p_partkey, n AS name, CASE WHEN k = 1 THEN n ELSE n || '-' || k END AS unique_name FROM r""")
def file_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", T.safe_file_name(F.col("p_name")).alias("name"))
    return dedupe.numbered_names(parts, "name", ["p_partkey"])


@query("""SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest, count(*) AS copies FROM documents GROUP BY 2""")
def content_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.digest(F.coalesce("text", F.lit(""))).alias("digest"))
    kept = dedupe.first_wins(docs, "digest", ["doc_id"])
    counts = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(counts, "digest").select("doc_id", "digest", "copies")


@query("""WITH b AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS broken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY user_id, island""")
def event_islands(spark, sf_dir):
    rows = turns.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def _near(seconds: int) -> str:
    return f"""SELECT event_id, user_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.ts BETWEEN v.ts - INTERVAL {seconds} SECOND AND v.ts + INTERVAL {seconds} SECOND)"""


@query(_near(15))
def quiet_views(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = interval.drop_near(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 15, row_id="event_id")
    return rows.select("event_id", "user_id")


@query(_near(60))
def quiet_views_minute(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = interval.drop_near(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 60, row_id="event_id")
    return rows.select("event_id", "user_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN b.doc_id IS NULL THEN 'first' ELSE 'second' END AS found_in
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def label_overlap(spark, sf_dir):
    return inventory.compare(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


_PRESETS = [("english-general", "the common one", ["the", "tion"], True), ("licence", "", ["license", "copyright"], False), ("youtube-talk", "a youtube talk", ["ung", "lich"], True)]


@query("""WITH p(name, match, prefers) AS (VALUES ('english-general', ['the', 'tion'], true), ('licence', ['license', 'copyright'], false), ('youtube-talk', ['ung', 'lich'], true)),
s AS (SELECT doc_id AS input_id, name, (SELECT coalesce(sum(2), 0) FROM unnest(match) AS u(t) WHERE contains(lower(concat_ws(' ', source, text)), t))
  + CASE WHEN prefers AND lang = 'en' THEN 1 ELSE 0 END AS score FROM documents, p)
SELECT input_id, name, CASE WHEN score = 0 AND name LIKE '%general%' THEN 1 ELSE score END::INT AS score,
  row_number() OVER (PARTITION BY input_id ORDER BY CASE WHEN score = 0 AND name LIKE '%general%' THEN 1 ELSE score END DESC, name)::INT AS place FROM s""")
def preset_ranking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("input_id"), F.col("source").alias("input"), "text", (F.col("lang") == "en").cast("int").alias("n_subtitles"), F.lit(0).alias("n_sidecars"))
    rules = spark.createDataFrame(_PRESETS, "name string, description string, match array<string>, preferSubtitles boolean")
    ranked = presets.rank_presets(docs, rules)
    place = F.row_number().over(Window.partitionBy("input_id").orderBy(*presets.best_first()))
    return ranked.select("input_id", "name", F.col("score").cast("int").alias("score"), place.alias("place"))


@query("""SELECT o_orderstatus AS collection, o_custkey::VARCHAR AS name, o_orderkey AS value FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def layered_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("collection"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("priority"))
    return presets.merge_layers(rows, F.col("value"))


@query("""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '\\s+', ' ', 'g')) AS x FROM pages)
SELECT page_id, md5(x) AS digest, len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))::INT AS words FROM t""")
def page_text(spark, sf_dir):
    clean = table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("x"))
    return clean.select("page_id", F.md5(F.col("x").cast("binary")).alias("digest"), T.word_count(F.col("x")).alias("words"))


@query("""SELECT source, bool_or(contains(lower(text), 'license')) AS has_license, bool_or(contains(text, '@')) AS has_address, count(*) FILTER (WHERE length(text) < 100) AS short_count,
  round(max(length(text)::DOUBLE / greatest(n_chars, 1)), 2) AS max_ratio, sum(length(text))::BIGINT AS total FROM documents GROUP BY source""")
def source_flags(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.length("text")
    return docs.groupBy("source").agg(
        F.bool_or(F.lower("text").contains("license")).alias("has_license"), F.bool_or(F.col("text").contains("@")).alias("has_address"), F.count_if(n < 100).alias("short_count"),
        F.round(F.max(n.cast("double") / F.greatest("n_chars", F.lit(1))), 2).alias("max_ratio"), F.sum(n).alias("total"),
    )


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-06-30'
ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 100""")
def urgent_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate between timestamp_ntz '1995-01-01' and timestamp_ntz '1998-06-30'")
    return meetings.page(rows, ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT source AS repo, max(n_chars) FILTER (WHERE lang = 'de') AS de, max(n_chars) FILTER (WHERE lang = 'en') AS en,
  max(n_chars) FILTER (WHERE lang = 'es') AS es, max(n_chars) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source""")
def source_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("home"), F.col("n_chars").alias("status"))
    return inventory.status_matrix(rows, ["de", "en", "es", "fr"])


@query("""SELECT l_suppkey AS repo, count(*) AS n_files, sum(l_partkey)::BIGINT AS total, coalesce(sum(l_partkey) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT AS cached,
  coalesce(sum(l_partkey) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS remaining FROM lineitem GROUP BY l_suppkey""")
def store_sizes(spark, sf_dir):
    return inventory.sizes(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("size"), (F.col("l_returnflag") == "R").alias("is_cached")))


@query("""WITH r AS (SELECT l_suppkey AS page, floor(l_quantity * 4 / 10) AS row_no, count(*) AS n, count(DISTINCT floor(l_linenumber * 40 / 10)) AS cols, sum(l_linenumber * 20) AS c FROM lineitem GROUP BY 1, 2),
p AS (SELECT page, count(*) FILTER (WHERE n >= 4 AND cols >= 3) AS table_rows, sum(c) / sum(n) AS m FROM r GROUP BY page)
SELECT page, round(m, 6) AS mean_confidence, table_rows, table_rows >= 3 AS is_table, (m < 60 OR table_rows >= 3) AS flagged FROM p""")
def page_grids(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_linenumber") * 40).alias("x"), (F.col("l_quantity") * 4).alias("y"), (F.col("l_linenumber") * 20).alias("confidence"))
    return inventory.page_tables(words).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp,
  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn, avg(((quality = 1) = (toxic = 0))::INT)::DOUBLE AS accuracy FROM labels""")
def label_accuracy(spark, sf_dir):
    return inventory.trigger_accuracy(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("should_trigger"), (F.col("toxic") == 0).alias("did_trigger")))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<[^>]+>', '', 'g'), '&amp;', '&', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '\\s+', ' ', 'g')) AS x FROM l
  WHERE line <> 'WEBVTT' AND NOT regexp_matches(line, '(?i)^(kind|language):') AND NOT regexp_matches(line, '^[0-9]+$') AND NOT regexp_matches(line, '(?i)^note\\b')
  AND NOT regexp_matches(line, '^([0-9]{2}:)?[0-9]{2}:[0-9]{2}[,.][0-9]{3}\\s+-->'))
SELECT doc_id, count(*) AS lines, sum(length(x))::BIGINT AS chars FROM c WHERE x <> '' AND NOT regexp_matches(x, '^\\[.*\\]$') GROUP BY doc_id""")
def spoken_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    said = lines.select("doc_id", T.spoken_line(F.col("line")).alias("x")).where("x is not null")
    return said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("x")).alias("chars"))


@query("""SELECT page_id, regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://') AS is_url, regexp_matches(url, '(?i)^https?://') AS is_http,
  regexp_matches(url, '(?i)(^|\\.)youtu\\.be/') OR regexp_matches(url, '(?i)(^|\\.)youtube\\.com/') AS is_youtube FROM pages""")
def url_kinds(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.is_url(url).alias("is_url"), T.is_http(url).alias("is_http"), T.is_youtube(url).alias("is_youtube"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'created' WHEN a.doc_id IS NULL THEN 'absent' WHEN a.source = b.source THEN 'unchanged' ELSE 'updated' END AS status
FROM documents a FULL JOIN (SELECT doc_id, 'src' || quality AS source FROM labels) b ON a.doc_id = b.doc_id""")
def import_states(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("src"), F.col("quality").cast("string")).alias("source"))
    return import_status(table(spark, sf_dir, "documents").select("doc_id", "source"), old, "doc_id", "source")


@query("""SELECT p_partkey AS ord, 'Dear ' || p_name || ' of ' || p_brand || ', {{unknown}}' AS content FROM part""")
def filled_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand").alias("fields"))
    return rows.select("ord", templates.fill(F.lit("Dear {{ name }} of {{brand}}, {{unknown}}"), F.col("fields")).alias("content"))


@query("""SELECT c.conv_id, c.turn, l.n AS links, c.role FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) l USING (conv_id)""")
def conversation_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("links"), "role")


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    shown = "yyyy-MM-dd HH:mm:ss"
    return streams.sessions(events).select("user_id", F.date_format("started", shown).alias("started"), F.date_format("ended", shown).alias("ended"), "n")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_hours(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return streams.counts(events, "1 hour").select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n")


@query(r"""SELECT doc_id, md5(array_to_string(list_reduce(
  list_transform(string_split(text, chr(10)), lambda l: list_filter(regexp_split_to_array(l, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')),
  lambda done, words: list_concat(done, words[1 + list_max(list_filter(range(0, least(len(done), len(words)) + 1), lambda n: n = 0 OR (lower(words[n]) = lower(done[len(done)])
    AND list_transform(done[len(done) - n + 1:], lambda w: lower(w)) = list_transform(words[:n], lambda w: lower(w))))):]),
  []::VARCHAR[]), ' ')) AS digest FROM documents""")
def merged_overlaps(spark, sf_dir):
    """A fold over the lines of a document, on both sides."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(turns.merge_overlaps(F.split("text", "\n")).cast("binary")).alias("digest"))


@query("SELECT s_suppkey, s_name, n.n_name, r.r_name FROM supplier JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def inherited_regions(spark, sf_dir):
    """A chain of lookups, as a slide has of its layout, master and theme."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT v.id, v.people FROM (VALUES (1, 'A <a@x.test>|<b@x.test>'), (2, 'Ann|Bo <bo@x.test>'), (3, ''), (4, 'Cy <c@x.test>')) AS v(id, people)""")
def attendee_lists(spark, sf_dir):
    rows = spark.createDataFrame(
        [(1, '[{"name":"A","email":"a@x.test"},{"name":"AA","email":"A@x.test"},"b@x.test"]'), (2, "Ann; Bo <bo@x.test>\nann"), (3, "  "), (4, '{"name":"Cy","email":"c@x.test"}')], "id int, attendees string"
    )
    people = F.transform(meetings.participants(F.col("attendees")), lambda p: F.concat_ws(" ", F.nullif(p["name"], F.lit("")), F.when(p["email"] != "", F.concat(F.lit("<"), p["email"], F.lit(">")))))
    return rows.select("id", F.array_join(people, "|").alias("people"))
