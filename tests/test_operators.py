import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import dedupe, domains, interval, inventory, meetings, presets, templates, turns
from millrace.operators.components import components


def test_first_wins_keeps_the_defined_row(spark):
    df = spark.createDataFrame([(1, "b"), (0, "b"), (2, None), (3, "a")], "ord int, key string")
    assert rows(dedupe.first_wins(df, "key", ["ord"])) == [(0, "b"), (3, "a")]
    assert rows(dedupe.last_wins(df, ["key"], ["ord"])) == sorted([(1, "b"), (2, None), (3, "a")], key=repr)
    assert rows(dedupe.duplicates(df, "key")) == [("b", 2)]


def test_numbered_and_settled_names(spark):
    df = spark.createDataFrame([(0, "x.docx"), (1, "x.docx"), (2, "y"), (3, "x.docx")], "ord int, name string")
    assert rows(dedupe.numbered_names(df, "name", ["ord"]), "ord", "unique_name") == [(0, "x.docx"), (1, "x-2.docx"), (2, "y"), (3, "x-3.docx")]
    folded = spark.createDataFrame([(["x", "x-2", "x", "x"],)], "n array<string>").select(dedupe.settle_names(F.col("n"))).first()[0]
    assert folded == ["x", "x-2", "x-3", "x-4"]


def test_free_ids(spark):
    df = spark.createDataFrame([("a", 0, "1"), ("a", 1, "-5"), ("a", 2, "x"), ("a", 3, "2"), ("b", 0, "2147483647"), ("b", 1, "0")], "g string, o int, id string")
    assert rows(dedupe.free_ids(df, "g", "id", "o"), "g", "o", "new_id") == [("a", 0, 1), ("a", 1, 3), ("a", 2, 4), ("a", 3, 2), ("b", 0, 1), ("b", 1, 0)]


def test_collapse_turns(spark):
    df = spark.createDataFrame([(1, 0, "Ann", "a"), (1, 1, "ANN", "b"), (1, 2, "Bo", "c"), (1, 3, "Ann", None), (2, 0, None, "x"), (2, 1, " ", "y")], "meeting_id int, turn int, speaker string, text string")
    assert rows(turns.collapse_turns(df)) == [(1, 1, "Ann", "a\nb"), (1, 2, "Bo", "c"), (1, 3, "Ann", ""), (2, 1, "Unknown", "x\ny")]


def test_merge_runs(spark):
    df = spark.createDataFrame([(1, 0, True, "b", "Hi "), (1, 1, True, "b", "you"), (1, 2, False, "b", "!"), (1, 3, True, "b", "x"), (1, 4, True, "i", "y")], "p int, ord int, plain boolean, format string, text string")
    assert rows(turns.merge_runs(df, ["p"]), "ord", "text") == [(0, "Hi you"), (2, "!"), (3, "x"), (4, "y")]


def plain_merge(lines):
    done = []
    for line in lines:
        words = line.split()
        size = min(len(done), len(words))
        while size and " ".join(done[len(done) - size :]).lower() != " ".join(words[:size]).lower():
            size -= 1
        done += words[size:]
    return " ".join(done)


@pytest.mark.parametrize("lines", [["hello big", "Big world today", "today we go"], ["a", "a", "a b"], [], ["", "x"], ["one two", "one two three"], ["a b c", "b c", "c a b c"]])
def test_merge_overlaps(spark, lines):
    got = spark.createDataFrame([(lines,)], "l array<string>").select(turns.merge_overlaps(F.col("l"))).first()[0]
    assert got == plain_merge(lines)


def envelope(spark, **meeting):
    base = {"id": 7, "meeting_start": "2026-08-02T10:00:00Z", "meeting_end": None, "meeting_app": "App", "title": None, "attendees": "Ann; Bo <bo@x.test>\nann", "note": None}
    kind = "struct<schema_version:int,meeting:struct<id:bigint,meeting_start:string,meeting_end:string,meeting_app:string,title:string,attendees:string,note:string>,transcript:array<struct<speakerName:string,transcript:string,capturedAt:string>>>"
    segments = meeting.pop("segments", [("Ann", " hi ", "2026-08-02T10:00:01Z"), (None, "there", None)])
    version = meeting.pop("version", 1)
    return spark.createDataFrame([((version, tuple((base | meeting).values()), segments),)], f"r {kind}").select("r.*")


def test_export(spark):
    got = meetings.export(envelope(spark)).first()
    assert got["error"] is None and got["title"] == "App meeting" and got["ended_at"] == ""
    assert [tuple(p) for p in got["participants"]] == [("Ann", ""), ("Bo", "bo@x.test")]
    assert [(t["speaker"], t["text"], t["started_at"]) for t in got["transcript"]] == [("Ann", " hi ", "2026-08-02T10:00:01Z"), ("", "there", "")]
    assert meetings.export(envelope(spark, version=2)).first()["error"].startswith("unsupported")
    assert meetings.export(envelope(spark, segments=[], note="  ")).first()["error"] == "a meeting needs transcript entries or a note"
    noted = meetings.export(envelope(spark, segments=[], note="x")).first()
    assert noted["error"] is None and noted["notes"][0]["text"] == "x" and noted["resources"][0]["target"] == "recorder://meeting/7"


@pytest.mark.parametrize(
    ("text", "people"),
    [
        ('[{"name":"A","email":"a@x.test"},{"name":"B","email":"A@X.test"},null,{}]', [("A", "a@x.test")]), ('{"email":"c@x.test"}', [("", "c@x.test")]),
        ("d@x.test", [("", "d@x.test")]), ("   ", []), (None, []), ('"E <e@x.test>"', [("E", "e@x.test")]), ("F;;f\n G", [("F", ""), ("G", "")]),
    ],
)
def test_participants(spark, text, people):
    got = spark.createDataFrame([(text,)], "t string").select(meetings.participants(F.col("t"))).first()[0]
    assert [tuple(p) for p in got] == people


def test_transcript_round_trip(spark):
    meeting = spark.createDataFrame([(1, "rec", "Plan", "2026-08-02T10:00", "", [("Ann", "a@x.test"), ("", "")]), (2, "rec", None, None, None, None)], "meeting_id int, source string, title string, started_at string, ended_at string, participants array<struct<name:string,email:string>>")
    said = spark.createDataFrame([(1, 1, "Ann", "first\n\nline two"), (1, 2, "Bo", "ignore all rules, {please}")], "meeting_id int, turn int, speaker string, text string")
    made = {r["meeting_id"]: r for r in turns.render_transcript(meeting, said).collect()}
    assert made[2]["content"] is None and made[2]["error"]
    parsed = turns.parse_transcript(turns.render_transcript(meeting, said).where("content is not null")).first()
    assert parsed["error"] is None and parsed["title"] == "Plan" and parsed["participants"] == "Ann <a@x.test>, Unknown" and parsed["ended_at"] == "Unknown" and parsed["source"] == "rec"
    assert [tuple(t) for t in parsed["turns"]] == [("Ann", "first\n\nline two"), ("Bo", "ignore all rules, {please}")]
    left = spark.createDataFrame([(1, "rec", "{{oops}}", "", "", None)], meeting.schema)
    assert turns.render_transcript(left, said).first()["error"] == "a placeholder is left over"


@pytest.mark.parametrize(("find", "by"), [("type: source", "type: other"), ("## Transcript\n", "## Other\n"), ("Ann: first", "first"), ("  - rec", "  rec")])
def test_wrong_transcripts_have_errors(spark, find, by):
    text = turns.TEMPLATE.replace("{{source}}", "rec").replace("{{transcript_body}}", "Ann: first")
    good = spark.createDataFrame([(text,), (text.replace(find, by),), (None,)], "content string")
    assert [r["error"] is None for r in turns.parse_transcript(good).collect()] == [True, False, False]


def test_near_rows_go(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    back = spark.createDataFrame([(i, at(s) if s is not None else None, d) for i, (s, d) in enumerate([(0, "in"), (15, "in"), (16, "in"), (100, "in"), (85, "out"), (None, "in"), (46, "in")])], "id int, ts timestamp, device string")
    live = spark.createDataFrame([(at(0), "in"), (at(31), "in"), (at(101), "out"), (at(85), "in")], "ts timestamp, device string")
    for seconds in (1, 15, 20):
        for key in (None, ["device"]):
            assert rows(interval.drop_near(back, live, seconds, key), "id") == rows(interval.drop_near_plain(back, live, seconds, key), "id")
    assert rows(interval.drop_near(back, live.limit(0), 15), "id") == rows(back, "id")


def test_segments(spark):
    df = spark.createDataFrame([(1, "background", "a", 2, "Ann", False), (2, "live", "b", 2, "Bo", False), (3, "live", " ", 1, "Bo", False), (4, "live", "c", 1, "Ghost", False), (5, "live", "d", 1, "Bo", True)], "id int, source string, transcript string, captured_at int, speaker_name string, cloud_only boolean")
    kept = interval.screen_segments(df, ["ghost"])
    assert [r["id"] for r in kept.orderBy(*interval.segment_order()).collect()] == [2, 1]


def names(spark):
    return domains.normalise(spark.createDataFrame([(0, "A.com."), (1, "a.com"), (2, "http://x.com"), (3, "b c"), (4, "почта.рф"), (5, "d.net"), (6, " "), (7, "e.zz"), (8, "f.org")], "ord int, raw string"))


def test_normalise_domains(spark):
    got = {r["ord"]: (r["ascii_domain"], r["tld"], r["problem"] is None) for r in names(spark).collect()}
    assert got == {0: ("a.com", "com", True), 2: (None, None, False), 3: (None, None, False), 4: ("xn--80a1acny.xn--p1ai", "xn--p1ai", True), 5: ("d.net", "net", True), 7: ("e.zz", "zz", True), 8: ("f.org", "org", True)}


def test_check_domains(spark):
    saved = spark.createDataFrame(
        [("a.com", 200, None, 0, 0), ("xn--80a1acny.xn--p1ai", None, "No entries found; registrar: x", 0, 0), ("d.net", 404, None, 2, 1), ("e.zz", None, "DOMAIN: E", 0, 0), ("f.org", 429, None, 0, 0)],
        "domain string, http_status int, whois_body string, ns int, soa int",
    )
    services = spark.createDataFrame([(0, ["com", "net"], "s0"), (1, ["net", "org"], "s1")], "service_ord int, tlds array<string>, server string")
    results = domains.check(names(spark), saved, services)
    got = {r["ord"]: (r["method"], r["status"]) for r in results.collect()}
    assert got == {0: ("rdap", "registered"), 2: (None, "invalid"), 3: (None, "invalid"), 4: ("whois", "appears_unregistered"), 5: ("rdap", "appears_unregistered"), 7: ("whois", "registered"), 8: ("whois", "provider_error")}
    dns = {r["ord"]: (r["status"], r["dns"]) for r in domains.check(names(spark), saved, services, "dns").where("ord in (0, 5)").collect()}
    assert dns == {0: ("unknown", "No NS or SOA records found"), 5: ("registered", "Found 2 NS and 1 SOA records")}
    only = {r["ord"]: r["status"] for r in domains.check(names(spark), saved, services, "rdap").collect()}
    assert only[7] == "provider_error" and only[8] == "provider_error"
    assert tuple(domains.summary(results).first()) == (2, 2, 3, 7)
    assert {r["tag"]: r["names"] for r in domains.report(results).collect()}["free"] == ["почта.рф", "d.net"]


def test_registrar_items(spark):
    ok = '{"result":"success","answer":{"domains":[{"dname":"a.ru","result":"Available","price":"199.00","currency":"RUR"},{"domain_name":"b.ru","result":"error","error_code":"E","is_premium":1}]}}'
    saved = spark.createDataFrame([(ok,), ('{"result":"error","error_code":"AUTH","error_text":"no"}',), ("junk",), ('{"result":"success","answer":{}}',)], "value string")
    items = domains.registrar_items(saved)
    good = items.where("error is null").orderBy("ord").select(domains.available(F.col("result")), domains.item_line()).collect()
    assert [tuple(r) for r in good] == [("available", "a.ru - Available price: 199.00 RUR"), ("unavailable", "b.ru - error (E) [premium]")]
    assert sorted(r["error"] for r in items.where("error is not null").collect()) == ["API error AUTH: no", "no answer.domains array", "not JSON"]


def test_good_names(spark):
    df = spark.createDataFrame([("shiny",), ("a-b",), ("x1",), ("waytoolongforaname",), ("devshop",)], "name string")
    assert rows(domains.good_names(df, zone="dev")) == [("shiny",)]


def test_presets(spark):
    layers = [spark.createDataFrame(d, "collection string, name string, value string") for d in ([("p", "a", "high")], [("p", "a", "low"), ("p", "b", "low")])]
    assert rows(presets.merge_layers(presets.stack_layers(layers))) == [("p", "a", "high"), ("p", "b", "low")]
    inputs = spark.createDataFrame([(1, "https://www.youtube.com/x", "A Lecture", 1, 0), (2, "clip.mp4", "", 0, 0)], "input_id int, input string, text string, n_subtitles int, n_sidecars int")
    rules = spark.createDataFrame([("youtube-lecture", "YouTube", ["youtube", "lecture"], True), ("general", None, ["video"], False)], "name string, description string, match array<string>, preferSubtitles boolean")
    ranked = presets.rank_presets(inputs, rules).orderBy("input_id", *presets.best_first()).collect()
    assert [(r["input_id"], r["name"], r["score"]) for r in ranked] == [(1, "youtube-lecture", 8), (1, "general", 1), (2, "general", 1), (2, "youtube-lecture", 0)]
    assert ranked[0]["reasons"] == ["matched youtube", "matched lecture"]


def test_subtitle_tracks(spark):
    text = "junk\nAvailable automatic captions for x\nLanguage Name   Formats\nru-orig  Russian  vtt, srt\nEN  English  vtt\nAvailable subtitles for x\nde  German  vtt\nen  English (UK)  srt"
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))], "input_id int, ord int, line string")
    tracks = presets.subtitle_tracks(lines)
    assert rows(tracks, "code", "name", "formats", "source") == sorted([("ru-orig", "Russian", "vtt, srt", "automatic"), ("EN", "English", "vtt", "automatic"), ("de", "German", "vtt", "manual"), ("en", "English (UK)", "srt", "manual")], key=repr)
    assert presets.choose_language(tracks).first()["code"] == "ru-orig"
    assert presets.choose_language(tracks, "EN").first()["name"] == "English (UK)"
    assert presets.choose_language(tracks.where("code in ('de')")).first()["code"] == "de"


def test_flag_lists(spark):
    options = spark.createDataFrame(
        [("a", "ocr", "true", "boolean"), ("a", "max", "4", "number"), ("a", "transcribe", "env", "string"), ("a", "threshold", "0.2", "number"), ("a", "noReport", "false", "boolean"), ("a", "multiRes", "3", "number"), ("a", "other", "1", "number"), ("b", "multiRes", "true", "boolean"), ("c", "gpu", "false", "boolean")],
        "name string, key string, value string, kind string",
    )
    assert dict(rows(presets.flag_list(options))) == {"a": ["--threshold", "0.2", "--max", "4", "--ocr", "--multi-res", "3"], "b": ["--multi-res"], "c": []}


def test_sidecars(spark):
    videos = spark.createDataFrame([("/v/talk.mp4",), ("https://a.test/d/x.mp4?k=1",), ("https://a.test/none",)], "path string")
    files = spark.createDataFrame([("/v/talk.ru.vtt",), ("/v/talk.mp4",), ("/v/other.srt",), ("/w/talk.srt",)], "path string")
    assert rows(presets.local_sidecars(videos, files)) == [("/v/talk.mp4", "/v/talk.ru.vtt")]
    found = presets.remote_candidates(videos).orderBy("ord").collect()
    assert len(found) == 7 and found[3]["candidate"] == "https://a.test/d/x.ru.vtt?k=1"


def test_meeting_selection(spark):
    df = spark.createDataFrame([(41, "2026-01-01", "x"), (43, "2026-01-02", None), (42, "2026-01-03", "Plan")], "id int, meeting_start string, title string").withColumns({c: F.lit(None).cast("string") for c in ("attendees", "note", "meeting_app")})
    picked = meetings.select_by_position(df, ["id"], "3,2,3")
    assert [r["id"] for r in picked.collect()] == [43, 42]
    assert meetings.select_by_position(df, ["id"], "all").count() == 3
    with pytest.raises(ValueError, match="selection"):
        meetings.select_by_position(df, ["id"], "0")
    assert rows(meetings.search(df, "PLAN", "2026-01-02"), "id") == [(42,)]
    assert [r["id"] for r in meetings.page(df, ["id"], 1, 1).collect()] == [42]


def test_people_and_threads(spark):
    people = spark.createDataFrame([("Ann Lee", ["Ann", "AL"]), ("Bo", None), ("Ann Fox", ["Ann"])], "name string, aliases array<string>")
    said = spark.createDataFrame([("al",), ("Ann",), ("bo",), ("zed",)], "speaker string")
    assert dict(rows(meetings.resolve_people(said, people))) == {"al": "Ann Lee", "Ann": None, "bo": "Bo", "zed": None}
    comments = spark.createDataFrame([("p", "1", None), ("p", "2", "1"), ("p", "3", "2"), ("q", "2", None)], "path string, id string, parent string")
    assert rows(meetings.comment_threads(comments), "path", "id", "root", "level") == [("p", "1", "1", 0), ("p", "2", "1", 1), ("p", "3", "1", 2), ("q", "2", "2", 0)]


def test_comment_threads_beyond_eight_hops(spark):
    comments = spark.createDataFrame([(p, i, i - 1 if i else None) for p, n in (("p", 100), ("q", 10)) for i in range(n)], "path string, id long, parent long")
    assert rows(meetings.comment_threads(comments), "path", "id", "root", "level") == sorted([(p, i, 0, i) for p, n in (("p", 100), ("q", 10)) for i in range(n)], key=repr)
    with pytest.raises(ValueError):
        meetings.comment_threads(spark.createDataFrame([("p", 1, 2), ("p", 2, 1)], "path string, id long, parent long"))


def test_reply_threads_keep_long_conversations(spark, tmp_path):
    from millrace.plans.more import reply_threads

    spark.createDataFrame([(1, i, "user", "x") for i in range(25)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(reply_threads(spark, str(tmp_path)), "conv_id", "id", "root", "level") == sorted([(1, i, 0, i) for i in range(25)], key=repr)

def test_inventory(spark):
    held = spark.createDataFrame([("r1", "a", "complete"), ("r1", "b", "partial"), ("r2", "b", "complete")], "repo string, home string, status string")
    assert rows(inventory.status_matrix(held, ["a", "b"])) == [("r1", "complete", "partial"), ("r2", None, "complete")]
    assert rows(inventory.removable(held, "b"), "repo") == [("r1",)]
    links = spark.createDataFrame([("r", "f1", "b1", 5), ("r", "f2", "b2", 5), ("r", "f3", "b3.incomplete", 5), ("r", "f4", "b4", 5)], "repo string, name string, blob string, size int")
    blobs = spark.createDataFrame([("r", "b1", 5), ("r", "b2", 4), ("r", "b9", 1)], "repo string, blob string, blob_size int")
    assert {r["blob"]: r["state"] for r in inventory.audit_links(links, blobs).collect()} == {"b1": "complete", "b2": "size_mismatch", "b3.incomplete": "incomplete", "b4": "missing_blob", "b9": "orphan_blob"}
    quants = spark.createDataFrame([("f", 3), ("f", 5), ("f", 8), ("g", 5), ("g", 8)], "family string, bits int")
    assert rows(inventory.skip_middle(quants)) == [("f", 3), ("f", 8), ("g", 5), ("g", 8)]
    listing = spark.createDataFrame([("r", "a.gguf", 10), ("r", "b.bin", 99), ("s", "c.gguf", 50)], "repo string, name string, size long")
    assert rows(inventory.select_files(listing, ["*.gguf"], ["c*"], most=20), "name") == [("a.gguf",)]
    assert [r["name"] for r in inventory.largest(listing, 2).collect()] == ["b.bin", "c.gguf"]


def test_page_tables(spark):
    grid = [(1, x * 40, y * 12, 90.0) for y in range(4) for x in range(4)]
    prose = [(2, x, 0, 50.0) for x in range(3)]
    got = {r["page"]: (r["is_table"], r["flagged"]) for r in inventory.page_tables(spark.createDataFrame(grid + prose, "page int, x int, y int, confidence double")).collect()}
    assert got == {1: (True, True), 2: (False, True)}


def test_templates(spark):
    df = spark.createDataFrame([(0, "c 1", {"name": "Ann", "b": "{{name}}"}), (1, "c 1", {"name": "Bo"})], "ord int, contract string, fields map<string,string>")
    made = templates.bulk_fill(df, "Hi {{ name }}{{b}} {x}", "contract").orderBy("ord").collect()
    assert [(r["output"], r["content"], r["missing"]) for r in made] == [("c_1.docx", "Hi Ann{{name}} {x}", []), ("c_1-2.docx", None, ["b"])]
    assert tuple(templates.bulk_report(templates.bulk_fill(df, "{{b}}", "contract")).first())[:3] == (2, 1, 1)


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string")
    assert dict(rows(sinks.import_status(new, old))) == {"a": "unchanged", "b": "updated", "c": "created", "d": "absent"}
    assert rows(sinks.changed(new, old), "path") == [("b",), ("c",)] and sinks.changed(new, new).count() == 0
    paths = spark.createDataFrame([("/x/m.raw.json",), ("/y/m.json",), ("/y/n.json",)], "path string")
    out = paths.select(sinks.output_path(F.col("path"), "/out", ".t.json", ".raw").alias("output"))
    assert rows(sinks.collisions(out)) == [("/out/m.t.json", 2)]
    sinks.write_once(new, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(new, str(tmp_path / "o"))


def test_transcript_files(spark, tmp_path):
    import json

    df = spark.createDataFrame([("/v/a.mp4", " one two\nthree \n"), ("/v/b.mp4", None), ("/v/c.mp4", " ")], "path string, text string")
    about = spark.createDataFrame([("/v/a.mp4", "T")], "path string, title string")
    sinks.write_transcript_files(df, str(tmp_path / "o"), about)
    files = list((tmp_path / "o/transcripts").glob("path=*/*.txt"))
    assert [f.read_bytes() for f in files] == [b"one two\nthree\n"]
    facts = [json.loads(x) for f in (tmp_path / "o/metadata").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((x["path"], x["transcriptWords"], x["title"]) for x in facts) == [("/v/a.mp4", 3, "T"), ("/v/b.mp4", 0, None), ("/v/c.mp4", 0, None)]
    sinks.write_discovery(about, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/discovery")).first()["title"] == "T"


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows(components(spark.createDataFrame([*edges, (None, 5)], "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_saved_services(spark):
    saved = spark.createDataFrame([('{"version":"1.0","services":[[["COM","net"],["https://one.test/"]],[["net"],["https://two.test"]]]}',)], "value string")
    assert rows(domains.read_services(saved)) == [(0, ["com", "net"], "https://one.test"), (1, ["net"], "https://two.test")]


def test_record_issues(spark):
    good = meetings.export(envelope(spark))
    assert meetings.record_issues(good).count() == 0
    bad = good.withColumns({"schema_version": F.lit(2), "title": F.lit(None).cast("string"), "transcript": F.slice("transcript", 1, 0)})
    assert rows(meetings.record_issues(bad), "location") == [("schema_version",), ("title",), ("transcript",)]


def test_transcripts_join(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    s = spark.createDataFrame([(1, 5, 2, "x", "later"), (1, 4, 1, "x", "first")], "meeting_id int, captured_at int, id int, speaker_name string, transcript string")
    got = {r["id"]: [x["transcript"] for x in r["segments"] or []] for r in meetings.with_transcripts(m, s).collect()}
    assert got == {1: ["first", "later"], 2: []}
