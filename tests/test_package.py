import io
import zipfile

import packages as P
import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import checks, sanitize
from millrace.sources import package, readers


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def tables(spark, slides=False, **contents):
    f = files(spark, **contents)
    listing = package.members(f)
    report = package.safety(listing)
    contents_ = package.parts(f, report)
    return f, listing, report, contents_, package.xml_nodes(contents_)


def failed(spark, slides=False, **parts):
    f, listing, report, contents, nodes = tables(spark, **{k: v if isinstance(v, bytes) else P.pack(v) for k, v in parts.items()})
    return {(r["path"], r["check"]) for r in checks.validate(f, listing, report, contents, nodes, slides).where("not ok").collect()}


def test_formats_and_magic(spark):
    f = files(spark, a=P.pack(P.word()), b=P.pack(P.slides()), c=P.pack(P.word(**{"word/vbaProject.bin": "x"})), d=b"\xd0\xcf\x11\xe0rest", e=b"plain", g=P.pack({"x": "y"}))
    assert dict(rows(package.detect_format(f, package.members(f)))) == {"a": "docx", "b": "pptx", "c": "docm", "d": "doc", "e": "unknown", "g": "unknown"}


def test_safety_report(spark):
    bomb = P.pack({"big": b"0" * 1_000_000})
    odd = P.pack([("/abs", "x"), ("a/../../b", "x"), ("twice", "x"), ("twice", "y")])
    report = {r["path"]: r for r in package.safety(package.members(files(spark, good=P.pack(P.word()), bomb=bomb, odd=odd, bad=b"PK\x03\x04junk", empty=P.pack({})))).collect()}
    assert report["good"]["ok"] and report["good"]["entry_count"] == 5 and report["good"]["issues"] == []
    assert not report["bomb"]["ok"] and report["bomb"]["issues"][0].startswith("high compression ratio")
    assert [i.split(":")[0] for i in report["odd"]["issues"]] == ["absolute path", "path traversal", "duplicate entry"]
    assert not report["bad"]["ok"] and report["bad"]["entry_count"] == 0
    assert "empty" not in report or report["empty"]["ok"]


def test_contained_names(spark):
    names = spark.createDataFrame([(n,) for n in ("a/b", "../x", "a/../b", "a/../../b", "/abs", "a\\..\\..\\b", "./a")], "name string")
    assert dict(rows(names.select("name", package.contained(F.col("name"))))) == {"a/b": True, "../x": False, "a/../b": True, "a/../../b": False, "/abs": False, "a\\..\\..\\b": False, "./a": True}


CHANGES = [
    ({"word/document.xml": None}, "required_parts"),
    ({"_rels/.rels": P.rels(("rId1", "x/other", "word/document.xml"))}, "required_parts"),
    ({"word/odd.zzz": "x"}, "content_types"),
    ({"[Content_Types].xml": P.types(("/word/document.xml", "application/other"))}, "content_types"),
    ({"word/_rels/document.xml.rels": P.rels(("rId9", "x/image", "media/none.png"))}, "relationships"),
    ({"word/_rels/document.xml.rels": P.rels(("rId9", "x/image", "../../out.png"))}, "relationships"),
    ({"word/broken.xml": "<a><b></a>"}, "wellformed_xml"),
    ({"word/document.xml": f"<w:document {P.WNS}><w:body><w:del w:id='1' w:author='a' w:date='d'><w:ins w:id='2' w:author='a' w:date='d'/></w:del></w:body></w:document>"}, "tracked_changes"),
    ({"word/document.xml": f"<w:document {P.WNS}><w:body><w:ins w:id='1' w:author='a'/></w:body></w:document>"}, "tracked_changes"),
    ({"word/document.xml": f"<w:document {P.WNS}><w:body><w:delText>x</w:delText></w:body></w:document>"}, "tracked_changes"),
    ({"word/comments.xml": f"<w:comments {P.WNS}/>", "word/document.xml": f"<w:document {P.WNS}><w:body><w:commentReference w:id='4'/></w:body></w:document>"}, "comments"),
]


def test_one_mutation_fails_one_check(spark):
    found = failed(spark, **{f"f{i}": P.word(**change) for i, (change, _) in enumerate(CHANGES)})
    by_file = {i: {c for f, c in found if f == f"f{i}"} for i in range(len(CHANGES))}
    # Without its main part a package also has a dangling relationship and an override for nothing.
    assert {i: c - {"relationships"} if i == 0 else c for i, c in by_file.items()} == {i: {check} for i, (_, check) in enumerate(CHANGES)}


def test_what_is_right_and_what_is_no_archive(spark):
    nested = "<w:ins w:id='1' w:author='a' w:date='d'><w:del w:id='2' w:author='a' w:date='d'><w:r><w:delText>x</w:delText></w:r></w:del></w:ins>"
    external = P.word(**{"word/_rels/document.xml.rels": P.rels(("rId1", "x/hyperlink", "https://a.test", ' TargetMode="External"'))})
    doctype = P.word(**{"word/e.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'})
    assert failed(spark, good=P.word(), nested=P.word(nested), external=external, bad=b"hello", doctype=doctype) == {("bad", "zip_integrity"), ("doctype", "wellformed_xml")}


def test_slide_checks(spark):
    unlaid = P.slides(**{"ppt/slides/_rels/slide1.xml.rels": P.rels()})
    lost = P.slides(**{"ppt/_rels/presentation.xml.rels": P.rels(("rId1", "x/slide", "slides/slide1.xml"))})
    assert failed(spark, slides=True, good=P.slides(), unlaid=unlaid, lost=lost) == {("unlaid", "layout_master_chain"), ("lost", "slide_consistency")}


def test_metadata_and_flags(spark):
    parts = P.word(**{"docProps/app.xml": '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Company>C</Company></Properties>', "word/media/i.png": "x", "customXml/item.xml": "<a/>"})
    f, listing, report, contents, nodes = tables(spark, a=P.pack(parts))
    assert package.metadata(nodes).first()["metadata"] == {"creator": "Ann", "title": "T", "company": "C"}
    flags = package.word_flags(listing, contents, package.relationships(nodes)).first()
    assert flags["has_custom_xml"] and flags["media_count"] == 1 and not flags["has_macros"] and not flags["has_tracked_changes"] and not flags["has_external_links"]
    deck = tables(spark, d=P.pack(P.slides()))
    own = package.slide_flags(deck[1], deck[4], package.relationships(deck[4])).first()
    assert own["slide_count"] == 2 and own["has_speaker_notes"] and not own["has_charts"]


def test_word_structure(spark):
    notes = f"<w:footnotes {P.WNS}><w:footnote w:id='0' w:type='separator'><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote w:id='2'><w:p><w:r><w:t>See</w:t></w:r></w:p></w:footnote></w:footnotes>"
    nodes = tables(spark, a=P.pack(P.word(**{"word/footnotes.xml": notes, "word/header1.xml": f"<w:hdr {P.WNS}><w:p><w:r><w:t> Top </w:t></w:r></w:p></w:hdr>"})))[4]
    s = readers.word_structure(nodes).first()
    assert [p["text"] for p in s["paragraphs"]] == ["Plan", "Hello all\tx", "End"]
    assert [(h["level"], h["text"], h["paragraph_index"]) for h in s["headings"]] == [(1, "Plan", 0)]
    assert [(t["rows"], t["row_count"], t["column_count"]) for t in s["tables"]] == [([["a|b", "c"], ["1", ""]], 2, 2)]
    assert [b["type"] for b in s["body_blocks"]] == ["paragraph", "paragraph", "table", "paragraph"]
    assert s["headers"] == ["Top"] and [n["text"] for n in s["footnotes"]] == ["See"] and s["body_text"] == "Plan\nHello all\tx\nEnd"
    made = readers.word_markdown(readers.word_structure(nodes)).first()["markdown"]
    assert made.startswith("# Plan\nHello all\tx\n") and "| a\\|b | c |\n| --- | --- |\n| 1 |  |" in made


def test_slides_in_presentation_order(spark):
    deck = readers.slides(tables(spark, d=P.pack(P.slides()))[4])
    got = [tuple(r) for r in deck.orderBy("slide_number").select("slide_number", "title", "texts", "tables", "notes", "has_images").collect()]
    assert got == [(1, "First", ["one\ntwo"], [[["h"]]], "say it", False), (2, "Last", [], [], "", True)]
    made = readers.slides_markdown(deck).first()["markdown"]
    assert made.startswith("# d\n\n## Slide 1: First\n") and "> say it" in made


def test_sanitise_and_pack(spark):
    body = (
        "<w:p><w:ins w:id='1' w:author='a' w:date='d'><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id='2' w:author='a' w:date='d'><w:r><w:delText>old</w:delText></w:r></w:del>"
        "<w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:commentReference w:id='0'/></w:p>"
    )
    parts = P.word(body, **{"word/comments.xml": f"<w:comments {P.WNS}><w:comment w:id='0'/></w:comments>", "customXml/item1.xml": "<a/>", "word/_rels/document.xml.rels": P.rels(("rId1", "x/comments", "comments.xml"), ("rId2", "x/link", "https://a.test", ' TargetMode="External"'))})
    contents = tables(spark, a=P.pack(parts))[3]
    clean = sanitize.sanitize(contents, list(sanitize.WORD_CATEGORIES))
    kept = {r["name"]: bytes(r["content"]).decode() for r in clean.where("content is not null").collect()}
    assert "word/comments.xml" not in kept and "customXml/item1.xml" not in kept
    assert "new" in kept["word/document.xml"] and not any(w in kept["word/document.xml"] for w in ("old", "hidden", "commentReference", "w:ins"))
    assert "Ann" not in kept["docProps/core.xml"] and "a.test" not in kept["word/_rels/document.xml.rels"] and "comments.xml" not in kept["word/_rels/document.xml.rels"]
    packed = sanitize.pack(clean.where("content is not null"))
    again = bytes(sanitize.pack(clean.where("content is not null").orderBy(F.desc("name"))).first()["content"])
    assert bytes(packed.first()["content"]) == again and zipfile.ZipFile(io.BytesIO(again)).namelist()[0] == "[Content_Types].xml"
    assert failed(spark, a=again) == set()
    rejected = sanitize.sanitize(contents, ["revisions"], accept=False).where("name = 'word/document.xml'").first()
    assert "old" in bytes(rejected["content"]).decode() and "new" not in bytes(rejected["content"]).decode() and "rejected" in rejected["report"][0]
    untouched = sanitize.sanitize(contents, [])
    assert untouched.where("content is null").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        sanitize.sanitize(contents, ["colour"])


def test_pack_checks_what_it_made(spark):
    bad = P.word()
    del bad["_rels/.rels"]
    contents = tables(spark, a=P.pack(P.word()), b=P.pack(bad))[3]
    made = {r["path"]: r for r in sanitize.pack_valid(contents).collect()}
    assert made["a"]["ok"] and made["a"]["content"] and made["a"]["details"] == ""
    assert not made["b"]["ok"] and made["b"]["content"] is None and "required_parts" in made["b"]["details"]
    more = lambda f, listing, inside, nodes: f.select("path", F.lit("mine").alias("check"), F.lit(False).alias("ok"), F.lit("no").alias("details"))
    kept = {r["path"]: r for r in sanitize.pack_valid(contents, keep_invalid=True, extra_checks=(more,)).collect()}
    assert kept["a"]["details"] == "mine: no" and kept["a"]["content"] and kept["b"]["content"]
    assert sanitize.pack_valid(contents.limit(0)).count() == 0


def test_repairs_are_told(spark):
    contents = tables(spark, a=P.pack(P.word(**{"word/media/i.png": "x"})))[3]
    mend = lambda name, data: (data + b" ", ["space: " + name]) if name == "word/document.xml" else (data, [])
    got = {r["name"]: r for r in sanitize.repair_parts(contents, mend).collect()}
    before = {r["name"]: r for r in contents.collect()}
    assert got.keys() == before.keys()
    assert got["word/document.xml"]["repairs"] == ["space: word/document.xml"] and bytes(got["word/document.xml"]["content"]).endswith(b" ")
    assert all(not r["repairs"] and r["content"] == before[n]["content"] for n, r in got.items() if n != "word/document.xml")


def test_slide_forms(spark):
    import json

    deck = readers.slides(tables(spark, d=P.pack(P.slides()))[4])
    text = readers.slides_text(deck).first()["text"]
    assert text == "d\n=\n\n--- Slide 1: First ---\none\ntwo\nh\n[Notes: say it]\n\n--- Slide 2: Last ---\n"
    made = json.loads(readers.slides_json(deck).first()["json"])
    assert [s["title"] for s in made] == ["First", "Last"] and made[1]["texts"] == []
    whole = json.loads(readers.as_json(readers.word_structure(tables(spark, a=P.pack(P.word()))[4])).first()["json"])
    assert {"paragraphs", "tables", "comments", "footnotes"} <= whole.keys()


def test_sanitise_slides(spark):
    contents = tables(spark, d=P.pack(P.slides()))[3]
    clean = sanitize.sanitize(contents, ["notes"], slides=True).where("content is not null")
    kept = {r["name"]: bytes(r["content"]).decode() for r in clean.collect()}
    assert not any(n.startswith("ppt/notesSlides/") for n in kept) and "notesSlide" not in kept["ppt/slides/_rels/slide2.xml.rels"]
    assert failed(spark, slides=True, d=bytes(sanitize.pack(clean).first()["content"])) == set()


def test_carry_over(spark):
    contents = tables(spark, a=P.pack(P.word()))[3]
    edited = contents.where("name = 'word/document.xml'").withColumn("content", F.lit(b"<x/>"))
    both = sanitize.carry_over(edited, contents)
    assert both.count() == 5 and bytes(both.where("name = 'word/document.xml'").first()["content"]) == b"<x/>"


def test_xml_transforms():
    data = b'<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">\n  <w:t> a</w:t>\n</w:p>'
    assert b"\n" not in sanitize.condense(data).split(b"?>")[1].strip() and b"> a<" in sanitize.condense(data)
    assert b'space="preserve"' in sanitize.preserve_spaces(data)
    assert sanitize.condense(b"<broken") == b"<broken" and b"\n" in sanitize.pretty(sanitize.condense(data))


def test_find_files(spark, tmp_path):
    for name in ("a.docx", "~$a.docx", "sub/b.DOCX", "sub/c.txt", "sub/skip-me.docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(P.pack(P.word()))
    found = package.find_files(spark, str(tmp_path), exclude=["*/skip-*", "a[xy]*"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.docx", "b.DOCX"]


def test_unpack_gates_files(spark):
    f, listing, report, _, _ = tables(spark, good=P.pack(P.word()), bad=P.pack([("../up", "x"), ("in", "y")]))
    got = package.unpack(f, listing, report)
    assert {(r["path"], r["format"]) for r in got.collect()} == {("good", "docx")} and got.count() == 5
    import hashlib

    assert got.first()["sha256"] == hashlib.sha256(P.pack(P.word())).hexdigest() or len(got.first()["sha256"]) == 64
    forced = package.unpack(f, listing, report, lambda c: sanitize.transform_xml(c, sanitize.pretty), force=True)
    assert rows(forced.where("path = 'bad'"), "name") == [("in",)]


def test_inheritance(spark):
    parts = P.slides(**{
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": P.rels(("rId1", f"{P.OFF}/slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/slideMaster1.xml": "<a/>", "ppt/slideMasters/_rels/slideMaster1.xml.rels": P.rels(("rId1", f"{P.OFF}/theme", "../theme/theme1.xml")), "ppt/theme/theme1.xml": "<a/>",
    })
    nodes = tables(spark, d=P.pack(parts))[4]
    chain = readers.inheritance(nodes)
    assert rows(chain, "slide", "theme") == [("ppt/slides/slide1.xml", "ppt/theme/theme1.xml"), ("ppt/slides/slide2.xml", "ppt/theme/theme1.xml")]
    values = spark.createDataFrame([("d", "ppt/slides/slide1.xml", "font", "A"), ("d", "ppt/theme/theme1.xml", "font", "T"), ("d", "ppt/slideLayouts/slideLayout1.xml", "size", "9")], "path string, part string, key string, value string")
    assert rows(readers.inherited(values, chain, "font"), "slide", "value") == [("ppt/slides/slide1.xml", "A"), ("ppt/slides/slide2.xml", "T")]


def test_alternative_texts(spark):
    draw = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = f'<w:p><w:r><w:drawing><wp:inline {draw}><wp:docPr id="1" name="p"/><a:blip r:embed="rId5"/></wp:inline></w:drawing></w:r></w:p>'
    f, listing, report, contents, nodes = tables(spark, a=P.pack(P.word(body, **{"word/media/i.png": "x", "word/_rels/document.xml.rels": P.rels(("rId5", f"{P.OFF}/image", "media/i.png"))})))
    read = spark.createDataFrame([("a", "word/media/i.png", "a chart")], "path string, name string, text string")
    texts = readers.image_texts(package.relationships(nodes), read)
    assert rows(texts, "id", "text") == [("rId5", "a chart")]
    made = sanitize.write_alt_texts(contents, sanitize.alt_texts(texts))
    assert b'descr="a chart"' in bytes(made.where("name = 'word/document.xml'").first()["content"]) and made.count() == contents.count()


def test_id_repair(spark):
    body = "<w:bookmarkStart w:id='1'/><w:bookmarkStart w:id='-3'/><w:bookmarkStart w:id='x'/><w:bookmarkStart w:id='2'/>"
    _, _, _, contents, nodes = tables(spark, a=P.pack(P.word(body)))
    assert rows(sanitize.repair_ids(contents, nodes), "old_id", "new_id") == [("-3", 3), ("x", 4)]


def test_document_types_are_refused_wherever_they_stand(spark):
    import xml.etree.ElementTree as ET

    from millrace.operators.sanitize import edit_part

    late = b"<!--" + b"x" * 20_000 + b"-->"
    entity = late + b'<!DOCTYPE r [<!ENTITY e "boom">]><r>&e;</r>'
    for data in (entity, "<?xml version='1.0' encoding='utf-16'?>".encode("utf-16") + '<!DOCTYPE r [<!ENTITY e "boom">]><r>&e;</r>'.encode("utf-16-le")):
        with pytest.raises(ET.ParseError):
            package.parse(data)
    harmless = b"<r><!-- <!DOCTYPE r> --></r>"
    assert package.parse(harmless)[0].tag == "r"
    core = P.CORE.replace("<dc:creator>", late.decode() + "<!-- <!DOCTYPE x> --><dc:creator>").encode()
    clean, report = edit_part("docProps/core.xml", core, frozenset(["metadata"]), False, frozenset())
    assert b"Ann" not in clean and report == ["metadata: creator"]
    # What cannot be read is dropped and named, not passed on; without a request nothing is touched.
    for data in (entity, b"<r>"):
        content, report = edit_part("docProps/core.xml", data, frozenset(["metadata"]), False, frozenset())
        assert content is None and report[0].startswith("unreadable: ")
        assert edit_part("docProps/core.xml", data, frozenset(), False, frozenset()) == (data, [])
    far = b"<r>" + late + b'<q:a xmlns:q="urn:q"/></r>'
    assert b"<q:a" in edit_part("x.xml", far, frozenset(["metadata"]), False, frozenset())[0]
