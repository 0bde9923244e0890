"""Presentations read a file at a time, against the operators over tables of members, parts and nodes."""

import io
import zipfile

import packages as P
import pytest
from conftest import rows

from millrace.operators import checks, sanitize
from millrace.plans import proofs
from millrace.plans.queries import QUERIES
from millrace.sources import decks, package, readers

SF = "/root/testdata/sf0.001"


def _shape(kind, *texts, body="p"):
    return f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><{body}:txBody>{"".join(f"<a:p>{t}</a:p>" for t in texts)}</{body}:txBody></p:sp>'


def _run(text):
    return f"<a:r><a:t>{text}</a:t></a:r>"


def _cell(*texts):
    return "<a:tc><a:txBody>" + "".join(f"<a:p>{_run(t)}</a:p>" for t in texts) + "</a:txBody></a:tc>"


def _odd_files():
    title, sub = '<p:ph type="title"/>', '<p:ph type="subTitle"/>'
    grid = f"<a:tbl><a:tr>{_cell('a ', 'b')}{_cell(' c')}</a:tr><a:tr>{_cell('')}<a:tc/></a:tr></a:tbl>"
    nested = f"<a:tbl><a:tr><a:tc><a:txBody><a:p>{_run('out')}</a:p></a:txBody>{grid}</a:tc></a:tr></a:tbl>"
    tree = lambda inner: f"<p:sld {P.PNS}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    rich = tree(
        _shape("", "<a:pPr><a:tab/></a:pPr>" + _run(" spaced ") + "<a:br/>" + _run("second") + "<a:tab/>" + "<a:r><a:t/></a:r>", _run("more")) + _shape(title, _run("T1")) + _shape(title, _run("T2"))
        + _shape(sub, "") + f"<p:grpSp>{_shape('', _run('in group') + '<a:p>' + _run('inner') + '</a:p>')}<p:pic/></p:grpSp>" + f"<p:txBody><a:p>{_run('no shape')}</a:p></p:txBody>"
        + f"<p:sp><p:sp><p:nvPr><p:ph/></p:nvPr></p:sp><p:txBody><a:p>{_run('twice in shapes')}</a:p></p:txBody></p:sp><p:graphicFrame>{grid}{nested}</p:graphicFrame>" + _cell("loose")
    )
    shown = lambda *ids: f'<p:presentation {P.PNS}><p:sldIdLst>{"".join(f"<p:sldId {i}/>" for i in ids)}</p:sldIdLst></p:presentation>'
    name, rel = "ppt/_rels/presentation.xml.rels", "ppt/slides/_rels/slide2.xml.rels"
    layout = ("rId1", f"{P.OFF}/slideLayout", "/ppt/slideLayouts/slideLayout1.xml")
    notes = lambda k, n: (f"rId{k}", f"{P.OFF}/notesSlide", f"../notesSlides/notesSlide{n}.xml")
    said = lambda text: f"<p:notes {P.PNS}>{_shape('<p:ph/>', _run(text), _run('end'))}{_shape('<p:ph type=\"sldImg\"/>', _run('no'))}{_shape('<p:ph type=\"body\"/>', _run('b'))}</p:notes>"
    good = P.pack(P.slides())
    whole = {
        "good": P.slides(),
        "rich": P.slides(**{"ppt/slides/slide2.xml": rich, "ppt/notesSlides/notesSlide1.xml": said(" hear ")}),
        "marked": P.slides(**{"ppt/slides/slide2.xml": "<?xml version=\"1.0\" encoding=\"UTF-8\" standalone=\"yes\"?>\r\n" + rich, "ppt/slides/slide1.xml": tree(_shape(title, _run("é"))).encode("utf-16")}),
        "typed": P.slides(**{"ppt/slides/slide1.xml": "<!DOCTYPE a><a/>", "ppt/slides/slide2.xml": "<!DOCTYPE a>".encode("utf-16") + "<a/>".encode("utf-16-le")}),
        "torn": P.slides(**{"ppt/slides/slide1.xml": "<p:sld>", "ppt/slides/slide2.xml": "", "ppt/notesSlides/notesSlide1.xml": "<a"}),
        "bare": P.slides(**{"ppt/presentation.xml": None}), "shapeless": P.slides(**{"ppt/presentation.xml": "<p:presentation>"}), "unrelated": P.slides(**{name: "<Relationships"}),
        "untyped": P.slides(**{"[Content_Types].xml": None}), "mistyped": P.slides(**{"[Content_Types].xml": "<Types", "a.b/c": "x", "odd.ZZZ": "x", "plain": "x", "x/.xml": "<a/>"}),
        "covered": P.slides(**{"[Content_Types].xml": P.types(("/odd.zzz", "x")).replace('Extension="png"', 'Extension="BIN"'), "odd.zzz": "x", "more.Bin": "x", "one.png": "x"}),
        "ids": P.slides(**{"ppt/presentation.xml": shown('id="1"', 'r:id=""', 'r:id="rId2"', 'r:id="rId2"', 'r:id="rId1"', 'r:id="rId9"', 'r:id="up"', 'r:id="gone"', 'r:id="note"'), name: P.rels(("rId1", f"{P.OFF}/slide", "slides/slide1.xml"), ("rId2", f"{P.OFF}/slide", "/ppt/./slides//slide2.xml"), ("up", f"{P.OFF}/slide", "../../slides/slide2.xml"), ("gone", f"{P.OFF}/slide", "slides/slide8.xml"), ("note", f"{P.OFF}/notesSlide", "notesSlides/notesSlide1.xml"))}),
        "links": P.slides(**{"ppt/slides/_rels/slide1.xml.rels": P.rels(("a", f"{P.OFF}/slideLayout", "../../../x"), ("b", f"{P.OFF}/slideLayout", "../y.xml"), ("c", f"{P.OFF}/image", "http://x", ' TargetMode="External"'), ("d", f"{P.OFF}/image", ""), ("e", f"{P.OFF}/image", "../media/lost.png"))}),
        "noted": P.slides(**{rel: P.rels(layout, notes(2, 1), notes(3, 8)), "ppt/notesSlides/notesSlide8.xml": f"<p:notes {P.PNS}/>"}),
        "themed": P.slides(**{"ppt/slideLayouts/_rels/slideLayout1.xml.rels": P.rels(("r", f"{P.OFF}/slideMaster", "../slideMasters/m.xml")), "ppt/slideMasters/_rels/m.xml.rels": P.rels(("t", "x/theme", "../theme/theme1.xml"))}),
        "upper": {k.replace("slide1.xml", "slide1.XML"): v for k, v in P.slides().items()}, "bom": P.slides(**{"ppt/slides/slide2.xml": b"\xef\xbb\xbf" + rich.encode()}),
        "folder": P.slides(**{"ppt/slides/": "", "ppt/slides/slide3.xml": tree(""), "ppt/slides/other.xml": tree("")}), "named": P.slides(**{"ppt/media/é.png": "x", "ppt/media/名.odd": "x"}),
        "climbs": P.slides(**{"../x.xml": "<a/>", "/y.xml": "<a/>", "\\z.xml": "<a/>"}), "bomb": P.slides(**{"ppt/media/a.png": "0" * 400_000}), "nothing": {}, "single": {"x": "y"},
    }
    out = {k: P.pack(v) for k, v in whole.items()}
    with pytest.warns(UserWarning):
        out["copies"] = P.pack([*P.slides().items(), ("ppt/slides/slide1.xml", "<a/>"), ("ppt/slides/slide1.xml", "<b/>")])
    at = good.find(b"ppt/slides/slide2.xml") + len("ppt/slides/slide2.xml")
    out["flipped"] = good[:at + 8] + bytes([good[at + 8] ^ 255]) + good[at + 9:]
    lied = good.find(b"ppt/slides/slide1.xml")
    out["renamed"] = good[:lied] + b"ppt/slides/slideX.xml" + good[lied + 21:]
    out["cut"], out["none"], out["empty"], out["text"], out["before"], out["after"] = good[:-30], None, b"", b"not an archive", b"#!/bin/sh\n" + good, good + b"tail"
    more = io.BytesIO()
    with zipfile.ZipFile(more, "w", zipfile.ZIP_BZIP2) as archive:
        archive.comment = b"said"
        for part, data in P.slides().items():
            archive.writestr(part, data)
    out["squeezed"] = more.getvalue()
    out["stored"] = sanitize._archive([(k, v.encode()) for k, v in P.slides(**{"ppt/slides/slide2.xml": rich}).items()], zipfile.ZIP_STORED)
    return out


@pytest.fixture(scope="module")
def odd(spark):
    files = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in _odd_files().items()], "path string, content binary").cache()
    listing = package.members(files).cache()
    report = package.safety(listing).cache()
    contents = package.parts(files, report).cache()
    return files, listing, report, contents, package.xml_nodes(contents).cache()


def test_checks_of_odd_files(odd):
    want = rows(checks.validate(*odd, slides=True))
    got = rows(decks.validate(odd[0]))
    assert got == want
    assert {r[0] for r in got if r[1:3] == ("zip_integrity", False)} >= {"flipped", "cut", "none", "copies", "climbs", "bomb", "renamed"}


def test_chains_of_odd_files(odd):
    assert rows(decks.inheritance(odd[0])) == rows(readers.inheritance(odd[4]))


def test_slides_of_odd_files(odd):
    assert rows(decks.slides(odd[0])) == rows(readers.slides(odd[4]))


def test_forms_of_odd_files(odd):
    deck = readers.slides(odd[4]).cache()
    want = readers.slides_text(deck).join(readers.slides_json(deck), "path")
    assert rows(readers.deck_forms(decks.decks(odd[0]))) == rows(want)


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archives_have_the_bytes_of_zipfile(kind):
    for parts in (P.slides(), {}, {"a": ""}, {"é": "x"}, {"a/": ""}, {"[Content_Types].xml": "x", "A": "y" * 70_000}):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", kind) as archive:
            for name, data in sorted(parts.items(), key=lambda r: (r[0] != "[Content_Types].xml", r[0])):
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, kind)
        assert sanitize._archive([(k, v.encode()) for k, v in parts.items()], kind) == out.getvalue()


def test_rows_are_packed_like_tables(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([("a", [("x", b"1"), ("[Content_Types].xml", b"2"), ("y", None)]), ("b", [("z", None)]), ("c", None), ("d", [("w", b"")]), (None, [("w", b"3")])], "path string, parts array<struct<name:string,content:binary>>")
    assert rows(sanitize.pack_rows(table)) == rows(sanitize.pack(table.select("path", F.inline("parts"))))


@pytest.mark.parametrize("name", ["deck_chains", "deck_checks", "deck_slides", "deck_texts"])
def test_no_node_or_part_is_shuffled_or_kept(spark, name, monkeypatch):
    """Of the packages nothing is written or shuffled: the one exchange deals out the rows of the table, before they grow."""
    monkeypatch.setattr(proofs, "cut", lambda df: pytest.fail("kept between steps"))
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
