"""Small office packages made with zipfile."""

import io
import zipfile

REL = "http://schemas.openxmlformats.org/package/2006/relationships"
OFF = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PNS = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{OFF}"'
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def rels(*items):
    body = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{g}"{m}/>' for i, t, g, m in [(*x, "")[:4] for x in items])
    return f'<Relationships xmlns="{REL}">{body}</Relationships>'


def types(*overrides):
    body = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in overrides)
    return (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/x"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{body}</Types>'
    )


BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p>'
    '<w:p><w:r><w:t xml:space="preserve">Hello </w:t></w:r><w:r><w:t>all</w:t></w:r><w:r><w:tab/><w:t>x</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr>"
    "<w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>End</w:t></w:r></w:p>"
)
CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    "<dc:creator> Ann </dc:creator><dc:title>T</dc:title><cp:keywords></cp:keywords></cp:coreProperties>"
)


def word(body=BODY, **more):
    parts = {
        "[Content_Types].xml": types(("/word/document.xml", MAIN)),
        "_rels/.rels": rels(("rId1", f"{OFF}/officeDocument", "word/document.xml")),
        "word/document.xml": f"<w:document {WNS}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(),
        "docProps/core.xml": CORE,
    }
    return parts | more


def slides(**more):
    shape = lambda kind, *texts: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)}</p:txBody></p:sp>'
    slide = lambda *shapes: f"<p:sld {PNS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    grid = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    layout = ("rId1", f"{OFF}/slideLayout", "../slideLayouts/slideLayout1.xml")
    parts = {
        "[Content_Types].xml": types(),
        "_rels/.rels": rels(("rId1", f"{OFF}/officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {PNS}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", f"{OFF}/slide", "slides/slide1.xml"), ("rId2", f"{OFF}/slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape('<p:ph type="title"/>', "Last"), "<p:pic/>"),
        "ppt/slides/slide2.xml": slide(shape('<p:ph type="ctrTitle"/>', "First"), shape("", "one", "two"), grid),
        "ppt/slides/_rels/slide1.xml.rels": rels(layout),
        "ppt/slides/_rels/slide2.xml.rels": rels(layout, ("rId2", f"{OFF}/notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": f"<p:sldLayout {PNS}/>",
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {PNS}>{shape('<p:ph type=\"body\"/>', 'say it')}</p:notes>",
    }
    return parts | more


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts.items() if isinstance(parts, dict) else parts:
            if data is not None:
                archive.writestr(name, data)
    return out.getvalue()
