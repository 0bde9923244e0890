"""Presentations read a file at a time: an archive is opened once and its parts are joined where they lie, so no node leaves the task.

Rows equal those of the general operators over the tables of ``package`` (``readers.slides``, ``readers.inheritance``,
``checks.validate``), which stay for tables of nodes. A file is held whole, as its row is; its parts are parsed one by one.
"""

from __future__ import annotations

import functools
import io
import math
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .package import MAX_BYTES, MAX_ENTRIES, MAX_RATIO, REL, TYPES, A, P, R, parse

# The parts that name the slides.
PRESENTATION, PRESENTATION_RELS = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
# What a presentation must hold, and the type of a layout's relationship.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", PRESENTATION)
SLIDE_LAYOUT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slideLayout"
TITLES = ("title", "ctrTitle")
SLIDE = pa.struct([
    ("slide_number", pa.int32()), ("slide", pa.string()), ("title", pa.string()), ("texts", pa.list_(pa.string())),
    ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("notes", pa.string()), ("has_images", pa.bool_()),
])
DECK = "path string, slides array<struct<slide_number:int,slide:string,title:string,texts:array<string>,tables:array<array<array<string>>>,notes:string,has_images:boolean>>"
CHAIN = "path string, slide string, layout string, master string, theme string"
VERDICT = "path string, check string, ok boolean, details string"
#: Rows of a batch that goes back, and bytes of files after which one goes back earlier.
OUT_ROWS, OUT_BYTES = 4096, 1 << 24
#: Parts up to so many bytes are remembered, so many of each kind in a task's worker.
SMALL, REMEMBERED = 4096, 1024
# The headers of archives.
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s4B4H3I5H2I"), struct.Struct("<4s4H2IH")
_Info = namedtuple("_Info", "filename kind CRC compress_size file_size offset")

_SLIDE_PART = re.compile(r"ppt/slides/[^/]+\.xml\Z")
_TEXT_PART = re.compile(r"ppt/(?:slides|notesSlides)/[^/]+\.xml\Z")
_NAMED_SLIDE = re.compile(r"ppt/slides/slide[^/]*\.xml\Z")
_EXTENSION = re.compile(r"[^/]\.([^./]+)\Z")
# UTF-8 without a declaration, or with the plain one: a document type can then only stand there as these bytes.
_PLAIN = re.compile(rb'(?:<\?xml version=["\']1\.0["\'](?: encoding=["\'](?:UTF-8|utf-8)["\'])?(?: standalone=["\'](?:yes|no)["\'])?\s*\?>\s*)?<[A-Za-z]')


def _root(data: bytes) -> ET.Element:
    """As ``parse``, in one pass where no document type can be in the part."""
    if _PLAIN.match(data) and b"<!DOCTYPE" not in data:
        try:
            return ET.fromstring(data)
        except ET.ParseError:
            pass
    return parse(data)[0]


def _plain_infos(data: bytes) -> list[_Info] | None:
    """The directory of a plain archive: one disk, no comment, no extra fields, ASCII names. None where anything is unusual: ``zipfile`` reads it then."""
    last = len(data) - 22
    if last < 0 or data[last:last + 4] != b"PK\5\6":
        return None
    _, disk, first, here, count, length, start, said = _END.unpack_from(data, last)
    if disk or first or said or here != count or count == 0xFFFF or start + length != last or last >= 20 and data[last - 20:last - 16] == b"PK\6\7":
        return None
    infos, at = [], start
    while at < last:
        if at + 46 > last:
            return None
        sign, _, _, version, _, flags, kind, _, _, crc, packed, size, named, extra, comment, volume, _, _, offset = _CENTRAL.unpack_from(data, at)
        raw = data[at + 46:at + 46 + named]
        if sign != b"PK\1\2" or version > 63 or flags or extra or comment or volume or not named or len(raw) != named or not raw.isascii() or b"\0" in raw or 0xFFFFFFFF in (packed, size, offset):
            return None
        infos.append(_Info(raw.decode(), kind, crc, packed, size, offset))
        at += 46 + named
    return infos if at == last and len(infos) == count else None


def _plain_contents(data: bytes, infos: list[_Info], wanted: Callable[[str], bool]) -> dict[str, bytes] | None:
    """The members' bytes; None where one is not sound in every respect: ``zipfile`` names the fault then."""
    out, ends = {}, {}
    end = _END.unpack_from(data, len(data) - 22)[6]
    for info in sorted(infos, key=lambda i: i.offset, reverse=True):
        ends[info.filename], end = end, info.offset
    for info in infos:
        if info.filename.endswith("/") or not wanted(info.filename):
            continue
        at, size = info.offset, info.file_size
        if at + 30 > len(data) or info.kind not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return None
        sign, _, flags, *_, named, extra = _LOCAL.unpack_from(data, at)
        start = at + 30 + named + extra
        stop = start + info.compress_size
        if sign != b"PK\3\4" or flags or data[at + 30:at + 30 + named] != info.filename.encode() or stop > ends[info.filename]:
            return None
        content = data[start:stop]
        if info.kind == zipfile.ZIP_DEFLATED:
            try:
                content = zlib.decompressobj(-15).decompress(content, size) if size else b""
            except zlib.error:
                return None
        if len(content) != size or zlib.crc32(content) != info.CRC:
            return None
        out[info.filename] = content
    return out


def _issues(infos: list) -> tuple[list[str], list[str]]:
    """The names of an archive and the issues of the safety gate, as ``package.safety`` has them."""
    names, issues, seen, total = [], [], set(), 0
    for info in infos:
        raw = info.filename
        name = raw if raw.isascii() else raw.encode("utf-8", "replace").decode()
        names.append(name)
        if name.startswith(("/", "\\")):
            issues.append(f"absolute path: '{name}'")
        if ".." in name and ".." in name.split("/"):
            issues.append(f"path traversal: '{name}'")
        if name in seen:
            issues.append(f"duplicate entry: '{name}'")
        seen.add(name)
        if not raw.isascii() and raw.encode("utf-8", "ignore").decode() != raw:
            issues.append(f"non-UTF8 entry name: '{name}'")
        total += info.file_size
        if info.compress_size > 0 and info.file_size / info.compress_size > MAX_RATIO:
            issues.append(f"high compression ratio {math.floor(info.file_size / info.compress_size + 0.5)}x: '{name}'")
    if len(infos) > MAX_ENTRIES:
        issues.append(f"entry count {len(infos)} exceeds limit {MAX_ENTRIES}")
    if total > MAX_BYTES:
        issues.append(f"uncompressed size {total} exceeds limit {MAX_BYTES}")
    return names, issues


class _Deck:
    """An archive: its issues, and if it has none its names, the bytes of its parts and what is damaged."""

    def __init__(self, content: bytes | None, wanted: Callable[[str], bool]):
        self.names, self.data, self.damaged = [], {}, []
        content = content or b""
        if (infos := _plain_infos(content)) is not None:
            self.names, self.issues = _issues(infos)
            if self.issues:
                return
            if (data := _plain_contents(content, infos, wanted)) is not None:
                self.data = data
                return
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as problem:
            self.issues = [f"bad zip: {problem}"]
            return
        with archive:
            infos = archive.infolist()
            self.names, self.issues = _issues(infos)
            if self.issues:
                return
            for info in infos:
                if not info.is_dir() and wanted(info.filename):
                    try:
                        self.data[info.filename] = archive.read(info)
                    except Exception:  # a damaged member is named, its file goes on
                        self.damaged.append(info.filename)

    def rels(self) -> Iterator[tuple]:
        """``(source, id, type, target, mode, part)`` of all relationship parts, in the order of each."""
        for part, data in self.data.items():
            if part.endswith(".rels"):
                for row in _links(data)[0]:
                    yield part, *row, _target(part, row[2])

    def ids(self) -> tuple:
        """The relationship ids of the slides in presentation order."""
        return _ids(self.data.get(PRESENTATION, b""))[0]


def _remembered(f: Callable) -> Callable:
    """Of a part that is well formed ``(f of its tree, None)``, else ``(nothing, the error)``. Small parts are remembered: files made alike share most of them."""

    def read(data: bytes) -> tuple:
        try:
            return f(_root(data)), None
        except ET.ParseError as problem:
            return (), str(problem)

    known = functools.lru_cache(REMEMBERED)(read)
    return lambda data: known(data) if len(data) <= SMALL else read(data)


@functools.lru_cache(REMEMBERED)
def _target(source: str, target: str) -> str | None:
    """As ``package.resolve``."""
    if target.startswith("/"):
        steps = target.lstrip("/").split("/")
    else:
        base = re.sub(r"/?_rels\Z", "", source.rpartition("/")[0])
        steps = (f"{base}/{target}" if base else target).split("/")
    done: list[str] = []
    for step in steps:
        if step == "..":
            if not done:
                return None
            done.pop()
        elif step not in ("", "."):
            done.append(step)
    return "/".join(done)


@functools.lru_cache(REMEMBERED)
def _owner(source: str) -> str:
    return source.replace("_rels/", "").removesuffix(".rels")


def _by(order: int | None) -> tuple[bool, int]:
    return order is not None, order or 0


@_remembered
def _links(root: ET.Element) -> tuple:
    return tuple((x.get("Id", ""), x.get("Type", ""), x.get("Target", ""), x.get("TargetMode")) for x in root.iter(REL + "Relationship"))


@_remembered
def _ids(root: ET.Element) -> tuple:
    return tuple(x.get(R + "id") for x in root.iter(P + "sldId"))


@_remembered
def _covers(root: ET.Element) -> tuple:
    """Names and extensions that have a content type."""
    named = frozenset(x.get("PartName", "").lstrip("/") for x in root.iter(TYPES + "Override"))
    return named, frozenset(x.get("Extension", "").lower() for x in root.iter(TYPES + "Default"))


@_remembered
def _sound(root: ET.Element) -> tuple:
    return ()


_P_PR, _T, _TAB, _BREAKS = A + "pPr", A + "t", A + "tab", (A + "br", A + "cr")
_PARA, _TBL, _TR, _TC, _SP, _PH, _PIC, _BODY = A + "p", A + "tbl", A + "tr", A + "tc", P + "sp", P + "ph", P + "pic", P + "txBody"


@_remembered
def _reading(root: ET.Element) -> tuple[list[tuple], list, bool]:
    """Of a slide or its notes: ``(placeholder, text)`` of the shapes in order, the tables, and whether it has a picture."""
    paras: dict[int, tuple] = {}
    kinds: dict[int, str] = {}
    picture, number = False, 0
    stack: list[tuple] = [(root, None, False, False, None, None, None, None, None)]
    while stack:
        node, para, props, body, outer, inner, tbl, tr, tc = stack.pop()
        own, number = number, number + 1
        tag = node.tag
        if tag == _T:
            if para is not None and not props and node.text:
                paras[para][0].append(node.text)
        elif tag == _PARA:
            paras[own] = ([], body, outer, tbl, tr, tc)
            para = own
        elif tag == _TAB or tag in _BREAKS:
            if para is not None and not props:
                paras[para][0].append("\t" if tag == _TAB else "\n")
        elif tag == _P_PR:
            props = True
        elif tag == _BODY:
            body = True
        elif tag == _SP:
            outer, inner = own if outer is None else outer, own
        elif tag == _PH:
            if inner is not None:
                kinds.setdefault(inner, node.attrib.get("type", "body"))
        elif tag == _PIC:
            picture = True
        elif tag == _TBL:
            tbl = own if tbl is None else tbl
        elif tag == _TR:
            tr = own if tr is None else tr
        elif tag == _TC:
            tc = own if tc is None else tc
        if len(node):
            stack.extend([(child, para, props, body, outer, inner, tbl, tr, tc) for child in reversed(node)])
    shapes: dict[int | None, list[str]] = {}
    grids: dict = {}
    for pieces, body, outer, tbl, tr, tc in paras.values():
        if body:
            shapes.setdefault(outer, []).append("".join(pieces))
        if tc is not None:
            grids.setdefault(tbl, {}).setdefault(tr, {}).setdefault(tc, []).append("".join(pieces))
    told = [(kinds.get(sp) if sp is not None else None, "\n".join(shapes[sp]).strip(" ")) for sp in sorted(shapes, key=_by)]
    tables = [[["\n".join(row[c]).strip(" ") for c in sorted(row)] for _, row in sorted(grid.items(), key=lambda r: _by(r[0]))] for _, grid in sorted(grids.items(), key=lambda g: _by(g[0]))] if grids else []
    return told, tables, picture


def _slides(content: bytes | None) -> list[tuple]:
    deck = _Deck(content, lambda name: name == PRESENTATION or name.endswith(".rels") or bool(_TEXT_PART.match(name)))
    if not deck.ids():
        return []
    shown: dict[str, list] = {}
    spoken: dict[str | None, list] = {}
    for source, key, kind, _, _, to in deck.rels():
        if source == PRESENTATION_RELS:
            shown.setdefault(key, []).append(to)
        if kind.rpartition("/")[2] == "notesSlide":
            spoken.setdefault(_owner(source), []).append(to)
    read: dict[str, tuple] = {}

    def reading(name: str) -> tuple:
        if name not in read:
            read[name] = _reading(deck.data[name])[0] if _TEXT_PART.match(name) and name in deck.data else ()
        return read[name]

    out, number = [], 0
    for key in deck.ids():
        for slide in shown.get(key, ()):
            number += 1
            title, texts, tables, picture = None, [], [], False
            if slide is not None and (own := reading(slide)):
                told, tables, picture = own
                if slide.startswith("ppt/slides/"):
                    for kind, text in told:
                        if kind not in TITLES:
                            texts += [text] if text else []
                        elif title is None:
                            title = text
                else:
                    tables = []
            said = []
            for name in spoken.get(slide, ()) if slide is not None else ():
                if name is not None and name.startswith("ppt/notesSlides/") and (notes := reading(name)) and any(kind == "body" for kind, _ in notes[0]):
                    said.append("\n".join(text for kind, text in notes[0] if kind == "body"))
            for notes in said or [""]:
                out.append({"slide_number": number, "slide": slide, "title": title or "", "texts": texts, "tables": tables, "notes": notes, "has_images": picture})
    return [(out,)] if out else []


def _chains(content: bytes | None) -> list[tuple]:
    deck = _Deck(content, lambda name: name.endswith(".rels") or bool(_SLIDE_PART.match(name)))
    links: dict[tuple, str | None] = {}
    for source, _, kind, _, _, to in deck.rels():
        kind = kind.rpartition("/")[2]
        if kind in ("slideLayout", "slideMaster", "theme"):
            links.setdefault((kind, _owner(source)), to)
    out = []
    for slide in deck.data:
        if _SLIDE_PART.match(slide):
            layout = links.get(("slideLayout", slide))
            master = links.get(("slideMaster", layout))
            out.append((slide, layout, master, links.get(("theme", master))))
    return out


def _checks(content: bytes | None) -> list[tuple]:
    deck = _Deck(content, lambda name: True)
    found: list[tuple[str, list]] = [("zip_integrity", deck.issues + [f"corrupt entry: {name}" for name in deck.damaged])]
    if deck.names and not deck.issues:
        names = set(deck.names)
        bad = [(name, _sound(data)[1]) for name, data in deck.data.items() if name.lower().endswith((".xml", ".rels"))]
        rels = list(deck.rels())
        named, typed = _covers(deck.data.get(REQUIRED[0], b""))[0] or ((), ())
        covered = lambda name: name.endswith(("/", ".rels")) or name == REQUIRED[0] or not (ext := _EXTENSION.search(name)) or name in named or ext[1].lower() in typed
        targets = [
            f"{source}: target leaves the package: {target}" if to is None else f"{source}: no part for {target}"
            for source, _, _, target, mode, to in rels if mode != "External" and target and (to is None or to not in names)
        ]
        known: dict[str, str | None] = {}
        layouts: dict[str, tuple] = {}
        for source, key, kind, target, _, to in rels:
            if source == PRESENTATION_RELS:
                known.setdefault(key, to)
            if kind == SLIDE_LAYOUT:
                layouts.setdefault(source, (target, to))
        lost = []
        for key in deck.ids():
            if not key:
                lost.append("a slide id without a relationship id")
            elif key not in known:
                lost.append(f"slide relationship not found: {key}")
            elif known[key] not in names:
                lost.append(f"slide part not found: {'?' if known[key] is None else known[key]}")
        unlaid = []
        for slide in filter(_NAMED_SLIDE.match, deck.names):
            target, to = layouts.get(f"ppt/slides/_rels/{slide.removeprefix('ppt/slides/')}.rels", (None, None))
            if target is None:
                unlaid.append(f"{slide}: no layout relationship")
            elif to not in names:
                unlaid.append(f"{slide}: layout part not found: {target}")
        found += [
            ("required_parts", [f"missing: {name}" for name in REQUIRED if name not in names]),
            ("content_types", [f"uncovered part: {name}" for name in deck.names if not covered(name)]),
            ("relationships", targets), ("wellformed_xml", [f"{part}: {error}" for part, error in bad if error is not None]),
            ("slide_consistency", lost), ("layout_master_chain", unlaid),
        ]
    return [(check, not issues, "; ".join(sorted(set(issues))[:5])) for check, issues in found]


def _run(read: Callable[[bytes | None], list[tuple]], types: list[tuple[str, pa.DataType]]) -> Callable:
    names = ["path", *[n for n, _ in types]]

    def made(paths: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, rows, held = [], [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                new = read(data)
                rows += new
                paths += [path.as_py()] * len(new)
                held += len(data or b"")
                if rows and (len(rows) >= OUT_ROWS or held >= OUT_BYTES):
                    yield made(paths, rows)
                    paths, rows, held = [], [], 0
        if rows:
            yield made(paths, rows)

    return run


_STRING = pa.string()


def decks(files: DataFrame) -> DataFrame:
    """``(path, slides)`` of the files that pass the gate and show a slide: their slides in presentation order, with the fields of ``readers.slides``."""
    return files.select("path", "content").mapInArrow(_run(_slides, [("slides", pa.list_(SLIDE))]), DECK)


def slides(files: DataFrame) -> DataFrame:
    """The rows of ``readers.slides``."""
    return decks(files).select("path", F.inline("slides"))


def inheritance(files: DataFrame) -> DataFrame:
    """The rows of ``readers.inheritance``."""
    return files.select("path", "content").mapInArrow(_run(_chains, [(n, _STRING) for n in ("slide", "layout", "master", "theme")]), CHAIN)


def validate(files: DataFrame) -> DataFrame:
    """The rows of ``checks.validate`` for presentations."""
    return files.select("path", "content").mapInArrow(_run(_checks, [("check", _STRING), ("ok", pa.bool_()), ("details", _STRING)]), VERDICT)
