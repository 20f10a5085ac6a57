"""Zip packages of XML parts as tables: parts, relationships, slides and shapes."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMU_PER_INCH = 914400
PARTS = "deck string, part string, body binary"
RELS = "deck string, src_part string, rid string, target string, type string"
SHAPES = (
    "deck string, part string, shape_id string, parent_id string, z int, type string, name string, x double, y double, w double, h double, text string, "
    "turn double, flip_h boolean, flip_v boolean, placeholder boolean, ph_type string, ph_idx string, path array<string>"
)


def read_packages(spark, path: str | list[str]) -> DataFrame:
    """deck, body of each package file under a path, or of the files of a list."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("deck"), F.col("content").alias("body"))


def parts(packages: DataFrame, wanted: str = "") -> DataFrame:
    """One row for each member whose name matches `wanted`; members that do not are never inflated."""
    pattern = re.compile(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deck, body in zip(batch.column("deck").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(body or b"")) as z:
                        rows = [(deck, n, z.read(n)) for n in z.namelist() if pattern.search(n)]
                except zipfile.BadZipFile:
                    rows = [(deck, None, None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["deck", "part", "body"])

    return packages.select("deck", "body").mapInArrow(run, PARTS)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _rels(deck: str, part: str, body: bytes) -> list[tuple]:
    folder, _, name = part.rpartition("/_rels/")
    source = f"{folder}/{name.removesuffix('.rels')}".lstrip("/")
    out = []
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return out
    for e in root:
        target = e.get("Target", "")
        if not re.match(r"[a-z]+:", target) and e.get("TargetMode") != "External":
            target = posixpath.normpath(posixpath.join(posixpath.dirname(source), target)).lstrip("/")
        out.append((deck, source, e.get("Id"), target, e.get("Type", "").rpartition("/")[2]))
    return out


def rows_of(df: DataFrame, fn, schema: str) -> DataFrame:
    """The rows that fn(deck, part, body) gives for each part that was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for d, p, b in zip(*(batch.column(c).to_pylist() for c in ("deck", "part", "body")), strict=True) if b is not None for r in fn(d, p, b)]
            if rows:
                names = [f.split()[0] for f in schema.split(", ")]
                kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    return df.select("deck", "part", "body").mapInArrow(run, schema)


def relationships(all_parts: DataFrame) -> DataFrame:
    return rows_of(all_parts.where("part like '%/_rels/%.rels' or part like '_rels/%.rels'"), _rels, RELS)


def slide_parts(all_parts: DataFrame) -> DataFrame:
    """deck, part, slide_no by the number in the name; ordinals follow from it."""
    name = r"^ppt/slides/slide(\d+)\.xml$"
    return all_parts.where(F.col("part").rlike(name)).select("deck", "part", F.regexp_extract("part", name, 1).cast("int").alias("slide_no"), "body")


class Frame(NamedTuple):
    """A box in EMU, the child space of a group, and the turn (degrees) and flips on the way to it."""

    x: float
    y: float
    w: float
    h: float
    cx: float = 0
    cy: float = 0
    cw: float = 0
    ch: float = 0
    turn: float = 0
    flip_h: bool = False
    flip_v: bool = False

    def hold(self, own: Frame) -> Frame:
        """own, a box in this frame's child space, on the slide.

        The centre is mapped; a box at a quarter turn takes the other axis's scale.
        """
        sx, sy = self.w / self.cw if self.cw else 1.0, self.h / self.ch if self.ch else 1.0
        quarter = abs(own.turn % 180 - 90) < 0.5
        w, h = (own.w * sy, own.h * sx) if quarter else (own.w * sx, own.h * sy)
        x = self.x + (own.x + own.w / 2 - self.cx) * sx - w / 2
        y = self.y + (own.y + own.h / 2 - self.cy) * sy - h / 2
        return own._replace(x=x, y=y, w=w, h=h, turn=self.turn + own.turn, flip_h=self.flip_h or own.flip_h, flip_v=self.flip_v or own.flip_v)


def child(e, *names):
    """The element down a path of local names, or None."""
    for name in names:
        e = next((x for x in e if local(x.tag) == name), None) if e is not None else None
    return e


def frame_of(e) -> Frame | None:
    """The frame of a shape element, None without a position of its own."""
    kind = local(e.tag)
    xfrm = child(e, "xfrm") if kind == "graphicFrame" else child(e, "grpSpPr" if kind == "grpSp" else "spPr", "xfrm")
    if xfrm is None:
        return None

    def pair(name, first, second):
        x = child(xfrm, name)
        return (float(x.get(first, 0)), float(x.get(second, 0))) if x is not None else None

    off, ext = pair("off", "x", "y"), pair("ext", "cx", "cy")
    if off is None or ext is None:
        return None
    inner, space = pair("chOff", "x", "y") or (0.0, 0.0), pair("chExt", "cx", "cy") or ext
    on = lambda name: xfrm.get(name) in ("1", "true")
    return Frame(*off, *ext, *inner, *space, int(xfrm.get("rot") or 0) / 60000, on("flipH"), on("flipV"))


class Node(NamedTuple):
    element: ET.Element
    kind: str
    shape_id: str | None
    name: str | None
    parent_id: str | None
    path: tuple[str, ...]  # ids of the groups around it, outermost first
    z: int
    frame: Frame | None


def nodes(body: bytes) -> list[Node]:
    """The shape tree of a slide, layout or master; a group is numbered after its children. Empty if it does not parse."""
    out: list[Node] = []
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return out

    def walk(e, path, outer):
        for c in e:
            kind = local(c.tag)
            if kind == "AlternateContent":
                inner = child(c, "Choice")
                inner = inner if inner is not None else child(c, "Fallback")
                if inner is not None:
                    walk(inner, path, outer)
                continue
            if kind not in ("sp", "pic", "cxnSp", "graphicFrame", "grpSp"):
                continue
            head = next((x for x in c.iter() if local(x.tag) == "cNvPr"), None)
            sid, name = (head.get("id"), head.get("name")) if head is not None else (None, None)
            own = frame_of(c)
            own = outer.hold(own) if own is not None and outer is not None else own
            if kind == "grpSp":
                walk(c, (*path, sid), own or outer)
            out.append(Node(c, kind, sid, name, path[-1] if path else None, path, len(out), own))

    tree = child(root, "cSld", "spTree")
    if tree is not None:
        walk(tree, (), None)
    return out


def text_of(e) -> str:
    """Paragraphs of an element, a line each."""
    return "\n".join("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in e.iter() if local(p.tag) == "p")


def _shapes(deck: str, part: str, body: bytes) -> list[tuple]:
    """Flat rows of the shape tree."""
    out = []
    for n in nodes(body):
        inch = lambda v: None if v is None else round(v / EMU_PER_INCH, 3)
        box = tuple(map(inch, n.frame[:4])) if n.frame else (None,) * 4
        turn = (n.frame.turn, n.frame.flip_h, n.frame.flip_v) if n.frame else (None,) * 3
        ph = child(n.element, "nvSpPr", "nvPr", "ph")
        key = (ph.get("type"), ph.get("idx")) if ph is not None else (None, None)
        text = None if n.kind == "grpSp" else text_of(n.element) or None
        out.append((deck, part, n.shape_id, n.parent_id, n.z, n.kind, n.name, *box, text, *turn, ph is not None, *key, list(n.path)))
    return out


def shapes(slides: DataFrame) -> DataFrame:
    return rows_of(slides, _shapes, SHAPES)


def slide_digests(slides: DataFrame) -> DataFrame:
    """deck, part, digest: SHA-256 of the canonical XML, or of the raw bytes where it does not parse."""
    def run(deck, part, body):
        import hashlib

        try:
            raw = ET.canonicalize(body.decode()).encode()
        except (ET.ParseError, UnicodeDecodeError):
            raw = body
        return [(deck, part, hashlib.sha256(raw).hexdigest())]

    return rows_of(slides, run, "deck string, part string, digest string")


def write_package(rows: list[tuple[str, bytes]]) -> bytes:
    """A zip package with these parts, content types first; the same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in sorted(rows, key=lambda r: (r[0] != "[Content_Types].xml", not r[0].startswith("_rels/"), r[0])):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()
