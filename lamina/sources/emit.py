"""Decks as drawing operations, and back: a table with a row for each shape, from which slides are written.

draw_ops() takes the place of generated source code: rows can be joined, filtered, renumbered and edited as any table,
and slide_parts_of() and write_packages() make packages of them. Placement, text with fonts, solid fills, lines, presets, tables,
connector ends, pictures and placeholders go through; what has no field here (effects, gradients, charts) is left out, and
left_out() says which shapes that concerns.
"""

from __future__ import annotations

import hashlib
import json
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.keys import braced, reply_id, thread_id, uuid5
from lamina.sources.deck import FONT, font_of
from lamina.sources.package import PARTS, Node, child, local, nodes, rows_of, slide_parts, write_package
from lamina.sources.styles import color_of, effects_of, fill_of, geometry_of, line_of

OPS = "deck string, slide_no int, seq int, op string, shape_id string, parent_id string, args string"
NAMES = {"sp": "add_shape", "pic": "add_picture", "cxnSp": "add_connector", "graphicFrame": "add_table", "grpSp": "add_group"}
# The name spaces of the format.
SPACES = {
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _xfrm(n: Node) -> dict | None:
    """The box as it stands in the file, in the child space of the group around it."""
    where = child(n.element, "xfrm") if n.kind == "graphicFrame" else child(n.element, "grpSpPr" if n.kind == "grpSp" else "spPr", "xfrm")
    if where is None:
        return None
    out = {local(x.tag): {k: int(v) for k, v in x.attrib.items()} for x in where}
    return out | {k: v for k, v in where.attrib.items() if v not in ("0", "false")}


def _text(e) -> list[dict] | None:
    if e is None:
        return None
    out = []
    for p in e:
        if local(p.tag) != "p":
            continue
        props, runs = child(p, "pPr"), []
        for r in p:
            if local(r.tag) == "br":
                runs.append({"text": "\n"})
            elif local(r.tag) in ("r", "fld"):
                font = {k: v for k, v in zip(FONT, font_of(child(r, "rPr")), strict=True) if v is not None}
                runs.append({"text": "".join(t.text or "" for t in r if local(t.tag) == "t")} | font)
        out.append({"level": int(props.get("lvl") or 0) if props is not None else 0, "align": props.get("algn") if props is not None else None, "runs": runs})
    return out


def _args(n: Node) -> dict:
    e = n.element
    props, ph = child(e, "spPr"), child(e, "nvSpPr", "nvPr", "ph")
    fill, line, shape = fill_of(props), line_of(child(props, "ln") if props is not None else None), geometry_of(props)
    args = {
        "name": n.name, "box": _xfrm(n), "placeholder": dict(ph.attrib) if ph is not None else None, "text": _text(child(e, "txBody")),
        "preset": shape["preset"] if shape else None, "fill": fill if fill and fill["kind"] in ("solid", "none") else None,
        "line": {k: line[k] for k in ("width", "none", "color")} if line else None}
    if n.kind == "pic":
        head, blip = child(e, "nvPicPr", "cNvPr"), child(e, "blipFill", "blip")
        crop = child(e, "blipFill", "srcRect")
        args |= {"descr": head.get("descr") if head is not None else None, "rid": next((v for k, v in blip.attrib.items() if local(k) == "embed"), None) if blip is not None else None,
                 "crop": dict(crop.attrib) if crop is not None else None}
    if n.kind == "cxnSp":
        ends = child(e, "nvCxnSpPr", "cNvCxnSpPr")
        args["ends"] = {name: dict(x.attrib) for name in ("stCxn", "endCxn") if ends is not None and (x := child(ends, name)) is not None}
    table = next((x for x in e.iter() if local(x.tag) == "tbl"), None) if n.kind == "graphicFrame" else None
    if table is not None:
        grid = child(table, "tblGrid")
        rows = [x for x in table if local(x.tag) == "tr"]
        args["table"] = {
            "widths": [int(x.get("w") or 0) for x in grid if local(x.tag) == "gridCol"] if grid is not None else [], "heights": [int(r.get("h") or 0) for r in rows],
            "cells": [[{"text": _text(child(c, "txBody")), "spans": {k: v for k, v in c.attrib.items() if k in ("gridSpan", "rowSpan")}} for c in r if local(c.tag) == "tc"] for r in rows]}
    return {k: v for k, v in args.items() if v not in (None, {}, [])}


def draw_ops(parts: DataFrame) -> DataFrame:
    """deck, slide_no, seq (drawing order, a group after its shapes), op, shape_id, parent_id, args (JSON) of all slides."""
    def run(deck, part, body):
        number = int("".join(c for c in part.rpartition("/")[2] if c.isdigit()))
        return [(deck, number, n.z, NAMES[n.kind], n.shape_id, n.parent_id, json.dumps(_args(n), ensure_ascii=False, sort_keys=True)) for n in nodes(body)]

    return rows_of(slide_parts(parts), run, OPS)


def left_out(parts: DataFrame) -> DataFrame:
    """deck, part, shape_id, what: what of a shape has no field in draw_ops()."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            props = child(n.element, "spPr")
            fill, shape = fill_of(props), geometry_of(props)
            what = [x for x, there in (
                ("fill", fill is not None and fill["kind"] not in ("solid", "none")), ("effects", bool(effects_of(props))), ("path", shape is not None and shape["kind"] == "custom"),
                ("frame", n.kind == "graphicFrame" and not any(local(x.tag) == "tbl" for x in n.element.iter()))) if there]
            out += [(deck, part, n.shape_id, w) for w in what]
        return out

    return rows_of(slide_parts(parts), run, "deck string, part string, shape_id string, what string")


def _attributes(values: dict) -> str:
    return "".join(f" {k}={quoteattr(str(v))}" for k, v in values.items())


def _color(c: dict | None) -> str:
    if not c:
        return ""
    kind, _, name = c["base"].rpartition(":")
    more = "".join(f'<a:{k} val="{v}"/>' for k, v in (c.get("mods") or {}).items())
    if c.get("alpha") is not None:
        more += f'<a:alpha val="{round(c["alpha"] * 100000)}"/>'
    tag, value = {"scheme": ("schemeClr", name), "prst": ("prstClr", name), "sys": ("sysClr", name)}.get(kind, ("srgbClr", name))
    return f"<a:{tag} val={quoteattr(value)}>{more}</a:{tag}>"


def _box_xml(box: dict | None, tag: str = "a:xfrm") -> str:
    if box is None:
        return ""
    inner = "".join(f"<a:{k}{_attributes(box[k])}/>" for k in ("off", "ext", "chOff", "chExt") if k in box)
    return f"<{tag}{_attributes({k: v for k, v in box.items() if not isinstance(v, dict)})}>{inner}</{tag}>"


def _text_xml(paragraphs: list[dict] | None, tag: str) -> str:
    if paragraphs is None:
        return ""
    out = []
    for p in paragraphs:
        runs = []
        for r in p["runs"]:
            if r["text"] == "\n":
                runs.append("<a:br/>")
                continue
            given = {"sz": r["size"] * 100} if "size" in r else {}
            given |= {k: int(r[name]) for k, name in (("b", "bold"), ("i", "italic")) if name in r}
            fill = f"<a:solidFill>{_color({'base': r['color']})}</a:solidFill>" if "color" in r else ""
            face = f"<a:latin typeface={quoteattr(r['font'])}/>" if "font" in r else ""
            runs.append(f"<a:r><a:rPr{_attributes(given)}>{fill}{face}</a:rPr><a:t>{escape(r['text'])}</a:t></a:r>")
        own = {"lvl": p["level"]} | ({"algn": p["align"]} if p.get("align") else {})
        out.append(f"<a:p><a:pPr{_attributes(own)}/>{''.join(runs)}</a:p>")
    return f"<{tag}><a:bodyPr/><a:lstStyle/>{''.join(out)}</{tag}>"


def _properties(args: dict) -> str:
    preset = f'<a:prstGeom prst={quoteattr(args["preset"])}><a:avLst/></a:prstGeom>' if "preset" in args else ""
    fill, line = args.get("fill"), args.get("line")
    paint = "" if not fill else "<a:noFill/>" if fill["kind"] == "none" else f"<a:solidFill>{_color(fill.get('color'))}</a:solidFill>"
    edge = ""
    if line:
        stroke = "<a:noFill/>" if line.get("none") else f"<a:solidFill>{_color(line['color'])}</a:solidFill>" if line.get("color") else ""
        edge = f"<a:ln{_attributes({'w': round(line['width'] * 12700)} if line.get('width') else {})}>{stroke}</a:ln>"
    return f"<p:spPr>{_box_xml(args.get('box'))}{preset}{paint}{edge}</p:spPr>"


def shape_xml(op: str, shape_id: str | None, args: dict, inner: str = "") -> str:
    """The element of one operation; inner: the elements of a group's shapes."""
    head = f"<p:cNvPr{_attributes({'id': shape_id or '', 'name': args.get('name') or ''} | ({'descr': args['descr']} if 'descr' in args else {}))}/>"
    if op == "add_group":
        return f"<p:grpSp><p:nvGrpSpPr>{head}<p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr>{_box_xml(args.get('box'))}</p:grpSpPr>{inner}</p:grpSp>"
    if op == "add_picture":
        crop = f"<a:srcRect{_attributes(args['crop'])}/>" if "crop" in args else ""
        blip = f"<a:blip{_attributes({'r:embed': args['rid']} if 'rid' in args else {})}/>"
        return f"<p:pic><p:nvPicPr>{head}<p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill>{blip}{crop}<a:stretch/></p:blipFill>{_properties(args)}</p:pic>"
    if op == "add_connector":
        ends = "".join(f"<a:{k}{_attributes(v)}/>" for k, v in sorted(args.get("ends", {}).items(), reverse=True))
        return f"<p:cxnSp><p:nvCxnSpPr>{head}<p:cNvCxnSpPr>{ends}</p:cNvCxnSpPr><p:nvPr/></p:nvCxnSpPr>{_properties(args)}</p:cxnSp>"
    if op == "add_table":
        t = args.get("table", {"widths": [], "heights": [], "cells": []})
        grid = "".join(f'<a:gridCol w="{w}"/>' for w in t["widths"])
        rows = "".join(
            f'<a:tr h="{h}">' + "".join(f"<a:tc{_attributes(c['spans'])}>{_text_xml(c['text'], 'a:txBody')}<a:tcPr/></a:tc>" for c in cells) + "</a:tr>"
            for h, cells in zip(t["heights"], t["cells"], strict=True))
        uri = "http://schemas.openxmlformats.org/drawingml/2006/table"
        body = f'<a:graphic><a:graphicData uri="{uri}"><a:tbl><a:tblPr/><a:tblGrid>{grid}</a:tblGrid>{rows}</a:tbl></a:graphicData></a:graphic>' if "table" in args else ""
        return f"<p:graphicFrame><p:nvGraphicFramePr>{head}<p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{_box_xml(args.get('box'), 'p:xfrm')}{body}</p:graphicFrame>"
    ph = f"<p:ph{_attributes(args['placeholder'])}/>" if "placeholder" in args else ""
    return f"<p:sp><p:nvSpPr>{head}<p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{_properties(args)}{_text_xml(args.get('text'), 'p:txBody')}</p:sp>"


def slide_xml(ops: list[tuple[int, str, str | None, str | None, str]]) -> bytes:
    """A slide of its (seq, op, shape_id, parent_id, args)."""
    done: dict[str | None, list[str]] = {}
    for _, op, shape_id, parent, args in sorted(ops, key=lambda r: r[0]):
        # a group comes after its shapes, which wait under its id
        inner = "".join(done.pop(shape_id, [])) if op == "add_group" else ""
        done.setdefault(parent, []).append(shape_xml(op, shape_id, json.loads(args), inner))
    names = "".join(f' xmlns:{k}="{v}"' for k, v in SPACES.items())
    root = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><p:sld{names}><p:cSld><p:spTree>{root}{"".join(done.pop(None, []))}</p:spTree></p:cSld></p:sld>'.encode()


def slide_parts_of(ops: DataFrame) -> DataFrame:
    """deck, part, body of the slides that the operations draw; a slide is gathered in one task."""
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("seq", "op", "shape_id", "parent_id", "args")), strict=True))
        name = f"ppt/slides/slide{t.column('slide_no')[0].as_py()}.xml"
        return pa.table({"deck": pa.array([t.column("deck")[0].as_py()], pa.string()), "part": pa.array([name]), "body": pa.array([slide_xml(rows)], pa.binary())})

    return ops.groupBy("deck", "slide_no").applyInArrow(run, PARTS)


def replaced(parts: DataFrame, new: DataFrame) -> DataFrame:
    """parts with those of new in the place of the ones of the same name."""
    return parts.where("part is not null").join(new.select("deck", "part"), ["deck", "part"], "left_anti").select("deck", "part", "body").unionByName(new)


def write_packages(parts: DataFrame, path: str, suffix: str = ".pptx") -> DataFrame:
    """Write a package a deck to a folder that all executors share: deck, path, bytes, sha256.

    A file is written under another name and then renamed, so a task that runs again replaces its own. A deck is one file, so
    its parts are gathered in one task.
    """
    def run(t: pa.Table) -> pa.Table:
        from pyarrow import fs

        deck = t.column("deck")[0].as_py()
        raw = write_package(list(zip(t.column("part").to_pylist(), t.column("body").to_pylist(), strict=True)))
        name = f"{path.rstrip('/')}/{hashlib.sha256(deck.encode()).hexdigest()[:16] if '/' in deck else deck}{suffix}"
        files, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        draft = f"{at}.{TaskContext.get().taskAttemptId()}.part"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(raw)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_file(at)
        files.move(draft, at)
        return pa.table({"deck": pa.array([deck]), "path": pa.array([name]), "bytes": pa.array([len(raw)], pa.int64()), "sha256": pa.array([hashlib.sha256(raw).hexdigest()])})

    return parts.where("part is not null").select("deck", "part", "body").groupBy("deck").applyInArrow(run, "deck string, path string, bytes long, sha256 string")


def rename_ids(ops: DataFrame, ids: DataFrame) -> DataFrame:
    """Operations with shape ids of ids(deck, slide_no, old, new), in parents and connector ends too."""
    pairs = ids.groupBy("deck", "slide_no").agg(F.map_from_entries(F.collect_list(F.struct(F.col("old"), F.col("new")))).alias("m"))
    rows = ops.join(pairs, ["deck", "slide_no"], "left")
    args = F.col("args")
    for side in ("stCxn", "endCxn"):
        old = F.get_json_object("args", f"$.ends.{side}.id")
        new = F.coalesce(F.col("m")[old], old)
        # keys of a sorted JSON object: the id comes first in an end
        args = F.when(old.isNotNull(), F.replace(args, F.concat(F.lit(f'"{side}": {{"id": "'), old, F.lit('"')), F.concat(F.lit(f'"{side}": {{"id": "'), new, F.lit('"')))).otherwise(args)
    return rows.select(
        "deck", "slide_no", "seq", "op", F.coalesce(F.col("m")[F.col("shape_id")], "shape_id").alias("shape_id"), F.coalesce(F.col("m")[F.col("parent_id")], "parent_id").alias("parent_id"), args.alias("args"))


def isolated(ops: DataFrame, paths: DataFrame, selected: DataFrame, background: str, width: int, height: int) -> DataFrame:
    """The operations of selected(deck, slide_no, shape_id) and of the groups they are in, on a plain background.

    A selected group keeps all its shapes. paths(deck, slide_no, shape_id, path) gives the groups around each shape. Slides
    without a selected shape go; an id that is not on its slide selects nothing.
    """
    key = ["deck", "slide_no"]
    line = paths.select(*key, "shape_id", F.explode(F.concat("path", F.array("shape_id"))).alias("member"))
    picked = selected.select(*key, F.col("shape_id").alias("member")).distinct()
    inside = line.join(picked, [*key, "member"], "left_semi").select(*key, "shape_id")  # selected, or in a selected group
    around = line.join(picked.withColumnRenamed("member", "shape_id"), [*key, "shape_id"], "left_semi").select(*key, F.col("member").alias("shape_id"))
    kept = ops.join(inside.unionByName(around).distinct(), [*key, "shape_id"], "left_semi")
    back = json.dumps({"name": "Background", "preset": "rect", "fill": {"kind": "solid", "color": {"base": background}}, "box": {"off": {"x": 0, "y": 0}, "ext": {"cx": width, "cy": height}}})
    free = ops.groupBy(*key).agg((F.max(F.col("shape_id").cast("long")) + 1).cast("string").alias("shape_id"))
    backs = free.join(kept.select(*key).distinct(), key, "left_semi").select(*key, F.lit(-1).alias("seq"), F.lit("add_shape").alias("op"), "shape_id", F.lit(None).cast("string").alias("parent_id"), F.lit(back).alias("args"))
    return kept.select("deck", "slide_no", "seq", "op", "shape_id", "parent_id", "args").unionByName(backs)


# --- comments -------------------------------------------------------------------------

P188 = "http://schemas.microsoft.com/office/powerpoint/2018/8/main"


def _said_xml(tag: str, own: str, author: str, created: str, text: str, done: bool, inner: str = "") -> str:
    given = {"id": own, "authorId": author, "created": created} | ({"status": "resolved", "complete": "100000"} if done and tag == "cm" else {})
    return f'<p188:{tag}{_attributes(given)}>{inner}<p188:txBody><a:bodyPr/><a:lstStyle/><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p188:txBody></p188:{tag}>'


def comment_parts_of(found: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts of the comments of each slide, the authors with new ones) from rows as comments() gives them and authors(deck, author_id, name).

    Threads and replies get derived ids: of author, time and a number among threads that share both, and of the thread's
    id for its replies. An author is known by its id, else by its name, else a row with a derived id is added. A slide's
    threads are gathered in one task.
    """
    head = found.where("reply = 0").select("deck", "slide_no", "thread", F.col("author").alias("by"), F.col("created").alias("at"))
    facts = found.select("deck", "slide_no", "thread", "reply", F.col("author").alias("name"), "author_id", "created", "text", "resolved")
    derived = braced(uuid5(F.concat(F.lit("author|"), F.col("name"))))
    by_name = authors.groupBy("deck", "name").agg(F.min("author_id").alias("known"))
    rows = facts.join(by_name, ["deck", "name"], "left").withColumn("author_id", F.coalesce("author_id", "known", derived)).drop("known")
    new = rows.select("deck", "author_id", "name").join(authors.select("deck", "author_id"), ["deck", "author_id"], "left_anti").groupBy("deck", "author_id").agg(F.min("name").alias("name"))
    salts = head.withColumn("salt", F.row_number().over(Window.partitionBy("deck", "by", "at").orderBy("slide_no", "thread")) - 1)
    threads = rows.where("reply = 0").join(salts, ["deck", "slide_no", "thread"]).select("deck", "slide_no", "thread", thread_id(F.col("author_id"), F.col("created"), F.col("salt")).alias("thread_key"))
    rows = rows.join(threads, ["deck", "slide_no", "thread"])
    rows = rows.withColumn("own", F.when(F.col("reply") == 0, F.col("thread_key")).otherwise(reply_id(F.col("thread_key"), F.col("author_id"), F.col("created"))))

    def run(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("thread", "reply", "own", "author_id", "created", "text", "resolved")]
        by_thread: dict[int, list[tuple]] = {}
        for row in sorted(zip(*cols, strict=True), key=lambda r: r[:2]):
            by_thread.setdefault(row[0], []).append(row)
        said = []
        for (_, _, own, author, created, text, done), *replies in by_thread.values():
            inner = "".join(_said_xml("reply", *r[2:6], False) for r in replies)
            said.append(_said_xml("cm", own, author, created, text, bool(done), f"<p188:replyLst>{inner}</p188:replyLst>" if inner else ""))
        body = f'<p188:cmLst xmlns:a="{SPACES["a"]}" xmlns:p188="{P188}">{"".join(said)}</p188:cmLst>'.encode()
        part = f"ppt/comments/modernComment_{t.column('slide_no')[0].as_py()}.xml"
        return pa.table({"deck": pa.array([t.column("deck")[0].as_py()], pa.string()), "part": pa.array([part]), "body": pa.array([body], pa.binary())})

    parts = rows.select("deck", "slide_no", "thread", "reply", "own", "author_id", "created", "text", "resolved").groupBy("deck", "slide_no").applyInArrow(run, PARTS)
    return parts, authors.select("deck", "author_id", "name").unionByName(new.select("deck", "author_id", "name"))


def base_deck(parts: DataFrame) -> DataFrame:
    """The parts of decks without their slides and what belongs to slides only: the shell that new slides are put into."""
    return parts.where(F.col("part").isNotNull() & ~F.col("part").rlike(r"^ppt/(slides|notesSlides|comments)/"))
