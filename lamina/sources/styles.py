"""How shapes of decks look, as tables: fills, lines, effects, geometry, body properties and paragraphs.

Values that can take several forms have a `kind` and the fields of that form; the others are null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lamina.sources.package import EMU_PER_INCH, child, local, nodes, relationships, shapes, slide_parts

EMU_PER_POINT = 12700
COLOR = "struct<base:string, alpha:double, mods:map<string,string>>"
FILL = f"struct<kind:string, color:{COLOR}, angle:double, stops:array<struct<at:double, color:{COLOR}>>, pattern:string, back:{COLOR}, rid:string, crop:map<string,string>, tile:boolean>"
END = "struct<type:string, w:string, len:string>"
LINE = f"struct<width:double, none:boolean, color:{COLOR}, dash:string, head:{END}, tail:{END}, cap:string, compound:string>"
EFFECTS = f"array<struct<kind:string, color:{COLOR}, values:map<string,string>>>"
GEOMETRY = "struct<kind:string, preset:string, adjustments:array<struct<name:string, value:string>>>"
REFS = f"map<string, struct<idx:string, color:{COLOR}>>"
TEXT_BODY = "struct<margins:map<string,double>, anchor:string, wrap:string, autofit:string, font_scale:int, line_reduction:int>"
SHAPE_STYLES = f"deck string, part string, shape_id string, type string, fill {FILL}, line {LINE}, effects {EFFECTS}, geometry {GEOMETRY}, refs {REFS}, body {TEXT_BODY}"
SPACING = "struct<points:double, percent:int>"
PARAGRAPHS = (
    "deck string, part string, shape_id string, para int, level int, align string, margin int, indent int, "
    f"line {SPACING}, before {SPACING}, after {SPACING}, bullet string, bullet_text string, bullet_start int, text string, links array<struct<text:string, rid:string, action:string>>"
)


def _tables(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """rows_of() for nested rows, given as dictionaries."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            rows = [r for d, p, b in zip(*(batch.column(c).to_pylist() for c in ("deck", "part", "body")), strict=True) if b is not None for r in fn(d, p, b)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select("deck", "part", "body").mapInArrow(run, schema)


# The ways a colour is changed.
MODS = ("lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff", "shade", "tint")


def color_of(e) -> dict | None:
    """The colour in an element, by the first of the six models that it holds."""
    if e is None:
        return None
    byte = lambda v: min(255, max(0, int(int(v or 0) * 255 / 100000)))
    models = {
        "srgbClr": lambda c: c.get("val"),
        "schemeClr": lambda c: f"scheme:{c.get('val')}",
        "scrgbClr": lambda c: "".join(f"{byte(c.get(k)):02X}" for k in "rgb"),
        "sysClr": lambda c: c.get("lastClr") or f"sys:{c.get('val')}",
        "hslClr": lambda c: f"hsl:{c.get('hue')},{c.get('sat')},{c.get('lum')}",
        "prstClr": lambda c: f"prst:{c.get('val')}",
    }
    found = next(((c, base(c)) for name, base in models.items() if (c := child(e, name)) is not None), None)
    if found is None or found[1] is None:
        return None
    c, base = found
    a = child(c, "alpha")
    try:
        alpha = round(int(a.get("val", 100000)) / 100000, 4) if a is not None else None
    except ValueError:
        alpha = None
    mods = {m: x.get("val") for m in MODS if (x := child(c, m)) is not None and x.get("val") is not None}
    return {"base": base, "alpha": alpha if alpha != 1.0 else None, "mods": mods or None}


def fill_of(e) -> dict | None:
    """The fill in shape or cell properties: solid, gradient, pattern, none or image; None where it is not given."""
    if e is None:
        return None
    if (x := child(e, "solidFill")) is not None:
        return {"kind": "solid", "color": color_of(x)}
    if (x := child(e, "gradFill")) is not None:
        stops = [{"at": int(s.get("pos")) / 100000, "color": color_of(s)} for s in x.iter() if local(s.tag) == "gs" and s.get("pos") is not None]
        line = child(x, "lin")
        # clockwise in the file, the other way round here
        return {"kind": "gradient", "angle": -int(line.get("ang", 0)) / 60000 % 360 if line is not None else 0.0, "stops": stops}
    if (x := child(e, "pattFill")) is not None:
        fore = child(x, "fgClr")
        return {"kind": "pattern", "pattern": x.get("prst"), "color": color_of(fore if fore is not None else x), "back": color_of(child(x, "bgClr"))}
    if child(e, "noFill") is not None:
        return {"kind": "none"}
    if (x := child(e, "blipFill")) is not None:
        blip, crop = child(x, "blip"), child(x, "srcRect")
        rid = next((v for k, v in blip.attrib.items() if local(k) == "embed"), None) if blip is not None else None
        return {"kind": "image", "rid": rid, "crop": dict(crop.attrib) or None if crop is not None else None, "tile": child(x, "tile") is not None}
    return None


def line_of(e) -> dict | None:
    """A line: width in points, colour or none, dash, ends, cap and compound; None where nothing is given."""
    if e is None:
        return None

    def end(name):
        x = child(e, name)
        if x is None:
            return None
        return {"type": x.get("type") or ("arrow" if x.get("w") or x.get("len") or not x.attrib else None), "w": x.get("w"), "len": x.get("len")}

    dash = child(e, "prstDash")
    out = {
        "width": round(int(e.get("w")) / EMU_PER_POINT, 2) if e.get("w") else None, "none": True if child(e, "noFill") is not None else None,
        "color": color_of(child(e, "solidFill")), "dash": dash.get("val") if dash is not None else None, "head": end("headEnd"), "tail": end("tailEnd"), "cap": e.get("cap"), "compound": e.get("cmpd")}
    return out if any(v is not None for v in out.values()) else None


# Effects in the order they are listed, their default colour and radius.
EFFECT_KINDS = {"outerShdw": ("000000", None), "innerShdw": ("000000", None), "glow": ("FFFFFF", "40000"), "reflection": (None, None), "softEdge": (None, "50000")}


def effects_of(e) -> list[dict]:
    out = []
    for kind, (color, radius) in EFFECT_KINDS.items():
        for x in e.iter() if e is not None else ():
            if local(x.tag) == kind:
                values = {k: v for k, v in x.attrib.items() if k in ("blurRad", "dist", "dir", "algn", "rotWithShape", "rad")}
                if radius:
                    values.setdefault("rad", radius)
                out.append({"kind": kind, "color": color_of(x) or ({"base": color} if color else None), "values": values or None})
    return out


def geometry_of(e) -> dict | None:
    """Preset with its adjustments; of a hand-drawn path the preset it was made from; else 'custom'."""
    preset = child(e, "prstGeom") if e is not None else None
    kind = "preset"
    if preset is None:
        if e is None or child(e, "custGeom") is None:
            return None
        preset = next((x for ext in e.iter() if local(ext.tag) == "ext" and ext.get("uri") for x in ext.iter() if local(x.tag) == "prstGeom"), None)
        kind = "sketch" if preset is not None else "custom"
    guides = child(preset, "avLst") if preset is not None else None
    return {"kind": kind, "preset": preset.get("prst") if preset is not None else None,
            "adjustments": [{"name": g.get("name"), "value": g.get("fmla")} for g in guides or () if local(g.tag) == "gd"]}


def body_of(e) -> dict | None:
    """Margins (inches), anchor ('t' unless given), wrap and autofit of a text body."""
    if e is None:
        return None
    props = child(e, "bodyPr")
    if props is None:
        return {"anchor": "t"}
    margins = {k[0]: round(int(v) / EMU_PER_INCH, 3) for k in ("lIns", "rIns", "tIns", "bIns") if (v := props.get(k)) is not None}
    fit = next((n for n in ("spAutoFit", "noAutofit", "normAutofit") if child(props, n) is not None), None)
    shrink = child(props, "normAutofit")
    number = lambda k: int(shrink.get(k)) if shrink is not None and shrink.get(k) else None
    return {"margins": margins or None, "anchor": props.get("anchor") or "t", "wrap": props.get("wrap"), "autofit": fit, "font_scale": number("fontScale"), "line_reduction": number("lnSpcReduction")}


def shape_styles(slides: DataFrame) -> DataFrame:
    """deck, part, shape_id, type, fill, line, effects, geometry, refs (of the theme's styles) and body of every shape."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            props, style = child(n.element, "grpSpPr" if n.kind == "grpSp" else "spPr"), child(n.element, "style")
            refs = [(k, {"idx": r.get("idx"), "color": color_of(r)}) for k in ("lnRef", "fillRef", "effectRef", "fontRef") if style is not None and (r := child(style, k)) is not None]
            out.append({
                "deck": deck, "part": part, "shape_id": n.shape_id, "type": n.kind, "fill": fill_of(props), "line": line_of(child(props, "ln") if props is not None else None),
                "effects": effects_of(props), "geometry": geometry_of(props), "refs": dict(refs) or None, "body": body_of(child(n.element, "txBody"))})
        return out

    return _tables(slides, run, SHAPE_STYLES)


def theme_name(color: Column) -> Column:
    """A colour's base with scheme colours as names of the theme."""
    return F.regexp_replace(color["base"], "^scheme:", "theme_")


def effective(styles: DataFrame) -> DataFrame:
    """shape_styles() with fill_color and line_color: as given, else those of the theme's style; 'none' for no fill."""
    refs = lambda k: theme_name(F.col("refs")[k]["color"])
    fill = F.when(F.col("fill").isNull(), F.coalesce(refs("fillRef"), F.lit("none"))).when(F.col("fill.kind") == "none", "none").otherwise(theme_name(F.col("fill.color")))
    line = F.when(F.col("line").isNull(), refs("lnRef")).when(F.col("line.none"), "none").otherwise(theme_name(F.col("line.color")))
    return styles.withColumns({"fill_color": fill, "line_color": line})


def filled_with(styles: DataFrame, parts: DataFrame) -> DataFrame:
    """shape_styles() with image: the media part of a picture fill, null where it has none or it cannot be found."""
    links = relationships(parts).select("deck", F.col("src_part").alias("part"), F.col("rid").alias("_rid"), F.element_at(F.split("target", "/"), -1).alias("image"))
    return styles.withColumn("_rid", F.col("fill.rid")).join(links, ["deck", "part", "_rid"], "left").drop("_rid")


def paragraphs(slides: DataFrame) -> DataFrame:
    """Every paragraph of a slide's shapes with its alignment, spacing, bullet, text and links."""
    def spacing(e, name):
        x = child(e, name) if e is not None else None
        if x is None:
            return None
        points, percent = child(x, "spcPts"), child(x, "spcPct")
        if points is not None and points.get("val", "").lstrip("-").isdigit():
            return {"points": int(points.get("val")) / 100}  # hundredths of a point in the file
        return {"percent": int(percent.get("val"))} if percent is not None and percent.get("val", "").lstrip("-").isdigit() else None

    def bullet(e):
        if e is None:
            return {}
        if child(e, "buNone") is not None:
            return {"bullet": "none"}
        if child(e, "buBlip") is not None:
            return {"bullet": "blip"}
        if (x := child(e, "buAutoNum")) is not None:
            return {"bullet": "autoNum", "bullet_text": x.get("type"), "bullet_start": int(x.get("startAt")) if x.get("startAt") else None}
        return {"bullet": "char", "bullet_text": x.get("char")} if (x := child(e, "buChar")) is not None else {}

    def run(deck, part, body):
        out = []
        for n in nodes(body):
            text = child(n.element, "txBody")
            for i, p in enumerate(x for x in text or () if local(x.tag) == "p"):
                props = child(p, "pPr")
                get = lambda k, props=props: props.get(k) if props is not None else None
                number = lambda k, get=get: int(get(k)) if get(k) else None
                pieces, links = [], []
                for r in p:
                    if local(r.tag) == "br":
                        pieces.append("\n")
                    elif local(r.tag) in ("r", "fld"):
                        t, click = child(r, "t"), child(r, "rPr", "hlinkClick")
                        pieces.append((t.text if t is not None else "") or "")
                        if click is not None:
                            links.append({"text": pieces[-1], "rid": next((v for k, v in click.attrib.items() if local(k) == "id"), None), "action": click.get("action")})
                out.append({
                    "deck": deck, "part": part, "shape_id": n.shape_id, "para": i, "level": number("lvl") or 0, "align": get("algn"), "margin": number("marL"), "indent": number("indent"),
                    "line": spacing(props, "lnSpc"), "before": spacing(props, "spcBef"), "after": spacing(props, "spcAft"), **bullet(props), "text": "".join(pieces), "links": links})
        return out

    return _tables(slides, run, PARAGRAPHS)


def hyperlinks(found: DataFrame, parts: DataFrame) -> DataFrame:
    """deck, part, shape_id, para, text, url of the links of paragraphs(): the action, else the target, else 'linked'."""
    rows = found.select("deck", "part", "shape_id", "para", F.explode("links").alias("l")).select("deck", "part", "shape_id", "para", "l.*")
    links = relationships(parts).select("deck", F.col("src_part").alias("part"), "rid", "target")
    return rows.join(links, ["deck", "part", "rid"], "left").select(
        "deck", "part", "shape_id", "para", "text", F.coalesce(F.nullif("action", F.lit("")), "target", F.lit("linked")).alias("url"))


def footers(parts: DataFrame) -> DataFrame:
    """deck, footer: the text at the foot (6 inches and below) of two or more layouts, the most frequent, then the shortest.

    Placeholders, blank and long texts and the mark of a slide number do not count.
    """
    layouts = shapes(parts.where(F.col("part").rlike(r"^ppt/slideLayouts/[^/]*\.xml$")))
    low = layouts.where("not placeholder and y >= 6").select("deck", F.trim("text").alias("text")).where("text <> '' and text <> '‹#›'")
    counts = low.groupBy("deck", "text").agg(F.count("*").alias("n")).where("n >= 2 and length(text) <= 120")
    return counts.groupBy("deck").agg(F.min_by("text", F.struct(-F.col("n"), F.length("text"), "text")).alias("footer"))


def literal_numbers(parts: DataFrame) -> DataFrame:
    """deck, slide_no, shape_id of plain shapes at the foot whose whole text is the slide's own number."""
    found = slide_parts(parts)
    rows = shapes(found).join(found.select("deck", "part", "slide_no"), ["deck", "part"])
    return rows.where("not placeholder and y >= 6 and trim(text) = cast(slide_no as string)").select("deck", "slide_no", "shape_id")
