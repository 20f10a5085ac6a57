"""What the parts of decks hold, as tables: notes, text runs and their styles, tables, charts, connectors, pictures, comments.

Each reader parses the parts it needs in Arrow batches and returns plain rows; everything that goes from
one part to another (relationships, inheritance from layout and master, authors) is a join. Parts that
are missing or do not parse give no rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import relational
from lamina.operators.text import iso_millis, sanitised
from lamina.sources.package import child, local, nodes, relationships, rows_of, shapes, slide_digests, slide_parts, text_of

EMU_PER_INCH = 914400
FONT = ("size", "bold", "italic", "font", "color")


def _root(body: bytes):
    try:
        return ET.fromstring(body)
    except ET.ParseError:
        return None


def _all(e, name: str) -> list:
    return [x for x in e if local(x.tag) == name] if e is not None else []


def _link(e, name: str = "embed") -> str | None:
    """A relationship attribute, whatever its prefix."""
    return next((v for k, v in e.attrib.items() if local(k) == name), None) if e is not None else None


def slides(parts: DataFrame) -> DataFrame:
    """deck, part, slide_no, ordinal (place by number), title (text of the title placeholder, else of the first text)."""
    def run(deck, part, body):
        texts = [(child(n.element, "nvSpPr", "nvPr", "ph"), text_of(n.element).strip()) for n in nodes(body) if n.kind == "sp"]
        title = next((t for ph, t in texts if ph is not None and ph.get("type") in ("title", "ctrTitle") and t), None)
        return [(deck, part, title or next((t for _, t in texts if t), None))]

    found = slide_parts(parts)
    titled = rows_of(found, run, "deck string, part string, title string")
    numbered = found.select("deck", "part", "slide_no", F.row_number().over(Window.partitionBy("deck").orderBy("slide_no", "part")).alias("ordinal"))
    return numbered.join(titled, ["deck", "part"], "left")


def related(parts: DataFrame, kind: str, pattern: str) -> DataFrame:
    """deck, part, target: the first target of a kind of each part whose name matches."""
    found = relationships(parts).where((F.col("type") == kind) & F.col("src_part").rlike(pattern))
    return found.groupBy("deck", F.col("src_part").alias("part")).agg(F.min_by("target", "rid").alias("target"))


# --- notes ----------------------------------------------------------------------------


def notes(parts: DataFrame) -> DataFrame:
    """deck, slide_no, notes: text of the body placeholder of a slide's notes part, without a trailing slide number."""
    def run(deck, part, body):
        for n in nodes(body):
            ph = child(n.element, "nvSpPr", "nvPr", "ph")
            if not n.path and n.kind == "sp" and ph is not None and ph.get("type") == "body":
                lines = ("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in _all(child(n.element, "txBody"), "p"))
                return [(deck, part, "\n".join(x for x in lines if x).strip())]
        return []

    texts = rows_of(parts.where(F.col("part").rlike("^ppt/notesSlides/")), run, "deck string, target string, text string")
    found = slide_parts(parts).drop("body").join(related(parts, "notesSlide", "^ppt/slides/"), ["deck", "part"]).join(texts, ["deck", "target"])
    number = F.regexp_extract("text", r"(\d+)$", 1)
    own = (number != "") & (F.regexp_replace(number, "^0+(?=.)", "") == F.col("slide_no").cast("string"))
    text = F.when(own, F.rtrim(F.regexp_replace("text", r"\s*\d+$", ""))).otherwise(F.col("text"))
    return found.select("deck", "slide_no", text.alias("notes")).where("notes <> ''")


def notes_markdown(parts: DataFrame) -> DataFrame:
    """deck, markdown: the notes of a deck's slides in order; a slide without notes says so.

    A deck is one document, so its slides are gathered in one row.
    """
    rows = slides(parts).join(notes(parts), ["deck", "slide_no"], "left")
    body = F.concat(F.lit("## "), F.coalesce("title", F.concat(F.lit("Slide "), F.col("ordinal").cast("string"))), F.lit("\n\n"), F.coalesce("notes", F.lit("_No speaker notes._")), F.lit("\n"))
    gathered = rows.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("ordinal", body.alias("t")))).alias("s"))
    return gathered.select("deck", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("markdown"))


# --- tables, charts, connectors -------------------------------------------------------


def table_cells(slide_rows: DataFrame) -> DataFrame:
    """deck, part, shape_id, r, c, text, grid_span, row_span, col_width, row_height (inches)."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            table = next((x for x in n.element.iter() if local(x.tag) == "tbl"), None) if n.kind == "graphicFrame" else None
            inch = lambda v: round(int(v or 0) / EMU_PER_INCH, 3)
            widths = [inch(x.get("w")) for x in _all(child(table, "tblGrid") if table is not None else None, "gridCol")]
            for r, row in enumerate(_all(table, "tr")):
                for c, cell in enumerate(_all(row, "tc")):
                    # spans stand on the cell; some writers put them on its properties
                    span = lambda name, cell=cell: int(cell.get(name) or (p.get(name) if (p := child(cell, "tcPr")) is not None else None) or 1)
                    out.append((deck, part, n.shape_id, r, c, text_of(cell), span("gridSpan"), span("rowSpan"), widths[c] if c < len(widths) else None, inch(row.get("h"))))
        return out

    return rows_of(slide_rows, run, "deck string, part string, shape_id string, r int, c int, text string, grid_span int, row_span int, col_width double, row_height double")


def charts(parts: DataFrame) -> DataFrame:
    """deck, part, chart_type, title, series_no, series, pt, category, value, raw: a row for each point of a chart part.

    Categories are those of the first series that has any. A value that is no number is kept as raw text.
    """
    def value(pt):
        v = child(pt, "v")
        raw = v.text if v is not None else None
        try:
            return (float(raw) if raw else 0.0, raw)
        except ValueError:
            return (None, raw)

    def points(e):
        return [x for x in e.iter() if local(x.tag) == "pt"] if e is not None else []

    def words(e):
        return next((x.text or "" for x in e.iter() if local(x.tag) == "v"), "") if e is not None else ""

    def run(deck, part, body):
        root = _root(body)
        area = next((x for x in root.iter() if local(x.tag) == "plotArea"), None) if root is not None else None
        if area is None:
            return []
        plot = next((x for x in area if local(x.tag).endswith("Chart")), None)
        kind = None
        if plot is not None:
            way, group = child(plot, "barDir"), child(plot, "grouping")
            base = {"bar": "BAR", "col": "COLUMN"}.get(way.get("val"), "") if way is not None else local(plot.tag).removesuffix("Chart").upper()
            kind = base + {"stacked": "_STACKED", "percentStacked": "_PERCENT_STACKED"}.get(group.get("val") if group is not None else None, "_CLUSTERED")
        head = next((x for x in root.iter() if local(x.tag) in ("title", "chartTitle")), None)
        title = "".join(x.text or "" for x in head.iter() if local(x.tag) in ("t", "v")) if head is not None else ""
        series = [x for x in area.iter() if local(x.tag) == "ser"]
        labels = next((found for s in series if (found := [words(p) for p in points(child(s, "cat"))])), [])
        out = []
        for i, s in enumerate(series):
            name = words(child(s, "tx"))
            for j, p in enumerate(points(child(s, "val"))):
                out.append((deck, part, kind, title, i, name, j, labels[j] if j < len(labels) else None, *value(p)))
        return out

    schema = "deck string, part string, chart_type string, title string, series_no int, series string, pt int, category string, value double, raw string"
    return rows_of(parts.where(F.col("part").rlike(r"^ppt/charts/chart[^/]*\.xml$")), run, schema)


def connections(slide_rows: DataFrame) -> DataFrame:
    """deck, part, connector_id, side ('begin' or 'end'), target_id, site: connector ends whose connector and target are on the slide."""
    def run(deck, part, body):
        found = nodes(body)
        out = []
        for n in found:
            ends = child(n.element, "nvCxnSpPr", "cNvCxnSpPr") if n.kind == "cxnSp" else None
            for side, name in (("begin", "stCxn"), ("end", "endCxn")):
                end = child(ends, name) if ends is not None else None
                if end is not None and end.get("id") is not None and n.shape_id and not (n.frame and not n.frame.w and not n.frame.h):
                    site = end.get("idx", "0")
                    out.append((deck, part, n.shape_id, side, end.get("id"), int(site) if site.isdigit() else 0))
        return out

    ends = rows_of(slide_rows, run, "deck string, part string, connector_id string, side string, target_id string, site int")
    present = shapes(slide_rows).select("deck", "part", F.col("shape_id").alias("target_id")).distinct()
    return ends.join(present, ["deck", "part", "target_id"], "left_semi").select("deck", "part", "connector_id", "side", "target_id", "site")


# --- text and inherited styles --------------------------------------------------------


def font_of(e) -> tuple:
    """size (points), bold, italic, font, color of run properties; None where not given."""
    if e is None:
        return (None,) * 5
    flag = lambda v: None if v is None else v in ("1", "true")
    fill = child(e, "solidFill")
    rgb, scheme = (child(fill, "srgbClr"), child(fill, "schemeClr")) if fill is not None else (None, None)
    color = rgb.get("val") if rgb is not None else f"scheme:{scheme.get('val')}" if scheme is not None else None
    face = child(e, "latin")
    return (round(int(e.get("sz")) / 100) if e.get("sz") else None, flag(e.get("b")), flag(e.get("i")), face.get("typeface") if face is not None else None, color)


FONT_SCHEMA = "size int, bold boolean, italic boolean, font string, color string"


def runs(slide_rows: DataFrame) -> DataFrame:
    """deck, part, shape_id, ph_type, ph_idx, placeholder, para, run, level, text, and size to color as the shape gives them:
    those of the run, else of its paragraph's default, else of the shape's list style at its level."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            text = child(n.element, "txBody") if n.kind == "sp" else None
            ph = child(n.element, "nvSpPr", "nvPr", "ph")
            key = (ph.get("type"), ph.get("idx"), True) if ph is not None else (None, None, False)
            for i, p in enumerate(_all(text, "p")):
                props = child(p, "pPr")
                level = int(props.get("lvl") or 0) if props is not None else 0
                layers = [font_of(child(props, "defRPr") if props is not None else None), font_of(child(text, "lstStyle", f"lvl{level + 1}pPr", "defRPr"))]
                k = 0
                for e in p:
                    if local(e.tag) not in ("r", "fld", "br"):
                        continue
                    words = "\n" if local(e.tag) == "br" else "".join(t.text or "" for t in _all(e, "t"))
                    merged = [next((v for v in layer if v is not None), None) for layer in zip(font_of(child(e, "rPr")), *layers, strict=True)]
                    out.append((deck, part, n.shape_id, *key, i, k, level, words, *merged))
                    k += 1
        return out

    return rows_of(slide_rows, run, f"deck string, part string, shape_id string, ph_type string, ph_idx string, placeholder boolean, para int, run int, level int, text string, {FONT_SCHEMA}")


def placeholders(parts: DataFrame) -> DataFrame:
    """deck, part, seq, ph_type, ph_idx, x, y, w, h of the placeholders of layouts and masters."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            ph = child(n.element, "nvSpPr", "nvPr", "ph")
            if ph is not None:
                box = tuple(round(v / EMU_PER_INCH, 3) for v in n.frame[:4]) if n.frame else (None,) * 4
                out.append((deck, part, n.z, ph.get("type"), ph.get("idx"), *box))
        return out

    return rows_of(parts.where(F.col("part").rlike("^ppt/slide(Layouts|Masters)/[^/]*[.]xml$")), run, "deck string, part string, seq int, ph_type string, ph_idx string, x double, y double, w double, h double")


def level_styles(parts: DataFrame) -> DataFrame:
    """deck, part, seq (the placeholder's; -1 title and -2 body of a master's own styles), level, size to color."""
    def levels(e):
        return [(lvl, font_of(child(e, f"lvl{lvl + 1}pPr", "defRPr"))) for lvl in range(9) if child(e, f"lvl{lvl + 1}pPr") is not None] if e is not None else []

    def run(deck, part, body):
        root, out = _root(body), []
        for n in nodes(body):
            if child(n.element, "nvSpPr", "nvPr", "ph") is not None:
                out += [(deck, part, n.z, lvl, *font) for lvl, font in levels(child(n.element, "txBody", "lstStyle"))]
        for seq, name in ((-1, "titleStyle"), (-2, "bodyStyle")):
            out += [(deck, part, seq, lvl, *font) for lvl, font in levels(child(root, "txStyles", name) if root is not None else None)]
        return out

    return rows_of(parts.where(F.col("part").rlike("^ppt/slide(Layouts|Masters)/[^/]*[.]xml$")), run, f"deck string, part string, seq int, level int, {FONT_SCHEMA}")


def ancestry(parts: DataFrame) -> DataFrame:
    """deck, part, layout, master of every slide, by two look-ups of relationships."""
    layout = related(parts, "slideLayout", "^ppt/slides/").withColumnRenamed("target", "layout")
    master = related(parts, "slideMaster", "^ppt/slideLayouts/").withColumnsRenamed({"part": "layout", "target": "master"})
    return slide_parts(parts).select("deck", "part").join(layout, ["deck", "part"], "left").join(master, ["deck", "layout"], "left").select("deck", "part", "layout", "master")


def inherited_from(keys: DataFrame, parts: DataFrame, held: DataFrame) -> DataFrame:
    """keys(deck, part, ph_type, ph_idx) with src_part, seq: the placeholder of layout or master each one inherits from.

    held(deck, part, seq, ph_type, ph_idx) are those that have what is inherited. The whole key is tried
    first, then the type alone, then the index alone, each in the layout before the master; where a
    part repeats a key its last placeholder counts.
    """
    out = keys.join(ancestry(parts), ["deck", "part"], "left")
    tiers = [["ph_type", "ph_idx"], ["ph_type"], ["ph_idx"]]
    found = held.groupBy("deck", "part", "ph_type", "ph_idx").agg(F.max("seq").alias("seq"))
    picks = []
    for i, tier in enumerate(tiers):
        for where in ("layout", "master"):
            name = f"_{where}{i}"
            # the first tier is the exact key, null parts included
            only = F.lit(True)
            for k in ("ph_type", "ph_idx"):
                only &= F.lit(True) if k in tier else F.col(k).isNull()
            side = found.where(only).select(F.col("deck").alias("d_"), F.col("part").alias("p_"), *[F.col(k).alias(f"{k}_") for k in tier], F.struct("part", "seq").alias(name))
            on = (F.col("deck") == F.col("d_")) & (F.col(where) == F.col("p_"))
            for k in tier:
                on &= F.col(k).eqNullSafe(F.col(f"{k}_")) if i == 0 else F.col(k) == F.col(f"{k}_")
            out = out.join(side, on, "left").drop("d_", "p_", *[f"{k}_" for k in tier])
            picks.append(F.col(name))
    out = out.withColumn("_src", F.coalesce(*picks))
    return out.select(*keys.columns, "layout", "master", F.col("_src.part").alias("src_part"), F.col("_src.seq").alias("seq"))


def placed_shapes(parts: DataFrame) -> DataFrame:
    """shapes() of all slides, where a placeholder without a box has that of the layout or master."""
    found, held = shapes(slide_parts(parts)), placeholders(parts).where("x is not null")
    bare = found.where("placeholder and x is null").select("deck", "part", "shape_id", "ph_type", "ph_idx")
    boxes = inherited_from(bare, parts, held).join(held.select("deck", F.col("part").alias("src_part"), "seq", "x", "y", "w", "h"), ["deck", "src_part", "seq"])
    boxes = boxes.select("deck", "part", "shape_id", *[F.col(c).alias(f"{c}_") for c in "xywh"])
    out = found.join(boxes, ["deck", "part", "shape_id"], "left")
    return out.withColumns({c: F.coalesce(c, f"{c}_") for c in "xywh"}).drop(*[f"{c}_" for c in "xywh"]).select(found.columns)


def styled_runs(parts: DataFrame) -> DataFrame:
    """runs() of all slides with what they inherit: master style, then placeholder, then the shape's own; the last given wins."""
    found, styles = runs(slide_parts(parts)), level_styles(parts)
    held = placeholders(parts).join(styles.select("deck", "part", "seq").distinct(), ["deck", "part", "seq"], "left_semi")
    keys = found.where("placeholder").select("deck", "part", "shape_id", "ph_type", "ph_idx").distinct()
    source = inherited_from(keys, parts, held).select("deck", "part", "shape_id", "master", "src_part", "seq")
    at = found.join(source, ["deck", "part", "shape_id"], "left")
    base = F.when(F.col("ph_type").isin("title", "ctrTitle", "subTitle"), -1).otherwise(-2)
    at = at.withColumn("base_", F.when(F.col("placeholder"), base))
    for names, prefix in ((("src_part", "seq"), "p_"), (("master", "base_"), "m_")):
        side = styles.select(F.col("deck").alias("d_"), F.col("part").alias("s_"), F.col("seq").alias("q_"), F.col("level").alias("l_"), *[F.col(c).alias(prefix + c) for c in FONT])
        on = (F.col("deck") == F.col("d_")) & (F.col(names[0]) == F.col("s_")) & (F.col(names[1]) == F.col("q_")) & (F.col("level") == F.col("l_"))
        at = at.join(side, on, "left").drop("d_", "s_", "q_", "l_")
    layers = {c: relational.layered(F.col(c), F.col(f"p_{c}"), F.col(f"m_{c}")) for c in FONT}
    return at.withColumns(layers).select(found.columns)


# --- pictures -------------------------------------------------------------------------


def pictures(slide_rows: DataFrame) -> DataFrame:
    """deck, part, shape_id, name, descr, rid, cropped, turn, flipped, groups (ids around it), z."""
    def run(deck, part, body):
        out = []
        for n in nodes(body):
            if n.kind != "pic":
                continue
            head = child(n.element, "nvPicPr", "cNvPr")
            blip = child(n.element, "blipFill", "blip")
            vector = next((x for x in blip.iter() if local(x.tag) == "svgBlip"), None) if blip is not None else None
            crop = child(n.element, "blipFill", "srcRect")
            f = n.frame
            out.append((deck, part, n.shape_id, n.name, head.get("descr") if head is not None else None, _link(vector) or _link(blip),
                        crop is not None and bool(crop.attrib), f.turn if f else 0.0, bool(f and (f.flip_h or f.flip_v)), list(n.path), n.z))
        return out

    return rows_of(slide_rows, run, "deck string, part string, shape_id string, name string, descr string, rid string, cropped boolean, turn double, flipped boolean, groups array<string>, z int")


def picture_usages(parts: DataFrame) -> DataFrame:
    """Each picture with its media: deck, slide_no, shape_id, name, descr, media, sha256, reasons (why its rendering is
    needed) and problem (why it has no media, else null)."""
    found = slide_parts(parts)
    links = relationships(parts).select("deck", F.col("src_part").alias("part"), "rid", F.col("target").alias("media"))
    media = parts.where(F.col("part").rlike("^ppt/media/")).select("deck", F.col("part").alias("media"), F.sha2("body", 256).alias("sha256"))
    rows = pictures(found).join(found.select("deck", "part", "slide_no"), ["deck", "part"]).join(links, ["deck", "part", "rid"], "left").join(media, ["deck", "media"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("cropped"), "cropped"), F.when(F.col("turn") != 0, "rotated"), F.when(F.col("flipped"), "flipped"), F.when(F.size("groups") > 0, "in a group")))
    problem = F.when(F.col("media").isNull(), "no resolvable media").when(F.col("sha256").isNull(), "media part is missing")
    return rows.select("deck", "slide_no", "z", "shape_id", "name", "descr", F.element_at(F.split("media", "/"), -1).alias("media"), "sha256", reasons.alias("reasons"), problem.alias("problem"))


#: Names that tell nothing of a picture.
GENERIC_NAME = r"(?i)^(picture|image|graphic|content placeholder|google shape)(\s*[;\d].*)?$"


def assets(usages: DataFrame) -> DataFrame:
    """deck, sha256, file, uses, slides, first_slide: a row for each distinct media of picture_usages(), named by its first use.

    The name is that of the description, else of the shape unless it is a generic one, else of the media; a name
    that is taken gets -2 and so on. A deck's media are numbered in one task.
    """
    good = usages.where("problem is null")
    clean = lambda c: F.nullif(F.regexp_replace(sanitised(F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")), "_", "-"), F.lit(""))
    stem = F.coalesce(clean(F.col("descr")), F.when(~F.col("name").rlike(GENERIC_NAME), clean(F.col("name"))), clean(F.col("media")), F.lit("visual"))
    named = good.withColumn("stem", stem).withColumn("suffix", F.lower(F.regexp_extract("media", r"(\.[^.]*)$", 1)))
    first = F.min_by(F.struct("slide_no", "stem", "suffix"), F.struct("slide_no", "z")).alias("first")
    each = named.groupBy("deck", "sha256").agg(first, F.min(F.struct("slide_no", "z")).alias("at"), F.count("*").alias("uses"), F.array_sort(F.collect_set("slide_no")).alias("slides"))
    each = each.select("deck", "sha256", "uses", "slides", "at", F.col("first.slide_no").alias("first_slide"), F.col("first.stem").alias("stem"), F.col("first.suffix").alias("suffix"))
    named = relational.distinct_names(each, ["deck", "suffix"], "stem", "at", "-", 2)
    return named.select("deck", "sha256", F.concat("name", "suffix").alias("file"), "uses", "slides", "first_slide")


def asset_summary(usages: DataFrame) -> DataFrame:
    """deck, assets, resolved, unresolved, total, repeated."""
    each = usages.groupBy("deck", "sha256").agg(F.count("*").alias("n"), F.count("problem").alias("bad"))
    good = F.col("bad") == 0
    return each.groupBy("deck").agg(
        F.count_if(good).alias("assets"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("resolved"), F.coalesce(F.sum("bad"), F.lit(0)).alias("unresolved"),
        F.sum("n").alias("total"), F.count_if(good & (F.col("n") > 1)).alias("repeated"))


# --- comments -------------------------------------------------------------------------


def authors(parts: DataFrame) -> DataFrame:
    """deck, author_id, name, initials, user_id, provider_id."""
    def run(deck, part, body):
        root = _root(body)
        return [(deck, a.get("id"), a.get("name", ""), a.get("initials", ""), a.get("userId", ""), a.get("providerId", "None")) for a in _all(root, "author") if a.get("id")]

    return rows_of(parts.where("part = 'ppt/authors.xml'"), run, "deck string, author_id string, name string, initials string, user_id string, provider_id string")


def comments(parts: DataFrame) -> DataFrame:
    """deck, slide_no (place of the slide), thread, reply (0 for the thread itself), author, author_id, created, text, resolved.

    thread numbers the threads of a comment part in its order. author_id is given only where two authors of the
    deck share a name; an unknown author is 'Unknown'.
    """
    def words(e):
        body = child(e, "txBody")
        return "".join(t.text or "" for t in body.iter() if local(t.tag) == "t") if body is not None else ""

    def run(deck, part, body):
        out = []
        for i, cm in enumerate(_all(_root(body), "cm")):
            done = cm.get("status", "") == "resolved"
            for k, e in enumerate([cm, *_all(child(cm, "replyLst"), "reply")]):
                out.append((deck, part, i, k, e.get("authorId", ""), e.get("created", ""), words(e), done))
        return out

    rows = rows_of(parts.where(F.col("part").rlike(r"^ppt/comments/.*\.xml$")), run, "deck string, target string, thread int, reply int, author_id string, created string, text string, resolved boolean")
    on_slide = relationships(parts).where("type = 'comments' and src_part like 'ppt/slides/%'").select("deck", F.col("src_part").alias("part"), "target")
    place = slide_parts(parts).select("deck", "part", F.row_number().over(Window.partitionBy("deck").orderBy("slide_no", "part")).alias("slide_no"))
    known = authors(parts)
    shared = known.where("name <> ''").groupBy("deck", "name").agg(F.count("*").alias("n")).where("n > 1").select("deck", F.col("name").alias("author"), F.lit(True).alias("shared"))
    out = rows.join(on_slide, ["deck", "target"]).join(place, ["deck", "part"]).join(known.select("deck", "author_id", F.nullif("name", F.lit("")).alias("author")), ["deck", "author_id"], "left")
    out = out.withColumn("author", F.coalesce("author", F.lit("Unknown"))).join(shared, ["deck", "author"], "left")
    return out.select("deck", "slide_no", "thread", "reply", "author", F.when(F.col("shared"), F.col("author_id")).alias("author_id"), "created", "text", "resolved")


def comment_digests(found: DataFrame) -> DataFrame:
    """deck, slide_no, digest of a slide's threads: their order does not count, that of the replies does, ids do not."""
    line = F.to_json(F.struct("author", "created", "text", "resolved"))
    threads = found.groupBy("deck", "slide_no", "thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("reply", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    return threads.groupBy("deck", "slide_no").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.array_join("lines", "\n")))), 256).alias("digest"))


def merged_comments(found: DataFrame, pending: DataFrame) -> DataFrame:
    """Threads of decks and those of pending(deck, slide_no, author, created, text) that no deck has yet: deck, slide_no,
    author, created, text, pending.

    A thread is known by its author and time, and times are compared by value: writers drop a fraction of zero.
    """
    built = found.where("reply = 0")
    known = built.select("deck", "slide_no", "author", iso_millis(F.col("created")).alias("at"))
    rest = relational.carry_over(pending.withColumn("at", iso_millis(F.col("created"))), known, ["deck", "slide_no", "author", "at"])
    names = ["deck", "slide_no", "author", "created", "text"]
    return built.select(*names, F.lit(False).alias("pending")).unionByName(rest.select(*names, F.lit(True).alias("pending")))


# --- state and changes ----------------------------------------------------------------


def state(parts: DataFrame) -> DataFrame:
    """deck, ordinal, slide_digest, comment_digest ('' without comments): what tells whether a slide was edited."""
    digests = slide_digests(slide_parts(parts)).withColumnRenamed("digest", "slide_digest")
    said = comment_digests(comments(parts)).select("deck", F.col("slide_no").alias("ordinal"), F.col("digest").alias("comment_digest"))
    rows = slides(parts).select("deck", "part", "ordinal").join(digests, ["deck", "part"]).join(said, ["deck", "ordinal"], "left")
    return rows.select("deck", "ordinal", "slide_digest", F.coalesce("comment_digest", F.lit("")).alias("comment_digest"))


def changed(old: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """deck, ordinal of the slides of new whose digest is not that of old at the same place.

    All slides of a deck whose number of slides differs, none of a deck that old does not have.
    """
    size = lambda rows, name: rows.groupBy("deck").agg(F.count("*").alias(name))
    decks = size(old, "n_old").join(size(new, "n_new"), "deck")
    pairs = new.select("deck", "ordinal", F.col(digest).alias("now")).join(old.select("deck", "ordinal", F.col(digest).alias("before")), ["deck", "ordinal"], "left")
    return pairs.join(decks, "deck").where((F.col("n_old") != F.col("n_new")) | ~F.col("now").eqNullSafe(F.col("before"))).select("deck", "ordinal")


def comment_targets(old: DataFrame, new: DataFrame, pending: DataFrame, done: DataFrame) -> DataFrame:
    """deck, ordinal of the slides whose comments are to be read again: changed ones and those with pending threads, less those done."""
    place = ["deck", F.col("slide_no").alias("ordinal")]
    wanted = changed(old, new, "comment_digest").unionByName(pending.select(*place)).distinct()
    return wanted.join(done.select("deck", "ordinal").distinct(), ["deck", "ordinal"], "left_anti")
