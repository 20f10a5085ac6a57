"""Decks made of the supplier table, one a nation with a slide a supplier, for the queries that read packages.

The parts are small but whole: layout and master with styles, notes, tables, charts, connectors, pictures in
nested groups and comment threads, so every reader of lamina.sources.deck has something to find.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import stored, table
from lamina.sources import package

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SPACES = 'xmlns:p="p" xmlns:a="a" xmlns:c="c" xmlns:r="r" xmlns:q="q"'


def box(x: int, y: int, w: int, h: int, more: str = "", child: str = "") -> str:
    return f'<a:xfrm{more}><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/>{child}</a:xfrm>'


def shape(sid: int, name: str, inner: str = "", ph: str = "", frame: str = "") -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{sid}" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{frame}</p:spPr>{inner}</p:sp>'


def group(sid: int, frame: str, inner: str) -> str:
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="{sid}" name="Group {sid}"/></p:nvGrpSpPr><p:grpSpPr>{frame}</p:grpSpPr>{inner}</p:grpSp>'


def words(*runs: str, level: int = 0) -> str:
    return f'<a:p><a:pPr lvl="{level}"/>' + "".join(runs) + "</a:p>"


def run(text: str, more: str = "") -> str:
    return f"<a:r><a:rPr{more}/><a:t>{text}</a:t></a:r>"


def body(*paragraphs: str, style: str = "") -> str:
    return f"<p:txBody><a:bodyPr/><a:lstStyle>{style}</a:lstStyle>" + "".join(paragraphs) + "</p:txBody>"


def picture(sid: int, name: str, rid: str, frame: str, descr: str = "", crop: str = "") -> str:
    return f'<p:pic><p:nvPicPr><p:cNvPr id="{sid}" name="{name}" descr="{descr}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{rid}"/>{crop}</p:blipFill><p:spPr>{frame}</p:spPr></p:pic>'


def slide(*inner: str, kind: str = "sld", after: str = "") -> bytes:
    return f"<p:{kind} {SPACES}><p:cSld><p:spTree>{''.join(inner)}</p:spTree></p:cSld>{after}</p:{kind}>".encode()


def relations(*targets: tuple[str, str, str]) -> bytes:
    return ("<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in targets) + "</Relationships>").encode()


def level(number: int, more: str = "", inner: str = "") -> str:
    return f"<a:lvl{number}pPr><a:defRPr{more}>{inner}</a:defRPr></a:lvl{number}pPr>"


TITLE, BODY, OTHER = '<p:ph type="title"/>', '<p:ph type="body" idx="1"/>', '<p:ph idx="7"/>'
LAYOUT = slide(
    shape(2, "T", body(), TITLE, box(457200, 182880, 8229600, 914400)),
    shape(3, "B", body(style=level(1, ' i="1"', '<a:solidFill><a:srgbClr val="112233"/></a:solidFill>')), BODY),
    shape(4, "O", body(), OTHER, box(914400, 5486400, 1828800, 457200)), *(shape(5 + i, "F", body(words(run(t))), frame=box(0, 5943600, 914400, 274320)) for i, t in enumerate(("Foot", "A longer foot", "\u2039#\u203a"))),
    kind="sldLayout")
LAYOUT2 = slide(*(shape(2 + i, "F", body(words(run(t))), frame=box(0, y, 914400, 274320)) for i, (t, y) in enumerate((("Foot", 5943600), ("A longer foot", 6035040), ("once", 5943600), ("\u2039#\u203a", 5943600), ("Top", 0)))), kind="sldLayout")
MASTER = slide(
    shape(2, "T", body(), TITLE, box(0, 0, 914400, 914400)), shape(3, "B", body(), '<p:ph type="body"/>', box(457200, 1371600, 8229600, 4572000)),
    kind="sldMaster", after=f"<p:txStyles><p:titleStyle>{level(1, ' sz=\"4400\" b=\"1\"')}</p:titleStyle><p:bodyStyle>{level(1, ' sz=\"3200\"')}{level(2, ' sz=\"2800\"')}</p:bodyStyle></p:txStyles>")
AUTHORS = b'<q:authorLst xmlns:q="q"><q:author id="a1" name="Ann"/><q:author id="a2" name="Ben"/><q:author id="a3" name="Ben"/></q:authorLst>'


def parts_of(n: int, key: int, name: str, cents: int) -> list[tuple[str, bytes]]:
    """The parts of slide n."""
    turn = ' rot="5400000"' if key % 2 else ""
    inner = group(20, box(key % 5 * 91440, 45720, 457200, 457200, child='<a:chOff x="0" y="0"/><a:chExt cx="914400" cy="457200"/>'),
                  picture(21, "Picture 21", "rId2", box(182880, 91440, 365760, 91440, turn)))
    outer = group(10, box(914400, 914400, 3657600, 1828800, child='<a:chOff x="0" y="0"/><a:chExt cx="1828800" cy="914400"/>'), inner + shape(11, "Box", frame=box(0, 0, 914400, 457200)))
    cell = lambda t, span="": f"<a:tc{span}><a:txBody>{words(run(str(t)))}</a:txBody><a:tcPr/></a:tc>"
    cells = f'<a:tr h="457200">{cell("key")}{cell("cents")}</a:tr><a:tr h="914400">{cell(key)}{cell(cents, chr(32) + "gridSpan=" + chr(34) + "2" + chr(34))}</a:tr>'
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="30" name="Table"/></p:nvGraphicFramePr><p:xfrm/><a:tbl><a:tblGrid><a:gridCol w="914400"/><a:gridCol w="1828800"/></a:tblGrid>{cells}</a:tbl></p:graphicFrame>'
    line = f'<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="40" name="Line"/><p:cNvCxnSpPr><a:stCxn id="21" idx="{key % 4}"/><a:endCxn id="{11 if key % 3 else 99}" idx="2"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr>{box(0, 0, 914400, 0)}</p:spPr></p:cxnSp>'
    page = slide(
        shape(2, "Title", body(words(run(name))), TITLE), shape(3, "Body", body(words(run("pays "), run(str(cents), f' sz="{key % 10 * 100 + 1000}"')), words(run("more", ' b="1"'), level=1)), BODY),
        shape(4, "Other", body(words(run("x", ' sz="900"'))), OTHER), outer, frame, line,
        picture(50, "Logo" if key % 2 else "Picture 3", "rId2" if key % 7 else "rId9", box(0, 0, 914400, 914400), "Big Chart.png" if key % 5 == 0 else "", '<a:srcRect l="10"/>' if key % 3 == 0 else ""))
    looks = [
        f'<a:prstGeom prst="rect"><a:avLst><a:gd name="adj" fmla="val {key}"/></a:avLst></a:prstGeom><a:solidFill><a:schemeClr val="accent{key % 6 + 1}"><a:alpha val="{key % 10 * 10000}"/><a:lumMod val="75000"/></a:schemeClr></a:solidFill><a:ln w="{key % 4 * 12700 + 12700}"><a:solidFill><a:srgbClr val="0000FF"/></a:solidFill><a:prstDash val="dash"/><a:tailEnd w="lg"/></a:ln><a:effectLst><a:outerShdw blurRad="{key}"><a:prstClr val="black"/></a:outerShdw><a:glow/></a:effectLst>',
        f'<a:gradFill><a:gsLst><a:gs pos="0"><a:srgbClr val="FFFFFF"/></a:gs><a:gs pos="{key % 100 * 1000}"><a:sysClr val="window" lastClr="EEEEEE"/></a:gs></a:gsLst><a:lin ang="{key % 4 * 5400000}"/></a:gradFill><a:ln><a:noFill/></a:ln>',
        '<a:blipFill><a:blip r:embed="rId2"/><a:tile/></a:blipFill>', "<a:noFill/>", ""]
    theme = '<p:style><a:lnRef idx="2"><a:schemeClr val="accent1"/></a:lnRef><a:fillRef idx="1"><a:srgbClr val="ABCDEF"/></a:fillRef></p:style>'
    listed = '<a:p><a:pPr algn="ctr" marL="342900"><a:lnSpc><a:spcPct val="90000"/></a:lnSpc><a:spcBef><a:spcPts val="{}"/></a:spcBef><a:buAutoNum type="arabicPeriod" startAt="{}"/></a:pPr><a:r><a:rPr><a:hlinkClick r:id="{}"/></a:rPr><a:t>go</a:t></a:r><a:br/><a:r><a:t>on</a:t></a:r></a:p>'
    text = f'<p:txBody><a:bodyPr lIns="91440" anchor="ctr"><a:normAutofit fontScale="62500"/></a:bodyPr>{listed.format(key % 5 * 100 + 600, key, "rId6" if key % 2 else "rId77")}</p:txBody>'
    page = page.replace(b"</p:spTree>", "".join(
        [shape(60 + i, "Look", (theme if i == 4 else "") + (text if i == 0 else ""), frame=box(0, 0, 914400, 914400) + x) for i, x in enumerate(looks)]
        + [shape(70, "Number", body(words(run(str(n if key % 2 else 77)))), frame=box(8229600, 5943600, 457200, 274320))]).encode() + b"</p:spTree>")
    notes = slide(shape(2, "N", body(words(run(f"About {name}.")), words(run(f"It pays.{n}"))), '<p:ph type="body" idx="1"/>'), shape(3, "S", body(words(run(str(n)))), '<p:ph type="sldNum"/>'), kind="notes")
    point = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    one = lambda title, a, b, cat="": f"<c:ser><c:tx><c:v>{title}</c:v></c:tx>{cat}<c:val>{point(0, a)}{point(1, b)}</c:val></c:ser>"
    chart = f"<c:chartSpace {SPACES}><c:chart><c:plotArea><c:barChart><c:barDir val=\"col\"/><c:grouping val=\"stacked\"/>{one('money', cents, key, f'<c:cat>{point(0, chr(97))}{point(1, chr(98))}</c:cat>')}{one('rest', 'n/a', '')}</c:barChart></c:plotArea></c:chart></c:chartSpace>".encode()
    said = lambda tag, who, t, more="", inner="": f'<q:{tag} authorId="{who}" created="2024-01-0{key % 9 + 1}T00:00:00"{more}><q:txBody>{words(run(t))}</q:txBody>{inner}</q:{tag}>'
    replies = f"<q:replyLst>{said('reply', 'a2', f'reply to {name}')}{said('reply', 'a1', 'thanks')}</q:replyLst>"
    threads = f'<q:cmLst {SPACES}>{said("cm", "a1", f"see {name}", inner=replies)}{said("cm", "a9", "done", chr(32) + "status=" + chr(34) + "resolved" + chr(34) if key % 2 else "")}</q:cmLst>'.encode()
    return [
        (f"ppt/slides/slide{n}.xml", page), (f"ppt/notesSlides/notesSlide{n}.xml", notes), (f"ppt/charts/chart{n}.xml", chart), (f"ppt/comments/comment{n}.xml", threads),
        (f"ppt/slides/_rels/slide{n}.xml.rels", relations(
            ("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "image", f"../media/m{key % 4}.png"), ("rId3", "notesSlide", f"../notesSlides/notesSlide{n}.xml"),
            ("rId4", "chart", f"../charts/chart{n}.xml"), ("rId5", "comments", f"../comments/comment{n}.xml"),
            ("rId6", "hyperlink", "https://example.org/a")))]


def deck_of(rows: list[tuple[int, int, str, int]]) -> bytes:
    """A package of slides (n, key, name, cents). m3.png is linked, but not there."""
    parts = [p for r in rows for p in parts_of(*r)]
    parts += [("[Content_Types].xml", b"<Types/>"), ("ppt/authors.xml", AUTHORS), ("ppt/slideLayouts/slideLayout1.xml", LAYOUT), ("ppt/slideLayouts/slideLayout2.xml", LAYOUT2), ("ppt/slideMasters/slideMaster1.xml", MASTER),
              ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", relations(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")))]
    return package.write_package(parts + [(f"ppt/media/m{i}.png", f"picture {i // 2}".encode()) for i in range(3)])


def supplier_parts(spark, sf_dir: str, edited: bool = False) -> DataFrame:
    """deck, part, body of the decks; edited: names of suppliers with a debt end with a mark, and debtors of nation 3 are gone."""
    suppliers = table(spark, sf_dir, "supplier")
    if edited:
        suppliers = suppliers.where("s_nationkey <> 3 or s_acctbal >= 0").withColumn("s_name", F.when(F.col("s_acctbal") < 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    rows = suppliers.select(
        "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("n"), "s_suppkey", "s_name", F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        slides = [(int(r.n), int(r.s_suppkey), r.s_name, int(r.cents)) for r in frame.sort_values("n").itertuples()]
        return pd.DataFrame({"deck": [f"n{int(frame.s_nationkey.iloc[0])}"], "body": [deck_of(slides)]})

    # written, as readers go through the parts several times
    return stored(package.parts(rows.groupBy("s_nationkey").applyInPandas(build, "deck string, body binary")), "deck-parts")
