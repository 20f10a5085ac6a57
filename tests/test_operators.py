import io
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import keys
from lamina.operators import raster, relational, text, tree
from lamina.plans import decks
from lamina.session import fresh_path
from lamina.sources import deck, package


def test_snapshot_diff_branches(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "i int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "c")], "i int, h string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(relational.snapshot_diff(None, new, "i", "h")) == []
    assert ids(relational.snapshot_diff(old, new, "i", "h")) == [2]
    assert ids(relational.snapshot_diff(old, new.union(spark.createDataFrame([(3, "d")], new.schema)), "i", "h")) == [1, 2, 3]


def test_slot_plan_is_a_permutation_around_reserved_slots(spark):
    plan = relational.slot_plan(spark.range(1, 8).withColumnRenamed("id", "i"), "i", [2], [1, 4]).orderBy("old").collect()
    assert [(r.old, r.new) for r in plan] == [(1, 2), (3, 3), (4, 5), (5, 6), (6, 7), (7, 8)]
    with pytest.raises(ValueError):
        relational.slot_plan(spark.range(3).withColumnRenamed("id", "i"), "i", [0], [])


def test_range_select():
    assert relational.range_select("7,2-4,3,5-4,40", 10) == [2, 3, 4, 7]
    assert relational.range_select("all", 3) == [1, 2, 3]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(v,) for v in (50, 10, 30, 30, 20)], "k int")
    assert sorted(tuple(r) for r in relational.dense_ids(rows, "k", 3).collect()) == [(10, 1), (20, 2), (30, 3), (50, 4)]


def test_iso_millis(spark):
    rows = spark.createDataFrame([("2024-02-03T04:05:06Z",), ("2024-02-03T04:05:06.700",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.iso_millis(F.col("t"))).collect()] == ["2024-02-03T04:05:06.000", "2024-02-03T04:05:06.700", "x", None]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "b", 1), ("x", "y", 0), ("y", "x", 0), ("o", "gone", 0)], "id string, parent_id string, ord int")
    paths = tree.flatten(nodes)
    assert {r.id: r.path for r in paths.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}
    assert {r.id for r in tree.keep_with_ancestors(paths, spark.createDataFrame([("c",), ("q",)], "id string")).collect()} == {"a", "b", "c"}
    assert {r.id for r in tree.below(paths, spark.createDataFrame([("b",), ("c",)], "id string")).collect()} == {"c"}
    assert {r.id: r.z for r in tree.preorder(paths, 2).collect()} == {"c": 1, "b": 2, "a": 3}
    with pytest.raises(ValueError, match="q"):
        tree.subtree(paths, spark.createDataFrame([("c",), ("q",)], "id string"))


def test_a_chain_of_fifty_levels_is_whole(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(50)], "id long, parent_id long, ord int")
    got = {r.id: r for r in tree.flatten(nodes).collect()}
    assert len(got) == 50 and got[49].depth == 49 and got[49].path == list(range(50))


def test_difference_hash_of_columns(spark):
    grids = np.random.default_rng(0).integers(0, 99, (30, 8, 9))
    rows = spark.createDataFrame([(g.ravel().tolist(),) for g in grids], "v array<int>")
    got = [r[0] for r in rows.select(raster.difference_hash_of(F.col("v"), 9, 8)).collect()]
    assert sorted(got) == sorted(map(raster.difference_hash, grids)) and {len(x) for x in got} == {16}


def test_flood_against_repeated_spreading():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 9), (12, 17), (30, 20)):
        background = rng.random((h, w)) < 0.6
        seen = background.copy()
        seen[1:-1, 1:-1] = False
        while True:
            wide = np.pad(seen, 1)
            more = background & (wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:] | seen)
            if (more == seen).all():
                break
            seen = more
        assert (raster.flood_from_border(background) == seen).all()
        assert (raster.flood_from_border(np.stack([background, ~background, background])) == np.stack([seen, raster.flood_from_border(~background), seen])).all()


def test_background_and_trim():
    picture = np.zeros((10, 12, 4), np.uint8)
    picture[...] = (250, 240, 230, 255)
    picture[2:8, 3:9] = (10, 90, 10, 255)
    picture[4:6, 5:7] = (250, 240, 230, 255)  # enclosed, so it stays
    picture[0, 0] = (255, 245, 235, 255)
    clear, n = raster.without_background(picture)
    assert n == 10 * 12 - 36 and clear[4, 5, 3] == 255 and clear[0, 0, 3] == 0 and (picture[..., 3] == 255).all()
    assert raster.corner_background(picture, 12) == (251, 241, 231)
    assert raster.trimmed(clear, 2).shape == (10, 10, 4) and raster.trimmed(clear)[0, 0].tolist() == [10, 90, 10, 255]
    assert raster.without_background(picture, 0, raster.hex_colour("#fff"))[1] == 0
    for broken, error in ((np.zeros((3, 3, 4), np.uint8), "corners"), (np.arange(144, dtype=np.uint8).reshape(6, 6, 4) | np.array([0, 0, 0, 255], np.uint8), "common")):
        with pytest.raises(ValueError, match=error):
            raster.without_background(broken)
    with pytest.raises(ValueError, match="transparent"):
        raster.trimmed(np.zeros((2, 2, 4), np.uint8))


def test_mattes_of_pictures_and_columns(spark):
    rng = np.random.default_rng(8)
    dark, light = rng.integers(0, 256, (2, 5, 7, 3)).astype(np.uint8)
    want = raster.alpha_from_mattes(dark, light).reshape(-1, 4)
    rows = spark.createDataFrame([(i, *map(int, x), *map(int, y)) for i, (x, y) in enumerate(zip(dark.reshape(-1, 3), light.reshape(-1, 3), strict=True))], "i int, a int, b int, c int, x int, y int, z int")
    alpha = raster.matte_alpha([F.col(c) for c in "abc"], [F.col(c) for c in "xyz"])
    got = rows.select("i", *[raster.matte_colour(F.col(c), alpha).alias(c) for c in "abc"], alpha.alias("alpha")).orderBy("i").collect()
    assert [list(r[1:]) for r in got] == want.tolist()


def test_uuids(spark):
    rows = spark.createDataFrame([("Ann", "t1", 0), ("Zoë", "", 0), ("Ann", "t1", 2)], "a string, t string, salt int")
    got = rows.select(keys.thread_id(F.col("a"), F.col("t"), F.col("salt"))).collect()
    seed = lambda r: f"{r[0]}|{r[1]}" + (f"|{r[2]}" if r[2] else "")
    assert [r[0] for r in got] == ["{" + str(uuid.uuid5(keys.NAMESPACE, seed(r))).upper() + "}" for r in rows.collect()]


def test_content_store_adds_what_is_new(spark):
    path, rows = fresh_path(spark, "store"), lambda *t: spark.createDataFrame([(x,) for x in t], "html string")
    assert keys.store_content(rows("a", "b", "a"), "html", ".html", path).count() == 2
    assert keys.store_content(rows("b", "c"), "html", ".html", path).count() == 1 and spark.read.parquet(path).count() == 3


def test_relational(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {tuple(r) for r in relational.reconcile(a, b, "k", "l", "r").collect()} == {(1, "l"), (None, "l"), (3, "r"), (None, "r")}
    good, bad = relational.split_errors(a, {"none": F.col("k").isNull(), "big": F.col("k") > 1})
    assert [r.k for r in good.collect()] == [1] and {(r.k, r.reason) for r in bad.collect()} == {(None, "none"), (2, "big")}
    assert {r.k for r in relational.target_set(a, b, a.where("k = 1"), "k").where("k is not null").collect()} == {2, 3}
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["a_1", "a", "a", "a", "b", "b", "a_1", ""])], "i int, n string")
    got = {r.i: r.name for r in relational.distinct_names(names.withColumn("g", F.lit(0)), ["g"], "n", "i", "_", 1).collect()}
    assert got == {0: "a_1", 1: "a", 2: "a_2", 3: "a_3", 4: "b", 5: "b_1", 6: "a_1_1", 7: ""}
    out, dimension = relational.resolve(
        spark.createDataFrame([(9, "x", None), (8, "y", None), (7, "x", 5)], "ref int, name string, id int"), spark.createDataFrame([(1, "x"), (2, "x")], "id int, name string"), "id", "name", F.col("ref") * 10)
    assert {(r.ref, r.id) for r in out.collect()} == {(9, 1), (8, 80), (7, 5)} and {tuple(r) for r in dimension.collect()} == {(1, "x"), (2, "x"), (80, "y"), (5, "x")}


def deck_parts(spark, *changed):
    """A deck of slides 12 and 3, and packages that cannot be read."""
    rows = [(12, 7, "Seven & co", 100), (3, 15, "Fifteen", 250)]
    raw = decks.deck_of([(n, k, name.replace("&", "&amp;"), c) for n, k, name, c in rows])
    return raw, package.parts(spark.createDataFrame([("d", raw), ("bad", b"no zip"), ("none", None), *changed], "deck string, body binary"))


def test_package(spark):
    raw, parts = deck_parts(spark)
    assert zipfile.ZipFile(io.BytesIO(raw)).namelist()[0] == "[Content_Types].xml"
    links = {(r.src_part[-11:], r.rid): (r.target, r.type) for r in package.relationships(parts).collect()}
    assert links["slide12.xml", "rId2"] == ("ppt/media/m3.png", "image") and len(links) == 13
    assert [(r.slide_no, r.ordinal, r.title) for r in deck.slides(parts).orderBy("ordinal").collect()] == [(3, 1, "Fifteen"), (12, 2, "Seven & co")]
    assert package.slide_digests(package.slide_parts(parts)).select("digest").distinct().count() == 2
    rows = {(r.part[-6:], r.shape_id): r for r in package.shapes(package.slide_parts(parts)).collect()}
    inner, outer = rows["12.xml", "21"], rows["12.xml", "10"]
    assert (inner.parent_id, inner.path, inner.turn, inner.z < rows["12.xml", "20"].z < outer.z) == ("20", ["10", "20"], 90.0, True)
    # the picture's centre is at 1.0 + 2 * 0.2 + 0.4 and 1.0 + 0.1 + 2 * 0.15; a quarter turn takes the other scale
    assert (inner.x, inner.y, inner.w, inner.h) == (1.4, 1.35, 0.8, 0.1)
    chain = [tuple(map(float, f)) for f in ((914400, 914400, 3657600, 1828800, 0, 0, 1828800, 914400, 0), (182880, 45720, 457200, 457200, 0, 0, 914400, 457200, 0), (182880, 91440, 365760, 91440, 0, 0, 1, 1, 90))]
    names = "x double, y double, w double, h double, cx double, cy double, cw double, ch double, turn double"
    folded = spark.createDataFrame([(chain,)], f"c array<struct<{names.replace(' double', ':double')}>>").select(tree.fold_frames(F.col("c")).alias("f")).first().f
    assert [round(v / package.EMU_PER_INCH, 3) for v in folded[:4]] == [inner.x, inner.y, inner.w, inner.h]


def test_deck_notes_and_comments(spark):
    _, parts = deck_parts(spark)
    assert {(r.slide_no, r.notes) for r in deck.notes(parts).collect()} == {(12, "About Seven & co.\nIt pays."), (3, "About Fifteen.\nIt pays.")}
    markdown = {r.deck: r.markdown for r in deck.notes_markdown(parts).collect()}["d"]
    assert markdown.index("## Fifteen") < markdown.index("## Seven & co\n\nAbout Seven")
    said = deck.comments(parts)
    assert {(r.author, r.author_id) for r in said.where("slide_no = 1").collect()} == {("Ann", None), ("Ben", "a2"), ("Unknown", None)}
    digest = lambda rows: {r.slide_no: r.digest for r in deck.comment_digests(rows).collect()}
    same = digest(said)
    assert digest(said.withColumn("thread", 5 - F.col("thread"))) == same  # the order of threads does not count
    assert digest(said.withColumn("reply", -F.col("reply"))) != same  # that of replies does


def test_deck_parts_that_are_missing_or_broken(spark):
    raw, _ = deck_parts(spark)
    names = zipfile.ZipFile(io.BytesIO(raw))
    for gone in ("slideLayout", "slideMaster", "notesSlide", "authors", ".rels", "comment", "chart"):
        less = package.write_package([(n, names.read(n)) for n in names.namelist() if gone not in n])
        torn = package.write_package([(n, names.read(n)[:40] if gone in n else names.read(n)) for n in names.namelist()])
        parts = package.parts(spark.createDataFrame([("less", less), ("torn", torn)], "deck string, body binary")).coalesce(1)
        readers = {"slideLayout": deck.placed_shapes, "slideMaster": deck.styled_runs, "notesSlide": deck.notes_markdown, "authors": deck.comments, ".rels": deck.picture_usages, "comment": deck.comments, "chart": deck.charts}
        found = readers[gone](parts).collect()
        assert len({r.deck for r in found}) == (0 if gone in ("comment", "chart") else 2), gone


def test_catalogue_runs_and_matches_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sf = entry.SMOKE_DIR
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    from lamina.plans.catalogue import ORACLE_SQL, QUERIES

    for name in ("exact_dup_manifest", "snapshot_diff", "slot_plan", "clobber_check", "fallback_inheritance", "flatten_tree", "ts_normalize", "flood_fill",
                 "deck_frames", "deck_styles", "deck_assets", "unique_names", "image_references", "contents_rules", "finalised_notes", "ledger_rules", "surrogate_key"):
        got = QUERIES[name](spark, sf)
        result = con.execute(ORACLE_SQL[name])
        cols = [c[0] for c in result.description]
        assert sorted(cols) == sorted(got.columns)
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, result.fetchall())), name
    assert entry.entry(spark).count() > 0


def test_heading_slugs_of_odd_titles_match_duckdb(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from lamina.plans.catalogue import ORACLE_SQL, QUERIES

    slugs = {
        "token &quot;7702&quot;": "token-quot7702quot", "A &lt;b&gt; &amp;lt;": "a-b-lt", "&#39;a&nbsp;b": "39anbspb", "[a](b) ![i](u)": "ab-iu", "**Ab** `c`": "ab-c",
        "\u039f\u0394\u039f\u03a3": "\u03bf\u03b4\u03bf\u03c3", "\u0130x": "ix", "x\U00031350\u2c2f\ua7cb": "x\U00031350\u2c5f", "": "", " ! ": "-1"}
    rows = [(i, "http://h/x", f"<h1>{t}</h1>") for i, t in enumerate(slugs)] + [(None, "http://n/x", "<h1>N</h1>"), (50, "http://n/x", "<h1>N</h1>"), (51, None, None), (52, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["heading_slugs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(ORACLE_SQL["heading_slugs"]).fetchall(), key=str)
    assert set(got) == {*enumerate(slugs.values()), (50, "n"), (None, "n-1"), (51, None), (52, None)}


def test_colours_fills_and_lines():
    import xml.etree.ElementTree as ET

    from lamina.sources import styles

    read = lambda inner, fn: fn(ET.fromstring(f'<x xmlns:a="a">{inner}</x>'))
    colours = {
        '<a:scrgbClr r="100000" g="50000" b="0"/>': "FF7F00", '<a:sysClr val="windowText"/>': "sys:windowText", '<a:hslClr hue="1" sat="2" lum="3"/>': "hsl:1,2,3", '<a:prstClr val="red"/>': "prst:red",
        '<a:schemeClr val="bg1"/><a:srgbClr val="010203"/>': "010203", "": None}
    for inner, want in colours.items():
        got = read(inner, styles.color_of)
        assert (got and got["base"]) == want and (got is None or got["alpha"] is None)
    assert read('<a:srgbClr val="1"><a:alpha val="x"/><a:tint val="5"/></a:srgbClr>', styles.color_of) == {"base": "1", "alpha": None, "mods": {"tint": "5"}}
    pattern = read('<a:pattFill prst="dots"><a:fgClr><a:srgbClr val="1"/></a:fgClr><a:bgClr><a:srgbClr val="2"/></a:bgClr></a:pattFill>', styles.fill_of)
    assert (pattern["kind"], pattern["pattern"], pattern["color"]["base"], pattern["back"]["base"]) == ("pattern", "dots", "1", "2")
    assert read("", styles.fill_of) is None and read("", styles.line_of) is None and read("<a:tailEnd/>", styles.line_of)["tail"]["type"] == "arrow"
    assert read('<a:custGeom/><a:ln><a:ext uri="{u}"><a:prstGeom prst="cloud"/></a:ext></a:ln>', styles.geometry_of) == {"kind": "sketch", "preset": "cloud", "adjustments": []}
    assert read("<a:custGeom/>", styles.geometry_of)["kind"] == "custom" and read("", styles.geometry_of) is None
    assert [e["kind"] for e in read('<a:softEdge/><a:glow rad="7"/>', styles.effects_of)] == ["glow", "softEdge"]


def test_decks_drawn_anew(spark):
    from lamina.sources import emit, styles

    _, parts = deck_parts(spark)
    new = emit.replaced(parts, emit.slide_parts_of(emit.draw_ops(parts)))
    path = fresh_path(spark, "packages")
    (written,) = emit.write_packages(new, path).collect()
    assert written.bytes > 0 and [r.sha256 for r in emit.write_packages(new, path).collect()] == [written.sha256]
    back = package.parts(package.read_packages(spark, path).withColumn("deck", F.lit("d")))
    rows = lambda df, *drop: sorted(map(str, df.drop(*drop).collect()))
    of = package.slide_parts
    assert rows(package.shapes(of(back))) == rows(package.shapes(of(parts)))
    for reader in (deck.runs, deck.table_cells, deck.connections, deck.pictures):
        assert rows(reader(of(back))) == rows(reader(of(parts))), reader
    assert rows(deck.notes(back)) == rows(deck.notes(parts)) and rows(deck.comments(back)) == rows(deck.comments(parts))
    lost = {(r.shape_id, r.what) for r in emit.left_out(parts).collect()}
    assert lost == {("60", "effects"), ("61", "fill"), ("62", "fill")} and emit.left_out(back).count() == 0
    kept = F.col("fill.kind").isin("solid", "none")
    look = lambda df: rows(styles.shape_styles(of(df)).where(kept).select("shape_id", "fill", "line.width", "line.color", "line.none", "geometry.preset"))
    assert look(back) == look(parts)


def test_comments_written_and_read(spark):
    from lamina.sources import emit

    _, parts = deck_parts(spark)
    said = deck.comments(parts)
    more = spark.createDataFrame([("d", 1, 7, 0, "New <one>", None, "t", "a & b", False), ("d", 1, 8, 0, "New <one>", None, "t", "same author and time", True)], said.schema)
    new, people = emit.comment_parts_of(said.unionByName(more), deck.authors(parts))
    assert {r.name for r in people.collect()} == {"Ann", "Ben", "Unknown", "New <one>"} and people.count() == 5
    rels = spark.createDataFrame([("d", f"ppt/slides/_rels/slide{n}.xml.rels", decks.relations(("rId1", "comments", f"../comments/modernComment_{i}.xml"))) for i, n in ((1, 3), (2, 12))], package.PARTS)
    listed = people.collect()
    xml = "<q:authorLst xmlns:q='q'>" + "".join(f"<q:author id='{r.author_id}' name='{r.name.replace('<', '&lt;')}'/>" for r in listed) + "</q:authorLst>"
    names = spark.createDataFrame([("d", "ppt/authors.xml", xml.encode())], package.PARTS)
    back = deck.comments(emit.base_deck(parts).where("part <> 'ppt/authors.xml'").unionByName(package.slide_parts(parts).select("deck", "part", "body")).unionByName(new).unionByName(rels).unionByName(names))
    line = lambda rows: sorted((r.slide_no, r.author, r.created, r.text, r.resolved, r.reply) for r in rows.collect())
    assert line(back) == line(said.unionByName(more))
    ids = [x for r in new.collect() for x in __import__("re").findall(r' id="(\{[^"]*\})"', r.body.decode())]
    assert len(ids) == len(set(ids)) == 10
