"""Text, Markdown and digest operators as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"(?s)```.*?```"
WORD = r"[^\p{L}\p{N}_\s-]"


def sanitised(name: Column) -> Column:
    """Lower-case identifier: no punctuation, spaces and hyphens as one underscore, at most 60 characters."""
    kept = F.regexp_replace(name, WORD, "")
    joined = F.regexp_replace(kept, r"[\s-]+", "_")
    return F.substring(F.regexp_replace(F.lower(F.regexp_replace(joined, "^_+|_+$", "")), "_+", "_"), 1, 60)


def plain_title(title: Column) -> Column:
    """The visible text of a heading: links and images as their words, without tags and marks."""
    words = F.regexp_replace(F.regexp_replace(title, r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(unescaped(F.regexp_replace(F.regexp_replace(words, "<[^>]+>", ""), "[*_`~]", "")))


REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "amp": "&"}


def unescaped(text: Column, names: Iterable[str] = tuple(REFERENCES)) -> Column:
    """The character references that Markdown writers use, or those named, decoded in their order; & comes last."""
    for name in names:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(REFERENCES[name]))
    return text


# Letters, numbers and marks of Unicode 14 and 15, which the regular expressions of Java 17 do not know (hexadecimal).
LATER = (
    "870-887 889-88e 898-89f 8b5 8c8-8d2 c3c c5d cdd cf3 ece 170d 1715 171f 180f 1ac1-1ace 1b4c 1dfa 2c2f 2c5f 9ffd-9fff a7c0-a7c1 "
    "a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 "
    "105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10efd-10eff 10f70-10f85 11070-11075 110c2 1123f-11241 11740-11746 11ab0-11abf "
    "11f00-11f10 11f12-11f3a 11f3e-11f42 11f50-11f59 12f90-12ff0 1342f 13440-13455 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb "
    "1affd-1affe 1b11f-1b122 1b132 1b155 1cf00-1cf2d 1cf30-1cf46 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e08f 1e290-1e2ae "
    "1e4d0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
SLUG_DROPS = r"[^\p{L}\p{N}\p{Mn}\p{Mc}\p{Pc} " + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in LATER.split()) + "-]"


def slug(title: Column) -> Column:
    """Heading anchor: lower case, no punctuation, each run of blanks a hyphen."""
    kept = F.regexp_replace(F.lower(title), SLUG_DROPS, "")
    return F.regexp_replace(F.trim(kept), " +", "-")


def image_references(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Markdown images, then quoted <img> tags: (key, pos, alt, target) and the errors (key, pos, error).

    A tag without src is an error and no reference; one without alt is both. pos numbers both passes.
    """
    md = F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]*)\)"), F.lit(0))
    tags = F.regexp_extract_all(text, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    rows = docs.select(key, F.posexplode(F.concat(md, tags)).alias("pos", "raw"))
    image = F.col("raw").startswith("![")
    value = lambda name: F.regexp_extract("raw", rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    given = lambda name: F.when(value(name) != "", F.substring(value(name), F.lit(2), F.length(value(name)) - 2))
    target = F.when(image, link_target(F.regexp_extract("raw", r"\]\(([^)]*)\)", 1))).otherwise(F.trim(unescaped(given("src"))))
    alt = F.when(image, F.regexp_extract("raw", r"!\[([^\]]*)\]", 1)).otherwise(unescaped(given("alt")))
    rows = rows.select(key, "pos", alt.alias("alt"), target.alias("target"), image.alias("image_"))
    error = F.when(F.col("target").isNull(), "missing src").when(F.col("alt").isNull(), "missing alt")
    errors = rows.where(~F.col("image_")).select(key, "pos", error.alias("error")).where("error is not null")
    return rows.where("target is not null").select(key, "pos", F.coalesce("alt", F.lit("")).alias("alt"), "target"), errors


def link_target(raw: Column) -> Column:
    """<target with spaces>, else the first token."""
    return F.when(F.trim(raw).startswith("<"), F.regexp_extract(raw, "<([^>]*)>", 1)).otherwise(F.regexp_extract(F.trim(raw), r"^(\S*)", 1))


def link_class(target: Column) -> Column:
    return F.when(target.rlike(r"^(?i)([a-z][a-z0-9+.-]*:|//)"), "remote").when(target.startswith("/"), "absolute").otherwise("relative")


# The marks of a draft.
PREVIEW = r"(?ms)^[ \t]*<!-- lecture-source-preview:start -->[ \t]*\n.*?^[ \t]*<!-- lecture-source-preview:end -->[ \t]*(?:\n|$)"
PROVENANCE = r"(?m)^[ \t]*<!--[ \t]*(?:lecture-source-slide|source-slides?)[ \t]*:[^>]*-->[ \t]*(?:\n|$)"
SLIDE_HEADING = r"(?mi)^#{1,6}[ \t]+slide[ \t]+\d+\b"
SOURCE_TITLE = r"(?mi)^#[ \t]+speaker notes[ \t]*:"
TEMPORARY = r"(?mi)^!\[[^\]]*temporary[^\]]*slide[^\]]*\]\([^)]+\)[ \t]*$"


def finalised(docs: DataFrame, text: str) -> DataFrame:
    """Notes without preview blocks and provenance lines, blank lines squeezed, ended by a line feed: previews, provenance
    (numbers taken out), final, and error, the rule that rejects a draft (final is null then)."""
    rest = F.regexp_replace(F.regexp_replace(text, PREVIEW, ""), PROVENANCE, "")
    error = F.when(rest.rlike(SLIDE_HEADING), "slide heading").when(rest.rlike(SOURCE_TITLE), "source title").when(rest.rlike(TEMPORARY), "temporary preview")
    final = F.concat(F.regexp_replace(F.regexp_replace(rest, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""), F.lit("\n"))
    return docs.withColumns({
        "previews": F.regexp_count(F.col(text), F.lit(PREVIEW)), "provenance": F.regexp_count(F.col(text), F.lit(PROVENANCE)),
        "final": F.when(error.isNull(), final), "error": error})


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, level, title, slug (repeats of a base numbered from -1) of the # headings outside fences."""
    prose = F.regexp_replace(text, FENCE, "")
    lines = docs.select(key, F.posexplode(F.regexp_extract_all(prose, F.lit(r"(?m)^#{1,6}[ \t]+.*$"), F.lit(0))).alias("pos", "line"))
    title = plain_title(F.regexp_replace("line", r"^#+[ \t]+|([ \t]+#+)?[ \t]*$", ""))
    rows = lines.select(key, "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), title.alias("title"))
    rows = rows.withColumn("base", slug(F.col("title")))
    k = F.row_number().over(Window.partitionBy(key, "base").orderBy("pos")) - 1
    return rows.withColumn("slug", F.when(k == 0, F.col("base")).otherwise(F.concat_ws("-", "base", k.cast("string")))).drop("base")


TOC = "Table of Contents"
TOC_ITEM = r"(?m)^([ \t]*)[-*+][ \t]+\[([^\]]+)\]\(#([^)]+)\)[ \t]*$"


def contents_findings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rules of the table of contents that a document breaks: key, rule."""
    heads = headings(docs, key, text)
    is_toc = (F.col("level") == 2) & (F.col("title") == TOC)
    toc = heads.where(is_toc).groupBy(key).agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    titles = heads.where("level = 1").groupBy(key).agg(F.count("*").alias("titles"), F.min("pos").alias("title_at"))
    own = F.struct("pos", "level", F.concat_ws("|", "title", "slug").alias("entry"))
    wanted = heads.where(F.col("level").isin(2, 3) & (F.col("title") != TOC)).groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("wanted"), F.min("pos").alias("first"))
    prose = F.regexp_replace(text, FENCE, "")
    body = F.regexp_extract(prose, rf"(?ms)^##[ \t]+{TOC}[ \t#]*$(.*?)(?=^#{{1,6}}[ \t]+\S|\z)", 1)
    intro = F.regexp_extract(prose, rf"(?ms)^#[ \t]+\S[^\n]*$(.*?)^##[ \t]+{TOC}[ \t#]*$", 1)
    part = lambda i: F.regexp_extract_all("body", F.lit(TOC_ITEM), F.lit(i))
    listed = docs.select(key, body.alias("body"), F.size(F.filter(F.split(intro, r"\n[ \t]*\n"), lambda x: F.trim(F.translate(x, "\n\t", "  ")) != "")).alias("blocks"))
    listed = listed.select(
        key, "blocks", F.transform(part(1), lambda x: F.length(F.replace(x, F.lit("\t"), F.lit("  ")))).alias("indents"),
        F.transform(F.arrays_zip(part(2).alias("t"), part(3).alias("s")), lambda x: F.concat_ws("|", plain_title(x["t"]), x["s"])).alias("listed"),
        (F.regexp_replace(F.regexp_replace("body", TOC_ITEM, ""), r"\s+", "") != "").alias("more"))
    all_ = listed.join(toc, key, "left").join(titles, key, "left").join(wanted, key, "left")
    n, some = F.coalesce("n", F.lit(0)), F.coalesce("wanted", F.array().cast(wanted.schema["wanted"].dataType))
    same = F.col("listed") == F.transform(some, lambda x: x["entry"])
    deep = F.exists(F.arrays_zip(some.alias("w"), F.col("indents").alias("i")), lambda x: ((x["w"]["level"] == 2) & (x["i"] > 0)) | ((x["w"]["level"] == 3) & (x["i"] < 2)))
    one_title = F.coalesce("titles", F.lit(0)) == 1
    rules = F.array_compact(F.array(
        F.when(n == 0, "toc missing"), F.when(n > 1, "toc duplicated"),
        F.when((n > 0) & (~one_title | (F.col("title_at") > F.col("at"))), "title"),
        F.when((n > 0) & one_title & (F.col("title_at") < F.col("at")) & (F.col("blocks") > 1), "introduction"),
        F.when((n > 0) & (F.size(some) == 0), "no content"), F.when((n > 0) & (F.col("first") < F.col("at")), "content before toc"),
        F.when((n > 0) & F.col("more"), "toc holds more than its list"),
        F.when((n > 0) & ~same, "toc differs"), F.when((n > 0) & same & deep, "toc nesting")))
    return all_.select(key, F.explode(rules).alias("rule"))


def iso_millis(raw: Column) -> Column:
    """ISO time with milliseconds from text with or without fraction and Z; other text is returned as it is."""
    plain = F.regexp_replace(raw, "Z$", "")
    at = F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), raw)


# Words that a ledger's rules look for.
MEDIA = r"(?i)(?<![-A-Za-z0-9_.])([A-Za-z0-9][A-Za-z0-9_.-]*\.(?:png|jpe?g|gif|webp|svg))"
RENDER_FAILURE = (
    r"(?i)\b(?:libreoffice|powerpoint|render(?:er|ing|ed)?|font substitution|wrapp?(?:ed|ing|s)?|clipp?(?:ed|ing)?|blank|illegible|layout|geometry|"
    r"extract(?:ion|ed|ing)?|opaque|transparen(?:cy|t))\b"
)
HIGH_RISK = (
    r"(?i)\b(?:diagram|pipeline|architecture|arrow|flow|process|progressive|before[/-]after|before-and-after|workflow|state|model output|annotated|"
    r"task head|head pipeline)\b"
)
TEXT_SUBSTITUTE = r"(?i)\b(?:markdown|prose|table|list|equation|math|text)\b"
NO_SPATIAL = r"(?i)\bno instructional spatial relationship\b"


def ledger_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (line number), candidate, disposition, reason, media: the rows of the first table with these three columns."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("row", "line")).withColumn("line", F.trim("line"))
    cells = F.transform(F.split(F.substring("line", F.lit(2), F.length("line") - 2), r"\|", -1), lambda c: F.trim(c))
    lines = lines.withColumn("table", F.col("line").rlike(r"^\|.*\|$") & (F.length("line") > 1)).withColumn("cells", F.when(F.col("table"), cells))
    # 1-based place of the first cell that names a column, 0 without one
    plain = F.transform("cells", lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", " "))
    names = lambda word: F.transform(plain, lambda x: x.contains(word))
    at = {c: F.array_position(names(c), True) for c in ("candidate", "disposition", "reason")}
    heads = lines.where("table").select(key, "row", *[v.alias(f"at_{c}") for c, v in at.items()]).where("at_candidate > 0 and at_disposition > 0 and at_reason > 0")
    first = heads.groupBy(key).agg(F.min(F.struct("row", "at_candidate", "at_disposition", "at_reason")).alias("h"))
    below = lines.join(first, key).where("row > h.row")
    started = below.where(F.col("table") & ~F.forall("cells", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))).groupBy(key).agg(F.min("row").alias("start"))
    end = below.join(started, key).where("not table and row > start").groupBy(key).agg(F.min("row").alias("end"))
    rows = below.join(started, key).join(end, key, "left").where("table and row >= start and (end is null or row < end)")
    rows = rows.where(~F.forall("cells", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$")))
    cell = lambda c: F.try_element_at("cells", F.col(f"h.at_{c}").cast("int"))
    return rows.select(
        key, (F.col("row") + 1).alias("row"), cell("candidate").alias("candidate"), F.lower(F.regexp_replace(cell("disposition"), "^[ `]+|[ `]+$", "")).alias("disposition"),
        cell("reason").alias("reason"), F.array_distinct(F.regexp_extract_all(F.array_join("cells", " "), F.lit(MEDIA), F.lit(1))).alias("media"),
        (F.size("cells") < F.greatest("h.at_candidate", "h.at_disposition", "h.at_reason")).alias("short"))


def ledger_findings(rows: DataFrame) -> DataFrame:
    """ledger_rows() -> a row for each rule that one of them breaks, with `rule`."""
    kind, short = F.col("disposition"), F.coalesce("short", F.lit(False))
    reason, candidate = F.coalesce("reason", F.lit("")), F.coalesce("candidate", F.lit(""))
    rules = F.array_compact(F.array(
        F.when(short, "too few columns"),
        F.when(~short & ~F.coalesce(kind, F.lit("")).isin("keep", "omit", "retry"), "bad disposition"),
        F.when(~short & (kind == "keep") & (F.size("media") == 0), "keep without asset"),
        F.when(~short & (kind == "retry"), "unresolved retry"),
        F.when(~short & (kind == "omit") & reason.rlike(RENDER_FAILURE), "omit cites render failure"),
        F.when(~short & (kind == "omit") & candidate.rlike(HIGH_RISK) & reason.rlike(TEXT_SUBSTITUTE) & ~reason.rlike(NO_SPATIAL), "diagram replaced by text")))
    return rows.select("*", F.explode(rules).alias("rule"))


def ledger_links(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, asset, problem: assets of keep rows that links(key, asset) lacks, and the other way round."""
    kept = rows.where("disposition = 'keep' and not short").select(key, F.explode("media").alias("asset")).distinct()
    links = links.select(key, "asset").distinct()
    a = kept.join(links, [key, "asset"], "left_anti").withColumn("problem", F.lit("kept, not linked"))
    return a.unionByName(links.join(kept, [key, "asset"], "left_anti").withColumn("problem", F.lit("linked, not kept")))


def autofit(paragraphs: Column, scale: Column, reduction: Column) -> Column:
    """Paragraphs array<struct<spacing, sizes array>> at a font scale and line reduction in hundred-thousandths (null: none).

    Sizes are scaled and rounded to even, spacings above 1000 shrink, and a missing one starts at 100000.
    """
    by, less = F.coalesce(scale, F.lit(100000)) / 100000, F.coalesce(reduction, F.lit(0)) / 100000
    shrunk = lambda v: F.when(less == 0, v).when(v.isNull(), F.floor(100000 * (1 - less))).when(v > 1000, F.floor(v * (1 - less))).otherwise(v).cast("long")
    return F.transform(paragraphs, lambda p: F.struct(shrunk(p["spacing"]).alias("spacing"), F.transform(p["sizes"], lambda s: F.bround(s * by).cast("long")).alias("sizes")))
