"""Secret scan: three fixed patterns, and sliding-window Shannon entropy (DataFrame functions only).

Base spans are leftmost non-overlapping matches per kind: assign, access and hex. A fourth kind,
entropy, looks at candidate strings (runs of 20 or more key characters that mix letters and
digits). A window of WINDOW characters slides over a candidate; its character counts are updated
by the one that enters and the one that leaves, and with them the sum of n*log2(n), held in whole
millionths so that every engine gets the same number. The candidate is reported if the entropy of
any window reaches the threshold of its character class (hexadecimal, or mixed), unless the
allow-list suppresses it (UUIDs, placeholders, counting sequences).

Offsets come from the lengths of the pieces between matches, summed by a window over the matches
of one document, so only matches are shuffled, never texts.

Defined results: a null or empty text has no spans. Repeated rows are reported once each; null
doc_ids are kept. Columns besides doc_id and text are ignored. An empty table gives an empty result.
Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The patterns of the contract.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(_either_case(w) for w in KEYWORDS) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|[eE][xX][aA][mM][pP][lL][eE]|[cC][hH][aA][nN][gG][eE][mM][eE]|[xX]{6}|0123456789|1234567890|abcdefgh"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WINDOW = 20
THRESHOLD = {"hex": 3.0, "mixed": 3.6}
#: n * log2(n) in millionths, for n from 0 to WINDOW.
NLOGN = [round(n * math.log2(n) * 1e6) if n else 0 for n in range(WINDOW + 1)]
#: A window's sum of NLOGN is at most this where its entropy reaches the class's threshold.
MOST = {k: math.floor((math.log2(WINDOW) - h) * WINDOW * 1e6) for k, h in THRESHOLD.items()}
#: The character that stands for a count of 0.
ZERO = 65
#: Cheap conditions without which a kind has no span.
WORD = "(?:" + "|".join(_either_case(w) for w in KEYWORDS) + ")"
RUN = "[0-9a-f]{32}"
LETTER_AND_DIGIT = "[0-9][+/_=-]*[A-Za-z]|[A-Za-z][+/_=-]*[0-9]"


def least_sum(s) -> F.Column:
    """The least sum of n*log2(n) over all windows of s, by incremental counts; null below WINDOW characters.

    The candidate is split once into the numbers of its characters. The counts are a string with a
    character for each of ALPHABET, of which a step overlays the two that change, so a step costs the
    same at any place of a candidate of any length.
    """
    rise = F.array(*[F.lit(b - a).cast("long") for a, b in zip(NLOGN, NLOGN[1:])])
    number = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - ZERO
    digit = lambda n: F.char(n + ZERO)

    def step(at):
        def run(acc, i):
            enters = F.element_at(at, i)
            leaves = F.when(i > WINDOW, F.element_at(at, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
            # bound once: what the window has of both characters before the step
            had = F.struct(enters.alias("e"), leaves.alias("l"), number(acc["c"], enters).alias("more"),
                           F.when(leaves > 0, number(acc["c"], leaves)).otherwise(F.lit(0)).alias("less"))
            return F.element_at(F.transform(F.array(had), lambda h: moved(acc, i, h)), 1)

        return run

    def moved(acc, i, h):
        more = F.overlay(acc["c"], digit(h["more"] + 1), h["e"], F.lit(1))
        counts = F.when(h["l"] == 0, more).when(h["l"] == h["e"], acc["c"]).otherwise(F.overlay(more, digit(h["less"] - 1), h["l"], F.lit(1)))
        total = F.when(h["l"] == h["e"], acc["sum"]).otherwise(
            acc["sum"] + F.element_at(rise, h["more"] + 1) - F.when(h["l"] > 0, F.element_at(rise, F.greatest(h["less"], F.lit(1)))).otherwise(F.lit(0)))
        return F.struct(counts.alias("c"), total.alias("sum"), F.when(i >= WINDOW, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"))

    start = F.struct(F.lit(chr(ZERO) * len(ALPHABET)).alias("c"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 60).cast("long").alias("low"))
    places = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # an array of one, so that the numbers are computed once and not at each step
    slid = F.transform(F.array(places), lambda at: F.aggregate(F.sequence(F.lit(1), F.size(at)), start, step(at), lambda acc: acc["low"]))
    return F.when(F.length(s) >= WINDOW, F.element_at(slid, 1))


def is_entropy_secret(s) -> F.Column:
    """Whether a candidate string is high-entropy in its class and not allowed."""
    mixes = s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike(ALLOWED)
    most = F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(MOST["hex"])).otherwise(F.lit(MOST["mixed"]))
    return F.when(mixes, least_sum(s) <= most).otherwise(F.lit(False))


FOUND = "array<struct<kind:int,k:int,gap:int,len:int,counts:int,s:string>>"


def _found(kind: str, pattern: str, group: int, may: F.Column) -> F.Column:
    """Array of (kind, k, gap before, match, length that counts), k from 0; empty unless may."""
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    found = F.transform(
        F.arrays_zip(whole.alias("m"), counts.alias("g"), F.slice(F.split("text", pattern), F.lit(1), F.size(whole)).alias("gap")),
        lambda x, k: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), k.alias("k"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"),
            F.length(x["g"]).alias("counts"), F.when(F.lit(kind == "entropy"), x["m"]).alias("s"),
        ),
    )
    return F.when(may, found).otherwise(F.array().cast(FOUND))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text -> rid, doc_id, kind (index in KINDS), start, end; one row with null kind where there is none."""
    text = F.col("text")
    word = (text.contains("=") | text.contains(":")) & text.rlike(WORD)
    digit = text.rlike("[0-9]")
    found = F.concat(
        _found("assign", ASSIGN, 2, word), _found("access", ACCESS, 0, text.contains("AKIA")),
        _found("hex", "[0-9a-f]{32,}", 0, text.rlike(RUN)), _found("entropy", CANDIDATE, 0, digit & text.rlike(LETTER_AND_DIGIT)),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("rid", "doc_id", F.explode_outer(found).alias("f")).select("rid", "doc_id", "f.*")
    before = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("rid", "doc_id", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", before).withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32), F.lit(WINDOW)), F.col("kind") + 1)
    good = (F.col("counts") >= least) & F.when(F.col("kind") == 3, is_entropy_secret(F.col("s"))).otherwise(F.lit(True))
    return rows.select("rid", "doc_id", F.when(good, F.col("kind")).alias("kind"), "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy: a row for each document."""
    span = F.struct("start", "kind", "end")
    joined = lambda keep: F.array_join(F.transform(F.array_sort(keep), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    all_spans = F.collect_list(F.when(F.col("kind").isNotNull(), span))
    each = spans(docs).groupBy("rid", "doc_id").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)], all_spans.alias("all"))
    return each.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.filter("all", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_entropy",
    )
