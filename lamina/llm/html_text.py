"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block element starts a line, a boilerplate container (navigation,
footer, form, advert, comment section and the like, by element or by class, id or role; words that
only tell of the layout do not count, and doubtful ones only for short text or many links) leaves GAP
empty lines in its place, and so does the edge of an article or main element. Then the
characters outside links of WINDOW consecutive lines are summed at every line, and these sums decide:

* A dive is where the sum falls below SHARE of the page's largest and most of the window is links, a surge
  is where text begins again; lines mostly of links in between are dropped, inside an article or main
  element only where the whole window is such lines.
* An article or main element is a hint. It holds where the largest sum outside is below DOUBT times
  the largest inside; then what is outside goes. Otherwise it is a teaser or a comment, and the sums alone
  tell where the text is.
* Without such an element the lines between dives and gaps are passages. Kept are those whose text is
  mostly not links, from the first to the last one whose largest sum reaches SHARE of the page's largest,
  and shorter ones with a sentence's end that only a gap parts from these.

Inside a block each run of white space is one space; blocks are joined by two line feeds in page
order. Character references are decoded after tags are removed. Defined results: null html gives
an empty text, as does a page without text outside boilerplate. Rows with null or repeated page_id
are handled as any other. Elements end where HTML ends them: with their
end tag, their container or an implied end. A boilerplate element that lacks a needed end tag ends at
the next paragraph, heading, section, article or main. Columns besides
page_id, url and html are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
GAP = 3
SHARE = 0.1
LINKS = 0.5
DOUBT = 4
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*\Z")
SCHEMA = "page_id long, url string, text string, n_chars long"

RAW = frozenset("script style noscript template svg math iframe object canvas textarea title select xmp noembed noframes".split())
SKIPPED = frozenset("nav footer aside form menu dialog button head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(["article", "main"])
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "footer form gdpr header menu menubar modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related "
    "respond search share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe toolbar widget contentinfo complementary".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Marks that hold for text of any length; the others are doubtful.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr menubar nav "
    "navbar navigation newsletter pagination respond sidebar signup site-footer site-header skip social sponsor sponsored subscribe toolbar contentinfo complementary".split()
)
#: Parts of a word that tell of a page's layout, not of an element's own text.
LAYOUT = frozenset("no has have with without is not hide show".split())
#: Parts of a word that name the main text.
OWN = frozenset("content main page body article post entry".split())
#: Parts that may follow a mark.
PLACES = frozenset("area bar block box button buttons container content group inner item items left link links list panel posts right row section slot top bottom unit widget wrap wrapper".split())
#: Characters of an element with a doubtful mark from which it is main text, if no more than LOOSE of them are in links.
LONG = 200
LOOSE = 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
EMPTY = re.compile(r"(?:\A|[\s\"'])/\Z")
#: Elements whose end tag may be left out, and what closes them: the element started, those it ends, those that bound the search.
ROWS = frozenset("tr tbody thead tfoot caption".split())
IMPLIED = (
    {"li": (frozenset(["li"]), BLOCKS - {"address", "div", "p"})}
    | {n: (frozenset(["dt", "dd"]), BLOCKS - {"address", "div", "p"} | {"dl"}) for n in ("dt", "dd")}
    | {n: (frozenset(["td", "th"]), ROWS | {"table"}) for n in ("td", "th")}
    | {"tr": (frozenset(["tr", "caption"]), frozenset("tbody thead tfoot table".split()))}
    | {n: (ROWS, frozenset(["table"])) for n in ("tbody", "thead", "tfoot")}
)
OPTIONAL = frozenset("p li dt dd td th tr tbody thead tfoot caption body html head".split())
BOUNDS = frozenset("table td th caption button".split())
TABLE = frozenset("table td th tr tbody thead tfoot caption".split())
IN_HEAD = frozenset("head base link meta".split())
#: What ends an element that never has the end tag it needs.
ENDERS = frozenset("p h1 h2 section blockquote pre".split()) | CONTENT


class Element:
    __slots__ = ("name", "attributes", "closed", "content", "counted", "size", "links")

    def __init__(self, name: str, attributes: str):
        self.name, self.attributes, self.closed, self.content, self.counted, self.size, self.links = name, attributes, False, False, False, 0, 0


def tree(html: str) -> list[tuple[str, Element | str]]:
    """The page as ('text', text), ('open', element) and ('close', element), every element closed.

    An element ends with its end tag, with an end tag of its container, or where HTML implies its end. `closed`
    says that it had its own end tag, `content` that an article or main element is within it, `size` and
    `links` are the characters of text within it, and those of them in links.
    """
    out: list[tuple[str, Element | str]] = []
    stack: list[Element] = []
    count: Counter[str] = Counter()  # of open elements by name
    size = linked = 0
    at, end = 0, len(html)

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            e.size, e.links = size - e.size, linked - e.links
            count[e.name] -= 1
            out.append(("close", e))

    def last(names: frozenset[str] | set[str], bounds: frozenset[str]) -> int:
        if not any(count[n] for n in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in bounds:
                break
        return -1

    while at < end:
        m = TOKEN.search(html, at)
        if piece := html[at : m.start()] if m else html[at:]:
            piece = unescape(piece)
            n = len(piece.strip())
            size += n
            if count["a"]:
                linked += n
            out.append(("text", piece))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in ("body", "html"):
                continue
            bounds = frozenset() if name in TABLE else BOUNDS if name in BLOCKS or name in SKIPPED else BLOCKS
            if (i := last({name}, bounds)) >= 0:
                close(i + 1)
                stack[-1].closed = True
                close(i)
            continue
        if name in RAW:
            if not EMPTY.search(m[3]):
                found = ENDS[name].search(html, at)
                at = found.end() if found else end if name in ("script", "style") else at
            continue
        if stack and name not in IN_HEAD and (i := last({"head"}, frozenset())) >= 0:
            close(i)
        if name in BLOCKS and (i := last({"p"}, BOUNDS)) >= 0:
            close(i)
        if name in IMPLIED and (i := last(*IMPLIED[name])) >= 0:
            close(i)
        if name == "a" and (i := last({"a"}, BLOCKS)) >= 0:
            close(i)
        e = Element(name, m[3])
        if name in CONTENT:
            for x in reversed(stack):
                if x.content:
                    break
                x.content = True
        e.size, e.links = size, linked
        out.append(("open", e))
        stack.append(e)
        count[name] += 1
        if name in VOID or EMPTY.search(m[3]):
            e.closed = True
            close(len(stack) - 1)
    close(0)
    return out


def _mark(word: str) -> str:
    """'strong' or 'doubtful' where a word of class, id or role marks boilerplate, else ''."""
    if word in MARKS:
        return "strong" if word in STRONG else "doubtful"
    parts = [x for x in re.split(r"[-_]+", word) if x]
    if len(parts) < 2 or not LAYOUT.isdisjoint(parts):
        return ""
    if parts[-1] in MARKS:
        return "strong" if parts[-1] in STRONG and (OWN.isdisjoint(parts[:-1]) or parts[-1] in ("ad", "ads", "comment", "comments")) else "doubtful"
    if parts[0] in MARKS and all(x in PLACES or x in MARKS or x.isdigit() for x in parts[1:]):
        return "strong" if parts[0] in STRONG and OWN.isdisjoint(parts[1:]) else "doubtful"
    return ""


def _boilerplate(e: Element, inside: bool) -> bool:
    """Whether an element holds no main text; a header counts only outside an article.

    A mark does not drop headings in an article, nor what contains an article or main element, unless it
    is hidden or has the comments. A doubtful mark does not drop long text with few links.
    """
    name = e.name
    if name == "form" and e.content:
        return False
    if name in SKIPPED or name == "header" and not inside and not e.content:
        return True
    if name in CONTENT or name in ("body", "html") or not e.attributes:
        return False
    for key, value in ATTRIBUTE.findall(e.attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            for word in value.split():
                if not (mark := _mark(word)):
                    continue
                if inside and (name in HEADINGS or word.endswith("header")):
                    continue
                if e.content and word not in ("comments", "comment", "disqus", "respond"):
                    continue
                if mark == "strong" or e.size < LONG or e.links > LOOSE * e.size:
                    return True
    return False


def lines(html: str) -> list[tuple[str, int, bool]]:
    """Lines of a page as (text, characters in links, inside article or main); '' for empty ones."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    links, link, content, skipping = 0, 0, 0, None

    def flush() -> None:
        nonlocal links
        if whole := " ".join("".join(text).split()):
            out.append((whole, links, content > 0))
        text.clear()
        links = 0

    def gap() -> None:
        flush()
        out.extend([("", 0, False)] * GAP)

    for kind, e in tree(html):
        if kind == "text":
            if not skipping:
                text.append(e)
                if link:
                    links += len(e.strip())
            continue
        opening = kind == "open"
        if skipping:
            if opening and not skipping.closed and (e.name in CONTENT or skipping.name not in OPTIONAL and e.name in ENDERS):
                skipping = None  # it ends what was left open before it
                gap()
            else:
                if e is skipping:
                    skipping = None
                    gap()
                continue
        if opening and e.name not in VOID and _boilerplate(e, content > 0):
            skipping = e
            flush()
            continue
        if opening:
            e.counted = True
        if e.name == "a":
            link += 1 if opening else -e.counted
        elif e.name == "br":
            text.append(" ")
        elif e.name in CONTENT:
            gap()
            content += 1 if opening else -e.counted
        elif e.name in BLOCKS:
            flush()
    flush()
    return out


def _sums(sizes: list[int]) -> list[int]:
    """Sums of WINDOW lines, from the one that holds only the first line to the one that holds only the last."""
    return [sum(sizes[max(0, i) : i + WINDOW]) for i in range(1 - WINDOW, len(sizes))]


def _sunk(page: list[tuple[str, int, bool]]) -> list[bool]:
    """Lines mostly of links, in a window where text outside links falls below SHARE of the page's peak."""
    size = [len(t) for t, _, _ in page]
    plain = [max(0, n - k) for n, (_, k, _) in zip(size, page, strict=True)]
    linked = [bool(n) and p <= (1 - LINKS) * n for n, p in zip(size, plain, strict=True)]
    sums, out = _sums(plain), [False] * len(page)
    low = SHARE * max(sums)
    for i, (p, n) in enumerate(zip(sums, _sums(size), strict=True), 1 - WINDOW):
        if p < low and p <= (1 - LINKS) * n:
            window = range(max(0, i), min(len(page), i + WINDOW))
            # a linked heading or a link or two in an article are its own text
            run = len(window) == WINDOW and all(linked[j] for j in window)
            for j in window:
                out[j] |= linked[j] and (run or not page[j][2])
    return out


def _plain(page: list[tuple[str, int, bool]]) -> list[int]:
    return [max(0, len(t) - k) for t, k, _ in page]


def _holds(page: list[tuple[str, int, bool]]) -> bool:
    """Whether the sums bear out that the page's article and main elements have its text."""
    if not any(inside for _, _, inside in page):
        return False
    plain = _plain(page)
    within, without = (max(_sums([p * (inside == side) for p, (_, _, inside) in zip(plain, page, strict=True)])) for side in (True, False))
    return without < DOUBT * within or not without


def _passages(page: list[tuple[str, int, bool]], sunk: list[bool]) -> list[tuple[str, int, bool]]:
    """The lines from the first surge to the last dive, by the sums alone."""
    found: list[list[tuple[str, int, bool]]] = []
    beside: list[bool] = []  # whether only a gap parts a passage from the one before
    new = links_between = True
    for x, s in zip(page, sunk, strict=True):
        if x[0] and not s:
            if new:
                found.append([])
                beside.append(not links_between)
            found[-1].append(x)
            new = links_between = False
        else:
            new = True
            links_between |= s
    peak = [max(_sums(_plain(p))) if sum(k for _, k, _ in p) < LINKS * sum(len(t) for t, _, _ in p) else 0 for p in found]
    if not any(peak):
        return []
    strong = [i for i, m in enumerate(peak) if m >= SHARE * max(peak)]
    first, last = strong[0], strong[-1]
    prose = [m > 0 and any(SENTENCE.search(t) for t, _, _ in p) for m, p in zip(peak, found, strict=True)]
    while first and beside[first] and prose[first - 1]:
        first -= 1
    while last + 1 < len(found) and beside[last + 1] and prose[last + 1]:
        last += 1
    return [x for i in range(first, last + 1) if peak[i] for x in found[i]]


def main_text(html: str | None) -> str:
    page = lines(html or "")
    if not page:
        return ""
    sunk = _sunk(page)
    if _holds(page):
        own = [(x, s) for x, s in zip(page, sunk, strict=True) if x[2]]
        kept = [x for x, s in own if not s] or [x for x, _ in own]
    else:
        kept = _passages(page, sunk)
    return "\n\n".join(t for t, _, _ in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
