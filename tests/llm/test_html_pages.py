"""Extraction from whole pages against a parser of their articles, and the choice of lines against plain loops."""

import random
from html.parser import HTMLParser

import pytest

from lamina.llm import html_text

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """The blocks of a page's article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    parser = Article()
    parser.feed(html or "")
    parser.close()
    return "\n\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)


def test_all_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(want) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_all_pages_give_their_text_without_the_hint_of_an_article(spark):
    """The same pages with the article element made a plain one: surges and dives find the same lines."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert all("<article>" in r.html for r in pages)
    same = sum(html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == article(r.html) for r in pages)
    assert same == len(pages)


def naive_choice(page, window=3, share=0.1, doubt=4):
    """main_text() from lines on, each sum taken anew."""
    def at(i, values):
        return sum(values[j] for j in range(i, i + window) if 0 <= j < len(values))

    spots = range(1 - window, len(page))
    size, plain = [len(t) for t, _, _ in page], [max(0, len(t) - k) for t, k, _ in page]
    linked = [n > 0 and p <= n / 2 for n, p in zip(size, plain)]
    top, sunk = max(at(i, plain) for i in spots), set()
    for i in spots:
        if at(i, plain) < share * top and at(i, plain) <= at(i, size) / 2:
            own = [j for j in range(i, i + window) if 0 <= j < len(page)]
            for j in own:
                if linked[j] and (not page[j][2] or len(own) == window and all(linked[x] for x in own)):
                    sunk.add(j)
    inside, outside = ([p if x[2] == side else 0 for p, x in zip(plain, page)] for side in (True, False))
    most = max(at(i, outside) for i in spots)
    if any(x[2] for x in page) and (most < doubt * max(at(i, inside) for i in spots) or most == 0):
        return [x[0] for j, x in enumerate(page) if x[2] and j not in sunk] or [x[0] for x in page if x[2]]
    runs, j = [], 0
    while j < len(page):
        if page[j][0] and j not in sunk:
            end = j
            while end < len(page) and page[end][0] and end not in sunk:
                end += 1
            runs.append((j, end))
            j = end
        else:
            j += 1
    peaks = []
    for a, z in runs:
        text = [plain[j] for j in range(a, z)]
        few = sum(page[j][1] for j in range(a, z)) < sum(size[a:z]) / 2
        peaks.append(max(sum(text[max(0, i) : i + window]) for i in range(1 - window, len(text))) if few else 0)
    strong = [i for i, m in enumerate(peaks) if m and m >= share * max(peaks)]
    if not strong:
        return []
    prose = [m > 0 and any(html_text.SENTENCE.search(page[j][0]) for j in range(*r)) for m, r in zip(peaks, runs)]
    parted = lambda i: any(j in sunk for j in range(runs[i - 1][1], runs[i][0]))
    low, high = strong[0], strong[-1]
    while low > 0 and not parted(low) and prose[low - 1]:
        low -= 1
    while high + 1 < len(runs) and not parted(high + 1) and prose[high + 1]:
        high += 1
    return [page[j][0] for i in range(low, high + 1) if peaks[i] for j in range(*runs[i])]


@pytest.mark.parametrize("window", [1, 3, 5])
def test_choice_of_lines_against_loops(monkeypatch, window):
    rng, changed = random.Random(window), 0
    for _ in range(1500):
        page = []
        for _ in range(rng.randrange(1, 25)):
            n = rng.choice((0, 0, 4, 20, 60, 300))
            page.append(("x" * n + rng.choice((".", "")) if n else "", rng.choice((0, 0, n)), rng.random() < 0.3))
        monkeypatch.setattr(html_text, "WINDOW", window)
        monkeypatch.setattr(html_text, "lines", lambda _, page=page: page)
        got = html_text.main_text("")
        assert got == "\n\n".join(naive_choice(page, window)), page
        monkeypatch.setattr(html_text, "WINDOW", 3)
        changed += got != html_text.main_text("")
    assert (changed > 20) == (window != 3)


BODY = "".join(f"<p>Sentence {i} of the text that the page is about, with some more words to make it long.</p>" for i in range(9))
TEXT = "\n\n".join(f"Sentence {i} of the text that the page is about, with some more words to make it long." for i in range(9))


@pytest.mark.parametrize("html, want", [
    ('<div class="no-sidebar"><p>Some text.</p></div>', "Some text."),
    ("<nav><a href=x>Menu</a><article><p>Real text.</p></article>", "Real text."),
    ("<div><nav>menu</div><p>Some text.</p>", "Some text."),
    ('<article><div class="post-header"><h1>Title</h1></div><p>Some text.</p></article>', "Title\n\nSome text."),
    # an article that is a teaser: the sums outside it are larger by far
    (f"<article><a href=x>More</a> news</article><div>{BODY}</div>", TEXT),
    (f"<div>{BODY}</div><div><article><p>I like it</p></article></div>", TEXT),
    # a hint that the sums bear out
    (f"<div><p>Something else that is not short at all, but no part of the text.</p></div><article>{BODY}</article><div>Imprint and more words.</div>", TEXT),
])
def test_pages(html, want):
    assert html_text.main_text(html) == want
