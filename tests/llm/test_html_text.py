import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from constella.llm import html_text as H


def test_furniture_goes_and_blocks_stay_in_order():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; tail</h1></header><p><b>One&nbsp; two<br>three<p>Second <i>par</i>t</p><div class="share-box share">Share</div><p>&copy;x &am</p></article>
    <div id="comments"><p>Nice, a very long reader comment that is longer than all of the article together, and then some more of it</p></div><aside>a</aside><form>f</form><footer>foot</footer></body></html>"""
    assert H.main_text(page) == "Head & tail\nOne two three\nSecond part\n©x &am"


def test_page_without_article_markup():
    body = "".join(f"<p>{'Long enough sentence of the story. ' * 4}{k}</p>" for k in range(6))
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><div class=sidebar>s</div><div>{body}</div><div class='footer'>c</div><div><a>More links here</a></div>"
    got = H.main_text(page).split("\n")
    assert len(got) == 6 and got[0].endswith("story. 0") and got[-1].endswith("5")


def test_odd_input():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == H.main_text("<script>x") == ""
    assert H.main_text("plain  text") == "plain text"
    assert H.main_text("<article><p>a < b</p><p title='>'>c") == "a < b\nc"
    assert H.main_text("<p " * 20000) is not None
    assert H.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


class Blocks(HTMLParser):
    """Lines by the standard library's parser, told apart by element only: article markup isn't looked at."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.off, self.hidden = [], "", [], 0
        self.feed(page)
        self.close()
        self.end_line()

    def end_line(self):
        if text := " ".join(self.text.split()):
            self.lines.append(text if not self.off else None)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden += 1
        elif tag in ("p", "h1", "div", "li", "nav", "footer", "article", "aside", "header", "section", "ul"):
            self.end_line()
            if tag in ("nav", "footer", "aside", "header") or dict(attrs).get("class") in ("ad", "comments", "sidebar"):
                self.off.append(tag)
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.hidden -= 1
        elif tag in ("p", "h1", "div", "li", "nav", "footer", "article", "aside", "header", "section", "ul"):
            self.end_line()
            if self.off and self.off[-1] == tag:
                self.off.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def brute(page):
    """Surge and dive over windows of three lines, region by region."""
    found = Blocks(page).lines
    sizes = sorted(len(x) for x in found if x)
    bar = 0.36 * sizes[(len(sizes) - 1) // 2] if sizes else 0
    out, region = [], []
    for x in [*found, None]:
        if x is not None:
            region.append(x)
            continue
        high = [k for k in range(len(region)) if sum(map(len, region[k : k + 3])) > bar]
        if high:
            out.append(region[high[0] : high[-1] + 3])
        region = []
    most = max((sum(map(len, r)) for r in out), default=0)
    return "\n".join(x for r in out if 8 * sum(map(len, r)) >= most for x in r)


def test_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    want = {r["page_id"]: brute(r["html"]) for r in pq.read_table(path).to_pylist()}
    got = H.extract_text(spark.read.parquet(path)).collect()
    assert len(got) == len(want)
    # Markup may add a short line at an article's end that the plain method leaves out, and nothing else.
    others = [r for r in got if r.text != want[r.page_id]]
    assert len(others) <= 0.01 * len(got) and all(want[r.page_id] in r.text and len(r.text) - len(want[r.page_id]) < 100 for r in others)
    assert all(r.n_chars == len(r.text) for r in got)


def test_markup_only_weighs():
    body = "".join(prose(300, f"n{k}") for k in range(6))
    nav, foot = "<nav><a href=a>Home</a></nav>", "<footer>f</footer>"
    words = lambda x: [y for y in (" ".join(z.split()) for z in re.split(r"<[^>]*>", x)) if y]
    # The same text with and without markup; an article that holds a teaser only; an article beside a short notice.
    assert H.main_text(f"{nav}<article>{body}</article>{foot}") == H.main_text(f"{nav}<div>{body}</div>{foot}") == "\n".join(words(body))
    assert H.main_text(f"{nav}<article><p>Short teaser of it.</p></article><div>{body}</div>{foot}").split("\n")[-6:] == words(body)
    assert "unmarked" not in H.main_text(f"{nav}<p>{'unmarked notice ' * 9}</p><article>{body}</article><p>{'unmarked notice ' * 9}</p>{foot}")
    # Short lines at an article's ends belong to it; without markup they are no part of the surge.
    tail = "<ul>" + "<li>one</li>" * 6 + "</ul>"
    assert H.main_text(f"{nav}<article>{body}{tail}</article>{foot}").endswith("one\none\none\none\none\none")


def test_wrappers_dont_empty_a_page():
    body = "".join(prose(200, f"n{k}") for k in range(4))
    want = H.main_text(body)
    assert want.count("\n") == 3
    for page in (
        f"<body><form id=aspnetForm><article>{body}</article></form>", f"<form><div>{body}</div></form>", f"<div class='site has-sidebar'><article>{body}</article></div>", f"<div class='entry no-comments'>{body}</div>",
        f"<div class='sidebar'><article>{body}</article></div>", f"<form><nav>{'<p>menu entry</p>' * 5}</nav><article>{body}</article><div class=sidebar>{prose(90, 's')}</div></form>", f"<div class=widget>{body}</div>",
    ):
        assert H.main_text(page) == want, page[:60]
    assert H.main_text(f"<article>{body}</article><div class=ad>Buy this</div><article>{prose(200, 'second')}</article>").count("\n") == 4
    assert H.main_text("<article><div class='entry-header'><h1>Head of it</h1></div><p>Text of it.</p></article>") == "Head of it\nText of it."
    comments = "<ol class='comment-list'>" + f"<li><article class='comment-body'>{prose(400, 'c')}</article></li>" * 9 + "</ol>"
    assert H.main_text(f"<article>{body}</article>{comments}") == want


def test_time_grows_with_the_page_only():
    began = time.time()
    n = 100_000
    H.main_text("<span>x" * n)
    H.main_text("<div>" * n + "<p>a" * n + "<a>b" * n + "</b>" * n)
    H.main_text("<div class='comments'>" * n + "x")
    H.main_text("<article><div hidden>" * n + "x")
    assert time.time() - began < 20


def test_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "y"), (1, "u", "<p>x</p>", "y")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in H.extract_text(pages).collect()] == [(1, "u", "x", 1)] * 2
    with pytest.raises(ValueError, match="text"):
        H.extract_text(pages, keep=("page_id", "text"))


def test_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in H.extract_text(pages).collect()} == {(1, None, "", 0), (None, "u", "x", 1)}
    assert H.extract_text(pages.limit(0)).count() == 0


def prose(n, mark):
    return f"<p>{(mark + ' word' * n)[: n - 1]}.</p>"


def test_all_prose_between_furniture_stays():
    short = "<h2>" + "h" * 20 + "</h2>" + prose(90, "a") + prose(100, "b")
    bodies = {
        "long paragraph": [prose(300, f"n{k}") for k in range(3)] + [prose(10000, "big")] + [prose(300, f"m{k}") for k in range(3)],
        "short lines": [prose(900, f"n{k}") for k in range(6)] + [short] + [prose(900, f"m{k}") for k in range(8)],
        "list": [prose(900, "n")] * 3 + ["<ul>" + "<li>one</li>" * 5 + "</ul>"] + [prose(900, "m")] * 3,
    }
    for name, body in bodies.items():
        page = f"<div class=nav><a href=a>Home</a></div><div>{''.join(body)}</div><div class=footer>c</div><div>tail</div>"
        want = [" ".join(x.split()) for x in re.split(r"<[^>]*>", "".join(body)) if x.strip()]
        assert H.main_text(page).split("\n") == want, name


def test_furniture_names_are_whole_classes():
    body = "".join(prose(200, f"n{k}") for k in range(4))
    for wrapper in ("has-sidebar", "no-comments content", "post tags", "search-engine-history", "entry-content related"):
        assert H.main_text(f"<div class='{wrapper}'>{body}</div>").count("\n") == 3, wrapper
    assert H.main_text(f"<header class='entry-header'><h1>Head of it</h1></header>{body}").startswith("Head of it\n")
    assert H.main_text(f"<article><div class='article-header'><h1>Head of it</h1></div>{body}</article>").startswith("Head of it\n")
    for furniture in ("site-footer", "main-nav", "share-box", "comment-list", "cookie-notice", "x sidebar"):
        assert "menu entry" not in H.main_text(f"<div>{body}</div><div class='{furniture}'>{'menu entry ' * 20}</div>"), furniture
