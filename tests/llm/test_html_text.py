"""Main text of pages, templates found by recurrence, and all test pages against a slow reader of another make."""

import time
from html.parser import HTMLParser

import pytest

from logsense.llm.html_text import Page, main_text, site_templates, with_templates


def text(html):
    return Page(html).text(set())


def test_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>One <b>two</b>\n three&nbsp;four<br>five</p><p>unclosed<p>next<ul><li>a<li>b</ul>
<aside>side</aside><form><p>mail</p></form><div class="cookie-notice">ok?</div><script>var x="</p>";</script>
<section class="comments"><article><p>reader</p></article></section><p>last &lt;end&gt;</p></article>
<div id="sidebar"><p>s</p></div><footer>&copy; f</footer></body></html>"""
    assert text(page) == "Title & more\nOne two three four five\nunclosed\nnext\na\nb\nlast <end>"


def test_odd_pages():
    assert text("") == "" and text("just text") == "just text"
    assert text("<p>a</p><div><p>b</p>c</div>") == "a\nb\nc"
    assert text("<article><p>cut &am") == "cut &am"
    assert text("<article><p>cut <b cla") == "cut"
    assert text("<article><p>1 < 2 and a<3</p></article>") == "1 < 2 and a<3"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("<article><header><h1>h</h1></header><p>x</p></article><article><p>y</p></article>") == "h\nx\ny"
    assert text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_lost_text():
    assert text("<article><p>a</p><svg/><p>b</p><math /><p>c</p></article>") == "a\nb\nc"
    assert text("<article><p>a <svg><title>t</title><text>no</text></svg> b</p></article>") == "a b"
    assert text("<!-- <article> --><script>'<article>'</script><main><p>x</p></main>") == "x"
    assert text("<script>'<main>'</script><p>x</p>") == "x"
    assert text("<article><p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> holds</p></article>") == "so E=m holds"
    kept = "".join(f'<p class="{c}">{c}</p><ul><li class="{c}">item</li></ul>' for c in ("notice", "social", "related more", "legal"))
    assert text(f"<article>{kept}</article>") == "notice\nitem\nsocial\nitem\nrelated more\nitem\nlegal\nitem"
    assert text('<article><p>own</p></article><article class="teaser"><p>other</p></article>') == "own"
    assert text('<article class="ad"><p>own</p></article>') == "own"
    assert text("<template><p>no</p></template><object>no</object><p>yes</p>") == "yes"


def test_deep_nesting():
    took = []
    for n in (4000, 16000):
        begun = time.perf_counter()
        assert text("<div>" * n + "x" + "</div></b></p>" * n) == "x" and text("<article>" + "<div class=share>" * n + "x") == "x"
        took.append(time.perf_counter() - begun)
    assert took[1] < 10 * took[0]


class Reader(HTMLParser):
    """Blocks of the first kind of article that a page has, by events of the standard library's parser."""

    SKIP = {"nav", "footer", "aside", "form", "script", "style", "head", "header"}
    BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "html", "body"} | SKIP

    def __init__(self, html):
        super().__init__()
        self.main, self.skip, self.now, self.blocks = 0, [], [], []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if s := " ".join("".join(self.now).split()):
            self.blocks.append(s)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        self.main += tag == "article"
        words = f"{dict(attrs).get('class') or ''} {dict(attrs).get('id') or ''}".split()
        if tag in self.SKIP or tag == "div" and {"ad", "comments", "cookie", "sidebar"} & set(words):
            self.skip.append(tag)
        elif tag in self.skip:
            self.skip.append(tag)
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        self.main -= tag == "article"
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if self.main and not self.skip:
            self.now.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_pages_against_a_slow_reader(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r.page_id: "\n".join(Reader(r.html or "").blocks) for r in pages.collect()}
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert got == want and any(want.values())


def test_site_templates(spark):
    def html(k, host):
        own = f"<div><p>promo of {host}</p></div>" if host == "h" else ""
        return f"<body><div><p>Top {host}</p></div><article><p>shared passage</p>{own}<p>own {k}</p></article></body>"

    rows = [(k, f"http://{h}/p{k}", html(k, h), "x") for h in ("h", "few") for k in range(8 if h == "h" else 2)]
    rows += [(100, None, None, "x"), (101, "", "", "x"), (0, "http://h/p0", html(0, "h"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r.host for r in site_templates(pages).collect()] == ["h"]
    out = main_text(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "" if r.page_id > 99 else f"shared passage\nown {r.page_id}" if "//h/" in r.url else f"shared passage\nown {r.page_id}"
        assert r.text == want and r.n_chars == len(want)
    bare = spark.createDataFrame([(k, f"http://w/{k}", f"<div><p>Menu</p></div><div><p>body {k}</p></div>") for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in main_text(bare).collect()} == {f"body {k}" for k in range(9)}
    assert main_text(pages.limit(0)).count() == 0


def test_templates_too_many_to_broadcast(spark):
    rows = [(k, f"http://h{k % 2}/{k}", f"<div><p>Menu {k % 2}</p></div><div><p>body {k}</p></div>") for k in range(30)]
    rows += [(None, None, "<p>x</p>"), (99, "http://other/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = site_templates(pages)
    columns = ["page_id", "url", "html", "templates"]
    few, many = (sorted(with_templates(pages, known, most).select(columns).collect(), key=str) for most in (1 << 20, 0))
    assert few == many and len(few) == len(rows)
    assert sum(r.templates is not None for r in few) == 30


def test_templates_of_large_hosts_and_copies(spark):
    def page(k, menu, body):
        return (k, f"http://big/{k}", f"<body><div>{menu}</div><p>{body}</p><p>more of it, so that it is longer</p></body>")

    rows = [page(k, f"section {k // 5}", f"own {k}") for k in range(100)]
    rows += [page(k, "a box of this page's own", "copied page") for k in range(100, 110)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in main_text(pages).collect():
        want = f"own {r.page_id}" if r.page_id < 100 else "a box of this page's own\ncopied page"
        assert r.text == want + "\nmore of it, so that it is longer"


def test_templates_that_fill_a_page(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(9)) + "</ul>"
    copied = f"<div><p>{'The article that was copied. ' * 9}</p></div>"
    rows = [(k, f"<body>{menu}<p>{'long ' * 99}{k}</p></body>") for k in range(3)]
    rows += [(k, f"<body>{menu}<p>stub {k}</p></body>") for k in range(3, 6)] + [(6, f"<body><h1>only a title</h1>{menu}</body>")]
    rows += [(k, f"<article><h1>Title {k}</h1>{copied}</article>") for k in range(10, 16)]
    pages = spark.createDataFrame([(k, f"http://h/{k}", html) for k, html in rows], "page_id long, url string, html string")
    for r in main_text(pages).collect():
        if r.page_id == 6:
            assert r.text == "only a title"
        elif r.page_id < 6:
            assert r.text == (f"{'long ' * 99}{r.page_id}" if r.page_id < 3 else f"stub {r.page_id}")
        else:
            assert r.text == f"Title {r.page_id}\n" + ("The article that was copied. " * 9).strip()


def test_ambiguous_marks_inside_the_article(spark):
    def page(k):
        return (
            f'<body><div class="search"><p>find</p></div><article><header class="entry-header"><h1>Title {k}</h1></header><section id="legal-history"><p>law {k}</p></section>'
            f'<p id="search-trees">trees {k}</p><div class="section-header"><h2>Part {k}</h2></div><div class="share"><a href="/to?{k}">Share this</a></div>'
            f'<p class="notice">All rights kept</p><div role="search"><p>find {k}</p></div><div class="ad">Buy {k}</div></article></body>'
        )

    own = "Title {0}\nlaw {0}\ntrees {0}\nPart {0}"
    assert text(page(1)) == own.format(1) + "\nShare this\nAll rights kept"
    pages = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(5)], "page_id long, url string, html string")
    assert {r.text for r in main_text(pages).collect()} == {own.format(k) for k in range(5)}
