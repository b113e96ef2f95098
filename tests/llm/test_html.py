import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import html_text as h


def text(page):
    return "\n".join(t for t, _ in h.blocks(page))


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>menu</a></ul></nav><div class="ad">buy</div>
    <div id="cookie-notice">cookies</div><main><article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>two</b><br>three&nbsp;four<p>Five &#233;<aside>see also</aside>
    <ul><li>a<li>b</ul><form><p>mail</p></form><script>if (a < b) { "</p>" }</script><footer>tags</footer></article><section id="comments"><article class="comment"><p>nice</p></article></section></main><footer>&copy;</footer></body></html>"""
    assert text(page) == "Head & line\nOne two three four\nFive é\na\nb"


def test_broken_pages():
    assert text("") == "" and text("<") == "<" and text("a < b &lt;c&gt;") == "a < b <c>"
    assert text("<article><p>kept</article") == "kept"
    assert text("<article><p>kept &am") == "kept &am"
    assert text("<p>one<div>two</p>three") == "one\ntwo\nthree"
    assert text("<!-- <p>no</p> --><p>yes<!-- open") == "yes"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<div>" * 900 + "<p>in</p>" + "</div>" * 900 + "<article>the rest</article>") == "the rest"  # depth closes nothing
    assert text("<article>" + "<div>" * 900 + "<p>in</p>" + "</div>" * 899 + "<nav>menu</nav></div><p>out</p></article><p>behind</p>") == "in\nout"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab <>&;é\n\t\"'/=-!", max_size=12), max_size=8))
def test_escaped_paragraphs_come_back(parts):
    page = "<body><article>" + "".join(f"<p>{html.escape(p)}</p>" for p in parts) + "</article></body>"
    assert text(page) == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pdivbr !-=\"'a&;\n", max_size=80))
def test_no_page_is_an_error(page):
    h.blocks(page)
    h.template_keys(page)


def test_templates_go_by_count(spark):
    body = '<body><div class="intro"><p>Welcome to our site</p></div><p>Story number {0}</p><article><div><p>Follow the author</p></div><p>Shared line</p><p>Own {0} and what it says of it at length</p></article></body>'
    loose = '<body><div class="intro"><p>Welcome to our site</p></div><p>Story number {0}, which goes on and on</p><div>tail</div></body>'
    rows = [(i, f"http://a.org/{i}", (body if i % 2 else loose).format(i)) for i in range(40)] + [(100, "http://b.org/1", loose.format(1)), (101, None, None), (102, "http://a.org/x", "")]
    out = {r.page_id: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert out[1].text == "Shared line\nOwn 1 and what it says of it at length"  # the box recurs on the host, the plain line stays
    assert out[2].text == "Story number 2, which goes on and on"
    assert out[100].text == "Welcome to our site\nStory number 1, which goes on and on\ntail"  # one page shows no template
    assert out[101].text == out[102].text == "" and out[101].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in out.values())


def neutral(i, story, n=12):
    """A page whose chrome is in plain elements with neutral names; menus and adverts rotate."""
    menu = "".join(f'<div class="x1"><a href="/{k}">part {k} of {i % 4}</a></div>' for k in range(6))
    return f'<body><div class="c7"><div class="x0">{menu}</div><div class="x2"><p>Buy thing {i % 3} now</p></div><div class="c8"><p>{story} begins</p><p>{story} goes on and on {"and on " * n}</p></div><div class="x3"><p>all rights kept</p></div></div></body>'


def test_counts_decide_where_markup_says_nothing(spark):
    rows = [(i, f"http://n.org/{i}", neutral(i, f"story {i}")) for i in range(60)]
    rows += [(100 + i, f"http://n.org/copy{i}", neutral(1, "copied story")) for i in range(20)]  # exact copies: no template of their own
    rows += [(200 + i, f"http://few.org/{i}", neutral(i, f"tale {i}")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = lambda s: f"{s} begins\n{s} goes on and on {'and on ' * 12}".strip()
    out = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert all(out[i] == want(f"story {i}") for i in range(60))
    assert all(out[100 + i] == want("copied story") for i in range(20))
    assert all("all rights kept" in out[200 + i] for i in range(3))  # too few pages to count
    off = {r.page_id: r.text for r in h.extract(pages, least_pages=10**9).collect()}
    assert all(off[i] != out[i] and "Buy thing" in off[i] for i in [*range(60), *range(100, 120)])


def test_pages_made_of_shared_parts_keep_their_text(spark):
    part = "<div><p>part {} with some words</p></div>"
    rows = [(i, f"http://s.org/{i}", "<body>" + "".join(part.format((i + k) % 6) for k in range(3)) + "</body>") for i in range(30)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.count("part") == 3 for r in out)


def test_comments_and_neighbours():
    assert text('<article><p>one</p><article><p>a comment</p></article><div role="comment">c</div><div itemprop="comment">d</div></article>') == "one"
    assert text("<main><article><p>one long text</p></article><article><p>two</p></article><section><article>said</article></section></main>") == "one long text\ntwo"


def test_real_pages_against_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\n", inner.replace("<br>", " ")))
        want[r.page_id] = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in inner.split("\n")) if x)
    assert {r.page_id: r.text for r in h.extract(pages).collect()} == want
    assert h.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "1 AS host", "2 AS text", "3 AS k").union(pages.selectExpr("*", "1", "2", "3").limit(2))
    assert h.extract(clash).count() == pages.count() + 2
