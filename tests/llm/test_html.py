import html as std
import itertools
import random
import re
import time

import pytest

from eventloom.llm import html

PLAIN = html.PRIOR
PROSE = "This is prose of an article that goes on for a while, with commas, and with full stops. " * 5
PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var t="</p>";</script><style>p{}</style></head><body class="no-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="x">Home</a><li><a>About us</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Title &eacute;</h1><p>First   para&nbsp;with <b>bold</b> te<i>xt</i>.<p>Second, unclosed &lt;b&gt; &#x41; line<br>break.<div class="ad">Buy now!</div><ul><li>item one<li>item two</ul><blockquote>Quote here.</blockquote></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, I liked it very much, thanks.</p></div></section></main><aside><p>Related stuff</p></aside><form><label>Search</label><input></form><footer>&copy; 2024</footer></body></html>"""


def test_minimum_cut():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        ties = [(i, i + 1, r.uniform(0, 2)) for i in range(n - 1)] + [(*sorted(r.sample(range(n), 2)), r.uniform(0, 1)) for _ in range(n if n > 1 else 0)]
        cost = lambda x: sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, x, strict=True)) + sum(w for a, b, w in ties if x[a] != x[b])  # noqa: B023, E731
        assert abs(cost(html.minimum_cut(scores, ties)) - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-9


def test_article_without_the_rest():
    assert html.main_text(PAGE, PLAIN) == "Title é\nFirst para with bold text.\nSecond, unclosed <b> A line break.\nitem one\nitem two\nQuote here."


def test_articles_of_other_kinds():
    page = """<body><form id="aspnet"><header>Site</header><article class="post has-comments"><header class="entry-header"><h1 class="entry-title">A title</h1></header><p>The text of it, which is here.</p>
    <form><p>Your e-mail</p></form><aside>More like this</aside><section><article class="comment"><p>I liked the text of it, really, a lot.</p></article></section><footer>Filed under x</footer></article></form></body>"""
    assert html.main_text(page, PLAIN) == "A title\nThe text of it, which is here."


@pytest.mark.parametrize("page", [None, "", "<p", "<", "&", "<!-- never closed", "<script>x", '<a href="x', "</p></div>", "<html><body></body></html>"])
def test_nothing_to_extract(page):
    assert html.main_text(page, PLAIN) == ""


@pytest.fixture(scope="module")
def weights(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    ['<article><section id="discussion">%s</section></article>', '<article><div class="follow-up">%s</div></article>', '<article><div class="related-work">%s</div></article>', '<div id="main-content" class="alert-levels">%s</div>', '<form><div class="content">%s</div></form>'],
)
def test_no_word_loses_an_article(page, weights):
    assert html.main_text(page % PROSE, weights) == PROSE.strip()


@pytest.mark.parametrize("place", ["<nav>%s</nav>", "<aside><p>%s</p></aside>", '<div class="cookie-notice"><p>%s</p></div>', '<div class="ad">%s</div>', '<section id="comments"><div class="comment"><p>%s</p></div></section>', '<div class="sidebar"><p>%s</p></div>', "<footer>%s</footer>"])
def test_long_boilerplate_goes(place, weights):
    long = "I have read this all with great interest, and I must say, it is quite good. " * 6
    for page in (f"<article><p>{PROSE}</p>{place % long}<p>{PROSE}</p></article>", f"<article><p>{PROSE}</p><p>{PROSE}</p></article>{place % long}"):
        assert html.main_text(page, weights) == f"{PROSE.strip()}\n{PROSE.strip()}"


def test_the_cut_mends_what_the_classifier_gets_wrong(spark, weights):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 5 = 0").collect()

    def wrong(tags):
        """Blocks, labels that the cut changes, and wrong labels with and without it, on pages whose tags are made div."""
        bare, n, flips, cut, alone = re.compile(rf"<(/?)({tags})>"), 0, 0, 0, 0
        for p in pages:
            told = {b.text for b in html.blocks(p["html"]) if b.bits & html.CONTENT}
            found = html.blocks(bare.sub(r"<\1div>", p["html"]))
            scores = html.scores(found, weights)
            keep = html.minimum_cut(scores, html.edges(found))
            n += len(found)
            flips += sum((x > 0) != k for x, k in zip(scores, keep, strict=True))
            cut += sum((b.text in told) != k for b, k in zip(found, keep, strict=True))
            alone += sum((b.text in told) != (x > 0) for b, x in zip(found, scores, strict=True))
        return n, flips, cut, alone

    n, flips, cut, alone = wrong("article|nav|footer")
    assert flips > 0 and cut < alone and cut < 0.01 * n
    n, flips, cut, alone = wrong("article|nav|footer|p|h1|ul|li")
    assert flips > 0 and cut < 0.05 * n


def test_what_tags_tell_is_not_fitted(weights):
    assert [w for w, x in zip(weights, html.PLACES, strict=False) if x in ("content", "boilerplate", "outside")] == [3.0, -7.0, -3.0]
    assert weights != html.PRIOR


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "<p>x y z." * 40_000, "<b>" * 20_000 + "<p>x</p>" * 20_000 + "</i>" * 20_000, '<a "' * 20_000 + "<!--" * 1000 + "<" * 10_000, "<i>" * 40_000 + "<b>" * 40_000 + "x" + "</i>" * 40_000, "<li><ul>" + "<div>" * 20_000 + "<li>a</li>x" * 20_000],
)
def test_work_is_linear(page):
    began = time.process_time()
    html.main_text(page, PLAIN)
    assert time.process_time() - began < 6


def test_divs_only(weights):
    first, second = "Long text without any structure, but with commas, and full stops. It goes on and on for a while, as text does.", "More of such text, in another block, which is also quite long, and has two sentences. Yes, two of them."
    page = f"<div><div><a href=x>Home</a> <a href=y>Blog</a> <a href=z>Contact</a></div><div>{first}</div><div>{second}</div></div>"
    assert html.main_text(page, weights) == f"{first}\n{second}"


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r for r in html.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", PAGE), (2, "u", PAGE), (3, "u", "<article><p>" + "long text " * 100_000)], "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    got = html.extract(rows, html.train(rows)).collect()
    assert len(got) == 5 and max(r["n_chars"] for r in got) == 999_999
    none = rows.where("false")
    assert html.extract(none, html.train(none)).collect() == []
