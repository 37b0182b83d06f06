import html
import re

import duckdb
from helpers import awkward

from lattica.llm import html_text as X
from lattica.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body class="article">
<header><a href=/>Home</a> <a href=/b>About us</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for you and others</div><!-- <p>hidden</p> -->
<main><h1>A   title &amp; more</h1><p>First paragraph with <b>bold</b> and <a href="x>y">a link</a>, long enough to look like running text.
<p>Second&nbsp;one: caf&eacute; &#x263A; &lt;tag&gt;, also with a good number of words in it to be sure.</p><aside>Read this too: ten more words that do not belong here</aside>
<form><label>Mail</label><input><button>Send it now</button></form><p>Short end.</p></main>
<div id="comments"><p>I am a reader and I have an opinion that nobody asked for, at length.</p></div>
<div class='sidebar'><p>Popular things of this week that you could read as well, if you like</p></div><footer>&copy; all of us</footer>"""


def test_page():
    want = "A title & more First paragraph with bold and a link, long enough to look like running text. Second one: café ☺ <tag>, also with a good number of words in it to be sure. Short end."
    assert X.main_text(PAGE) == want


def test_tree_knows_its_table():
    x = X.np.vstack([X.features([r[:5] for r in page]) for page in X.LABELLED])
    y = X.np.array([r[5] for page in X.LABELLED for r in page])
    assert (X.trained_tree().predict(x) == y).mean() > 0.97


def test_tree_on_pages_left_out():
    right = total = 0
    for k, page in enumerate(X.LABELLED):
        rest = [p for j, p in enumerate(X.LABELLED) if j != k]
        tree = X.grow(X.np.vstack([X.features([r[:5] for r in p]) for p in rest]), X.np.array([r[5] for p in rest for r in p]))
        right += (tree.predict(X.features([r[:5] for r in page])) == X.np.array([r[5] for r in page])).sum()
        total += len(page)
    assert right / total > 0.8


def test_broken_pages():
    assert X.main_text("") == ""
    assert X.main_text("<!-- open") == X.main_text("<script>x") == X.main_text("<p") == ""
    assert X.main_text("just text with a < b and a few words more than that") == "just text with a < b and a few words more than that"
    assert len(X.main_text("<article>" + "<p>word word word word word word</p>" * 20_000)) == 20_000 * 30 - 1


def test_articles_of_the_table():
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for page in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", " ", re.sub("</?b>", "", body)))).strip()
        assert X.main_text(page) == want


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)], "page_id long, url string, html string").selectExpr("*", "9 AS text", "8 AS n_chars")
    out = X.extract_text(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in out) == [(0, "v", 0), (1, "u", len(X.main_text(PAGE))), (1, "u", len(X.main_text(PAGE))), (2, "", 0)]
    assert X.extract_text(df.where("false")).count() == 0
    clash = awkward(spark).selectExpr('doc_id AS page_id', 'source AS url', 'text AS html', '*')
    got = sorted(((r.page_id, r.n_chars, r.text) for r in X.extract_text(clash).collect()), key=repr)
    want = [(r.page_id, X.main_text(r.html or '')) for r in clash.collect()]
    assert got == sorted(((i, len(t), t) for i, t in want), key=repr)


def test_class_words_do_not_hide_the_article():
    one = "This is the first paragraph of a fine article about rivers and lakes, long enough to count."
    two = "And here is a second paragraph with some more words that belong to the same story."
    body = f"<p>{one}</p><p>{two}</p>"
    for tag in ("article class='post notice'", "article class='social-post'", "article id='side-effects'", "main class=search role=complementary", "div class='social-post'", "section id=legal-news"):
        for around in ("{}", "<nav><a href=1>One</a> <a href=2>Two</a></nav>{}<footer>All of us</footer>"):
            assert X.main_text(around.format(f"<{tag}>{body}</{tag.split()[0]}>")) == f"{one} {two}", tag
    # Telling elements beside or within an article still go.
    for extra in ("<div class='share'>Share this on all networks now</div>", "<div class=comments><p>I am a reader and I have an opinion that nobody asked for.</p></div>"):
        assert X.main_text(f"<article>{body}{extra}</article>") == X.main_text(f"<article>{body}</article>{extra}") == f"{one} {two}"


def test_short_article_beside_long_notices():
    notice = "<div class='ad'>Seven words of an advert that is longer than the article.</div>"
    for page in (f"{notice}<article><h1>Oh.</h1><p>Well, no.</p></article>", f"<nav><a href=1>One</a></nav>{notice * 3}<main>Oh.<br>Well, no.</main>{notice}"):
        assert X.main_text(page) == "Oh. Well, no."


def test_neighbours_decide_on_links():
    one, two = ("These are the words of a paragraph in the article, more than a line of them." for _ in range(2))
    link = "<p><a href=x>See the long list of rivers in the linked article about rivers</a> for more</p>"
    assert "long list" in X.main_text(f"<article><p>{one}</p>{link}<p>{two}</p></article>")
    crumbs = "<p><a href=1>Home</a></p><p><a href=2>News</a></p>"
    assert X.main_text(f"<main>{crumbs}<p>{one * 3}</p><p><a href=3>Share</a></p><p>{two * 3}</p></main>") == f"{one * 3} {two * 3}"
    menu = "<div>" + "".join(f"<a href={k}>entry {k}</a> " for k in range(12)) + "</div>"
    assert X.main_text(f"{menu}<div>{one}</div><div>{two}</div>{menu}") == f"{one} {two}"


def test_query_against_another_extractor(spark):
    """The registered query on a whole table, against articles cut out by their tags."""
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in queries.op3_html_text(spark, sf).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, url, page in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", " ", re.sub("</?b>", "", body)))).strip()
        assert (rows[page_id].url, rows[page_id].text, rows[page_id].n_chars) == (url, want, len(want))


def test_missing_end_tags():
    words = "These are the words of an article that nobody should lose."
    article = f"<article><p>{words}</p></article>"
    for start in (
        "<head><title>T</title><body>", "<head><title>T</title>", "<svg/>", "<iframe src='x' />", "<object/>", "<script src='x'/>", "<button>Send", "<noscript>", "<svg><g>", "<p><button>Send</p>",
        "<select><option>A<option>B", "<datalist><option>A<option>B</datalist>", "<b><svg></b>", "<button-group>", "<option-list>", "<svg_icon>", "<title-bar>",
        "<button>A<button>B</button>", "<script src=/a/>no();</script>", "<noscript><p>no</p></noscript>", "<template><div>no</div></template>", "<select><option>no</select>", "<button><div>no</div></button>",
    ):
        for page in (start + article, f"<div>{start}</div>{article}", f"{start}{article}<svg><title>x</title></svg><button>y</button>"):
            assert X.main_text(page) == words, page
    assert X.main_text(f"<article><p>{words} <button>Send<p>{words}<b><object></b> {words}<script>no</article>") == f"{words} {words} {words}"
    assert X.main_text(f"<article><p>{words} <button><div>Send</div></button> {words}</article>") == f"{words} {words}"
