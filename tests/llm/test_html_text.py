import math
import re
import time

from pyspark.sql import functions as F

from concordia.llm import html_extract as m

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="page">
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad-banner">Buy <b>now</b></div><div id="cookie-notice"><p>Cookies</p></div>
<article><h1>A &amp; B</h1><p>One <b>bold
 text</b>&nbsp;here<br>and more<p>Two &lt;tags&gt;<ul><li>x<li>y</ul><form><input name=q><button>Go</button></form>
<aside>side</aside><table><tr><td>c1<td>c2</table><!-- <p>no</p> --><img src="a>b.png" alt="x>y"><p title="a > b">Three</p></article>
<section class="comments"><article><p>Reader says</p></article></section><footer>&copy; us</footer></body></html>"""


def text(source, low=frozenset()):
    return m.Page(source).text(low)


def test_article_only():
    assert text(PAGE) == "A & B\nOne bold text here and more\nTwo <tags>\nx\ny\nc1\nc2\nThree"


def test_broken_markup():
    assert text("") == ""
    assert text("plain & simple") == "plain & simple"
    assert text("<article><p>cut off in a <b") == "cut off in a"
    assert text("<article><p>a &amp b &am") == "a & b &am"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("</div></p><p>x</span></article>y") == "x\ny"
    assert text("<script>if (a < b) { '<p>' }") == ""
    assert text('<p>a<a href="x>y') == "ay"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_words_of_layout():
    assert text('<div class="has-sidebar"><div class="sidebar">Links</div><article><p>Kept</p></article></div>') == "Kept"
    assert text('<div class="comments"><article><p>Reader</p></article></div><article><p>Kept</p><div class="notice">No</div></article>') == "Kept"
    assert text('<div id="cookieNotice">No</div><p>Kept</p><div role="complementary">No</div><p>a <span class="ad">No</span> b</p>') == "Kept\na b"


def test_site_tree_removes_what_repeats(spark):
    rows = [(i, f"https://www.h.example/{i}", f"<div class=a><div class=top>Same on all pages</div><div class=body><p>Own text {i}</p></div><p class=end>Same end</p></div>") for i in range(8)]
    rows += [(100, "http://h.example:80/x", "<div class=a><div class=top>Same on all pages</div><div class=body><p>Port</p></div></div>"), (101, "http://other.example/", "<div class=a><div class=top>Same on all pages</div></div>")]
    got = {r["page_id"]: r["text"] for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(8))
    assert got[100] == "Port"
    assert got[101] == "Same on all pages"
    by = {r["importance"] for r in m.importance(spark.createDataFrame(rows[:8], "page_id long, url string, html string")).collect()}
    assert min(by) < m.LOW < 0.9 <= max(by)


def test_mixed_content_keeps_what_lies_below(spark):
    words = "river stone walk light seven garden paper open".split()
    rows = [(i, f"http://post.example/{i}", f"<body><div class=post>By admin<p>A {w} paragraph</p><ul><li>And {w} again</ul></div><p class=date>day {i}</p></body>") for i, w in enumerate(words)]
    rows += [(10 + i, f"http://bare.example/{i}", f"<html><body>Welcome<div class=top>Same on all pages</div><div class=x><p>A {w} paragraph</p></div></body></html>") for i, w in enumerate(words)]
    rows += [(20 + i, f"http://turned.example/{i}", f"<body><div class=post>A {w} story<p>Same below</p></div></body>") for i, w in enumerate(words)]
    got = {r["page_id"]: r["text"] for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, w in enumerate(words):
        assert got[i] == f"A {w} paragraph\nAnd {w} again\nday {i}"
        assert got[10 + i] == f"A {w} paragraph"
        assert got[20 + i] == f"A {w} story"


def test_groups_of_copies_count_once(spark):
    page = "<body><div class=top>Same on all pages</div><div class=text><p>{}</p></div><p class=seen>{}</p></body>"
    words = "river stone walk light seven garden paper open north quiet".split()
    copied, long = "One text that most pages of the host copy", "A long text that mirrors repeat over and over. " * 20
    rows = [(i, f"http://copied.example/{i}", page.format(copied, f"{i} views")) for i in range(190)]
    rows += [(200 + i, f"http://copied.example/own/{i}", page.format(f"Another text, of a {w}", f"{i} views")) for i, w in enumerate(words)]
    rows += [(300 + i, f"http://mirror.example/{i}", page.format(copied, f"2024-03-{i + 10} 10:00")) for i in range(9)]
    rows += [(400 + i, f"http://long.example/{i}", page.format(long, f"Gesehen von {i} Leuten")) for i in range(9)]
    rows += [(500 + i, f"http://table.example/{i}", f"<body><p class=a>Same on all pages</p><p class=b>{i} 4711 0815 {i * i} 1234567890</p></body>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"{copied}\n{i} views" for i in range(190))
    assert all(got[200 + i] == f"Another text, of a {w}\n{i} views" for i, w in enumerate(words))
    assert all(got[300 + i] == f"Same on all pages\n{copied}\n2024-03-{i + 10} 10:00" for i in range(9))
    assert all(got[400 + i] == f"Same on all pages\n{long.strip()}\nGesehen von {i} Leuten" for i in range(9))
    assert all(got[500 + i] == f"{i} 4711 0815 {i * i} 1234567890" for i in range(9))


def test_copies_and_joins_by_host(spark, monkeypatch):
    rows = [(i, "http://a.example/", "<div><p>One text on all pages</p></div>") for i in range(9)]
    rows += [(20 + i, "http://b.example/p", f"<article><p>Copy</p></article><p class=x>{i}</p>") for i in range(9)]
    rows += [(40, None, None), (41, None, ""), (42, "not a url", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {i: "One text on all pages" for i in range(9)} | {20 + i: "Copy" for i in range(9)} | {40: "", 41: "", 42: "x"}
    assert {r["page_id"]: r["text"] for r in m.extract(pages).collect()} == expected
    monkeypatch.setattr(m, "BROADCAST_NODES", -1)
    assert {r["page_id"]: r["text"] for r in m.extract(pages).collect()} == expected
    assert m.extract(pages.limit(0)).collect() == []


def test_importance_by_hand(spark):
    """Eight pages: a leaf that half of them share has entropy ln 8 - (4 ln 4) / 8, and its place never changes."""
    words = "river stone walk light seven garden paper open".split()
    rows = [(f"http://h.example/{w}", f"<body><div class=x><p class=half>{'same' if i < 4 else w}</p><p class=own>{w}</p></div><article><h2 class=sign>Sign up</h2><p>Own {w}</p></article></body>") for i, w in enumerate(words)]
    found = sorted(((r["inside"], round(r["importance"], 6)) for r in m.importance(spark.createDataFrame(rows, "url string, html string")).collect()))
    own = (math.log(8) - 4 * math.log(4) / 8) / math.log(8)
    assert found == [(False, round(0.9 * own, 6)), (False, 0.9), (True, 0.0), (True, 1.0)]


def test_the_tree_decides_in_articles(spark):
    """What a site repeats within its articles goes; names alone would keep it."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    before = {r["page_id"]: r["text"] for r in m.extract(rows).collect()}
    one_host = rows.withColumn("url", F.concat(F.lit("http://one.example/"), F.col("page_id").cast("string")))
    signed = one_host.withColumn("html", F.regexp_replace("html", "</h1>", '</h1><p class="lead">Read this on our site</p>'))
    after = {r["page_id"]: r["text"] for r in m.extract(signed).collect()}
    assert len(before) > 20 and any("Read this on our site" in m.Page(r["html"]).text(frozenset()) for r in signed.collect())
    assert after == before


def test_headers_formulas_and_drawings():
    assert text("<header>Site</header><article><header><h1>Title</h1></header><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></article>") == "Title\na x=1 b"
    assert text("<article><header class=ad>No</header><p>a<svg><g><svg><text>no</text></svg><text>no</text></g></svg> b</p><object><p>no</p><object>no</object>no</object><p>c</p></article>") == "a b\nc"
    assert text("<p>x<svg/>y</p><template><template>no</template>no</template><p>z</p>") == "xy\nz"


def test_deep_and_long_pages_clashing_names_and_repeated_rows(spark):
    deep = "<div>" * 50_000 + "<p>deep</p>" + "</div>" * 50_000
    quotes = "<blockquote><li>q" * 20_000
    long = "<article>" + "<p>word and word</p>" * 60_000 + "</article>"
    began = time.perf_counter()
    assert text(deep) == "deep"
    assert text(quotes).count("q") == 20_000
    assert text(long).count("\n") == 59_999
    assert text("<b>" * 50_000 + "x" + "</b></i>" * 50_000) == "x"
    assert len(m.Page(deep).presentations(m.Page(deep).leaves())) == 50_000
    assert time.perf_counter() - began < 30
    rows = [(1, "http://a.example/", "<p>x</p>", 7)] * 3 + [(None, None, None, None), (2, "http://a.example/2", "<p>y</p>", 8)]
    found = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in found) == [("1", "x")] * 3 + [("2", "y"), ("None", "")]


def test_tables_against_a_pattern(spark):
    import html

    folder = "/root/testdata/sf0.001"
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in m.query(spark, folder).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", sources[row["page_id"]], re.S)
        inner = re.sub(r"<[^>]*\Z", "", inner[1] if inner else "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert row["text"] == "\n".join(filter(None, blocks))
        assert row["n_chars"] == len(row["text"])
