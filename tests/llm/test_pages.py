"""HTML extraction and URL filters."""

import html.parser
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from polybag.llm import op1_html, op2_url_filters

PAGES = "page_id bigint, url string, html string, text string, host string, rule string"


@pytest.fixture(scope="module")
def tree(spark):
    return op1_html.fit_tree(spark)


def test_tree_fits_its_table(tree):
    assert all(tree.predict(tuple(map(float, r[:-1]))) == bool(r[-1]) for r in op1_html.LABELLED)


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style>
<script>var t="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li></ul></nav><!-- <p>ad</p> -->
<div class="ad">Buy this now and save a lot of money today.</div>
<article><h1>The  title</h1><p><b>First line.<br><p>A &amp; B&nbsp;&#x41;
and <a href="x">a link</a> c.</p><p>Ok.</p><aside>See also other stories</aside>
<form><label>Mail</label><p>Sign up for our letter, it is good</p></form>
<section id="comments"><article class="comment"><p>I do not agree with any of this at all.</p>
</article></section></article><div id="side-bar" class="sidebar"><p>Some words in the side</p></div>
<footer>&copy; us</footer>"""


def test_main_text(tree):
    assert op1_html.main_text(PAGE, tree) == "The title\nFirst line.\nA & B A and a link c.\nOk."


def test_pages_without_marks(tree):
    words = " ".join(["word"] * 40)
    page = (f"<body><div><a>one</a> <a>two</a></div><div>{words}</div><div>{words}</div>"
            f"<ul><li><a>x</a></li><li><a>y</a></li></ul></body>")
    assert op1_html.main_text(page, tree) == f"{words}\n{words}"


@pytest.mark.parametrize("page", [
    None, "", "   ", "<", "<p", "</p></div>", "<script>x", "<!-- x", "<a href='>'", "&#0;&bogus;"])
def test_odd_pages(tree, page):
    assert isinstance(op1_html.main_text(page, tree), str)


@pytest.mark.parametrize("icon, text", [
    ('<svg width="8"/>', "One two\nThree"), ("<math />", "One two\nThree"), ("<svg><path/></svg>", "One two\nThree"),
    ("<object data='x'/>", "One two\nThree"), ("<SVG width='8'>", "One two\nThree"),
    ('<svg-icon name="x"></svg-icon>', "One two\nThree"), ('<img alt="5" screen">', "One two\nThree"),
    ('<img alt="a > b">', "One two\nThree"), ("<b title='x>", "One two\nThree"), ("<!-- a > b -->", "One two\nThree"),
    ("<!-- x > y", "One"), ("<script>x", "One")])
def test_odd_elements_do_not_swallow_the_page(tree, icon, text):
    page = f"<article><p>One {icon} two</p><p>Three</p></article>"
    assert op1_html.main_text(page, tree) == text


def test_icons_of_a_tag_that_begins_like_a_raw_one(tree):
    page = 'One <svg-icon name="x"></svg-icon> two<p>Three<p><svg><path/></svg>Four'
    assert op1_html.main_text(page, tree) == "One two\nThree\nFour"


def blocks_of(page):
    return [(b.text, b.linked / b.words) for b in op1_html.flat_blocks(page)]


def test_implied_ends_and_links():
    assert blocks_of('<ul><li class="share">Tell us<li>One<li>Two <ul><li>Inner</ul></ul>') == [
        ("One", 0), ("Two", 0), ("Inner", 0)]
    assert blocks_of('<table><tr><td id="ad">Buy<td>Cell<tr><td>Next</table>') == [("Cell", 0), ("Next", 0)]
    assert blocks_of('<dl><dt class="menu">No<dd>Yes</dl>') == [("Yes", 0)]
    assert blocks_of("<a href=x><div>In a link</div></a><div>After it</div>") == [("In a link", 1), ("After it", 0)]
    assert blocks_of("<div><a>open <p>still</p></div><p>past it</p>") == [("open", 1), ("still", 1), ("past it", 0)]
    assert blocks_of("<p>a <a>b</a> c <a>d <a>e</a> f</p>") == [("a b c d e f", 0.5)]
    assert blocks_of("</div></p>x<p>y</section>z") == [("x", 0), ("y", 0), ("z", 0)]


TEXT = "It was a long day and nobody in the small town had thought that anything of the kind could happen."


def test_words_and_links_decide(tree):
    """On pages without any mark the same places turn with their words and links."""
    def page(block, before=f"<p>{TEXT}</p>", after=f"<p>{TEXT}</p>"):
        return f"<div>{before}</div><div>{block}</div><div>{after}</div>"

    links = "".join(f"<p><a>{w} {w}</a></p>" for w in ("news", "sport"))
    assert "A short line" in op1_html.main_text(page("A short line"), tree)
    assert "A short line" not in op1_html.main_text(page("<a>A short line</a>"), tree)
    assert "A short line" not in op1_html.main_text(page("A short line", links, links), tree)
    assert TEXT.upper() in op1_html.main_text(page(TEXT.upper(), links, links), tree)
    assert op1_html.main_text(page(f"<a>{TEXT}</a>"), tree) == f"{TEXT}\n{TEXT}"
    assert op1_html.main_text(links, tree) == ""
    # The tree holds words and links alone, and uses both.
    used = {op1_html.FEATURES[f] for f, *_ in tree.nodes if f >= 0}
    assert {f.split("_")[0] for f in used} == {"words", "links"}


class Article(html.parser.HTMLParser):
    """The texts of the blocks inside ``article`` of a well-formed page, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.text = 0, [], ""

    def cut(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag not in op1_html.INLINE:
            self.cut()
        self.depth += tag == "article"
        self.text += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag not in op1_html.INLINE:
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.text += data


def test_articles_of_the_test_pages_against_another_parser(spark, sf_dir, tree):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    checked = 0
    for page in pages:
        if page.html and re.search("<article>.*</article>", page.html, re.S) and not re.search(
                r"<article>.*(<aside|<form|<nav|class=|id=).*</article>", page.html, re.S):
            parser = Article()
            parser.feed(page.html)
            parser.cut()
            assert op1_html.main_text(page.html, tree) == "\n".join(parser.blocks)
            checked += 1
    assert checked > len(pages) / 2


@pytest.mark.parametrize("part, end", [
    ("<p>", ""), ("<b", ""), ("<div>", "</x>" * 100_000), ("<div><li>", ""), ('<a href="x', ""), ("<!", ""), ("</", ""),
    ("<a b='c' ", ">"), ("<svg ", ""), ("<svg>", ""), ("<table>", "<td>" * 100_000), ("<div>", "<li></li>" * 100_000),
    ("<a>", ""), ("<p class=", ">"), ("&lt", ""), ("<!-- ", ""), ("<script>", "")])
def test_broken_pages_take_linear_time(part, end):
    start = time.process_time()
    op1_html.flat_blocks(part * 100_000 + end)
    assert time.process_time() - start < 3


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x", "x", "x"), (1, "u", PAGE, "x", "x", "x"), (2, None, None, "x", "x", "x"),
            (3, "u", "<article>" + "<p>a b c</p>" * 20_000, "x", "x", "x")]
    got = op1_html.html_digest(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(got[0].text)] * 2 + [0, 6 * 20_000 - 1]
    assert op1_html.html_digest(spark.createDataFrame([], PAGES)).count() == 0


def brute(url, rules):
    at = url.find("://") if url else -1
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in rules:
        cut = rule.find("/") if "/" in rule else len(rule)
        own, prefix = rule[:cut], rule[cut:]
        if (host == own or host.endswith("." + own)) and path.startswith(prefix):
            key = (len(rule), cut, verdict)
            best = max(best or key + (rule,), key + (rule,))
    return (host, path) + ((best[3], best[2]) if best else (None, "allow"))


def test_urls_against_brute_force(spark):
    random.seed(3)
    hosts = ["net", "a.net", "b.a.net", "x.b.a.net", "ba.net", "NET", "", "a.net:80", "a..net", "é.net"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é", "/~"]
    rules = [(h.lower() + p, random.choice(["allow", "block"])) for h in hosts[:6] for p in paths
             if random.random() < 0.5]
    rules = list(dict(rules).items())
    urls = [f"{random.choice(['http', 'x'])}://{random.choice(hosts)}{random.choice(paths)}"
            f"{random.choice(['', '?q', '#f', '?a/b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://a.net/a/b"]
    rows = [(i, u, None, "x", "x", "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    judged = op2_url_filters.judge_urls(pages, op2_url_filters.rules_frame(spark, rules))
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in judged.select(
        F.col("_row.page_id").alias("id"), "host", "path", "rule", "verdict").collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_very_long_urls(spark):
    host, path = ".".join(["a"] * 20_000) + ".net", "/x" * 50_000
    urls = [f"http://{host}/en/", f"http://example.net/en{path}", f"http://example.net/en/{path}?{path}#{path}",
            "s" * 100_000, "://" + "y" * 100_000, f"http://{path}"]
    pages = spark.createDataFrame([(i, u, None, "", "", "") for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op2_url_filters.url_digest(pages).collect()}
    assert got == {i: brute(u, op2_url_filters.RULES) for i, u in enumerate(urls)}


def test_url_tables_may_be_empty(spark):
    none = spark.createDataFrame([], PAGES)
    assert op2_url_filters.url_digest(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", None, "", "", "")] * 2, PAGES)
    got = op2_url_filters.judge_urls(pages, op2_url_filters.rules_frame(spark, [])).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 2
