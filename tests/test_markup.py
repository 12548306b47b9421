"""Nested and broken elements, entities, titles and links; references against the standard library's resolution."""

import html
import random
from urllib.parse import urljoin

import pytest
from evidencelake.functions import text as T
from evidencelake.functions.markup import page, read_page
from evidencelake.functions.urls import resolve_url
from evidencelake.operators import pages as P
from pyspark.sql import functions as F

MAIN = [
    ('<div role="main"><div>first</div><p>second part of the story</p></div>', "first\nsecond part of the story", "html_role_main"),
    ("<article>one<article>two</article>the tail</article>", "one\ntwo\nthe tail", "html_article"),
    ("<article>a</article><main>longer text<nav>menu</nav></main>", "longer text", "html_main"),
    ("<article>same</article><main>same</main>", "same", "html_article"),
    ("<article>1</article><article>2</article><article>3</article><article>the fourth is not looked at</article>", "1", "html_article"),
    ("<aside><article>kept although aside</article></aside>", "kept although aside", "html_article"),
    ('<section itemprop="articleBody">x<section>y</section>z</section>', "x\ny\nz", "html_article_body"),
    ("<form role=main>hidden itself</form><p>x</p>", "", "empty"),
    ("<p>no main part</p>", "", "empty"),
]


@pytest.mark.parametrize(("source", "text", "kind"), MAIN)
def test_main_text(source, text, kind):
    found = read_page(source)
    assert (found["main"], found["main_source"]) == (text, kind)


TEXT = [
    ("caf&eacute; it&#8217;s &#x41;&amp;lt;", "café it’s A&lt;"),
    ("<nav>menu <nav>inner</nav> menu rest</nav>after", "after"),
    ("<nav><ul><li>a<li>b</ul></nav><p>x<p>y", "x\ny"),
    ("a<!-- no > end -->b<script>if (a < b) { document.write('</p>') }</script>c", "a\nb\nc"),
    ("<style>p > a {}</style><p title='a > b'>x</p>", "x"),
    ("<footer/>shown<header><span>gone</header>still shown", "shown\nstill shown"),
    ("<b><div>in</b>side</div><nav>gone</span></nav>out", "in\nside\nout"),
    ("</div>stray<table><tr><td>1<td>2<tr><td>3</table>", "stray\n1\n2\n3"),
    ("<p>1\n\n\n\n2</p><p> \n </p>3 < 4", "1\n\n2\n3 < 4"),
    ("<nav>only a menu</nav>", "only a menu"),
    ('<img alt="a>b">x<br/>y<a href="/unclosed', 'x\ny<a href="/unclosed'),
    ("<title>named</title><p>x", "named\nx"),
    ("", ""),
]


@pytest.mark.parametrize(("source", "text"), TEXT)
def test_whole_text(source, text):
    assert read_page(source)["text"] == text


def test_against_a_tree(spark):
    """Random well-formed trees: texts by walking the tree itself."""
    rng, hidden = random.Random(4), {"nav", "aside", "form", "footer"}

    def tree(depth):
        kids = [tree(depth + 1) if rng.random() < 0.6 and depth < 5 else rng.choice(["x", "yy & z", "é", "<"]) for _ in range(rng.randint(1, 4))]
        return rng.choice(["div", "article", "main", "nav", "aside", "section", "span", "form", "footer"]), kids

    def source(node):
        return html.escape(node) if isinstance(node, str) else f"<{node[0]}>" + "<i></i>".join(map(source, node[1])) + f"</{node[0]}>"

    def shown(node):
        return [node] if isinstance(node, str) else [] if node[0] in hidden else [t for k in node[1] for t in shown(k)]

    def named(node, name):
        return [] if isinstance(node, str) else [node] * (node[0] == name) + [x for k in node[1] for x in named(k, name)]

    trees = [("body", [tree(0)]) for _ in range(300)]
    for t in trees:
        best, kind = "", "empty"
        for name in ("article", "main"):
            for node in named(t, name)[:3]:
                if len(text := "\n".join(shown(node))) > len(best):
                    best, kind = text, f"html_{name}"
        found = read_page(source(t))
        assert (found["main"], found["main_source"]) == (best, kind)
        assert found["text"] == "\n".join(shown(t)) or not shown(t)


def test_columns(spark):
    source = '<title>A title</title><header><h1>Short</h1></header><main>m &amp; n</main><a href=" /x?a=1&amp;b=2 "><b>go</b> there</a><a name=y>no</a><a href="#f">f</a>'
    df = spark.createDataFrame([(1, "http://h/d/e/f.html", source), (2, "http://h/", None), (3, "http://h/", "")], "page_id long, url string, html string")
    got = {r[0]: r[1:] for r in df.select("page_id", T.html_to_text(F.col("html")), T.structural_text(F.col("html")), T.extract_title(F.col("html"), F.lit("## From text\nx")), F.size(page(F.col("html"))["links"])).collect()}
    assert got[1] == ("A title\nm & n\ngo\nthere\nno\nf", ("m & n", "html_main"), "A title", 2)
    assert got[2] == got[3] == ("", ("", "empty"), "From text", 0)
    links = P.extract_links(df, 5).orderBy("ordinal").select("link", "anchor").collect()
    assert [tuple(r) for r in links] == [("http://h/x?a=1&b=2", "go there"), ("http://h/d/e/f.html#f", "f")]


RFC = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y|#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s
g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s|. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g
../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g|./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h
g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y|g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x"""


def test_references(spark):
    pairs = [("http://a/b/c/d;p?q", *x.split(" ")) for x in RFC.replace("\n", "|").split("|")] + [("http://a/b/c/d;p?q", "", "http://a/b/c/d;p?q")]
    rng = random.Random(8)
    bits = ["a", "b.html", "..", ".", "", "é", "x=1"]
    for _ in range(400):
        base = rng.choice(["http", "https"]) + "://h.org" + rng.choice(["", "/", "/d/e/f.html", "/d/e/", "/p?q=1", "/p?q#f"])
        ref = rng.choice(["", "/", "//o.net/", "http://o.net/", "https:", "./", "../", " "]) + "/".join(rng.choice(bits) for _ in range(rng.randint(0, 5))) + rng.choice(["", "?z", "?", "#t", "?z#t", "#"])
        pairs.append((base, ref, urljoin(base, ref)))
    pairs += [("http://h/a", x, urljoin("http://h/a", x)) for x in ("mailto:me@x", "javascript:void(0)", "HTTP://X.y/Z", "tel:1", "a:b/c")]
    df = spark.createDataFrame(pairs, "base string, ref string, want string")
    wrong = [tuple(r) for r in df.select("base", "ref", "want", resolve_url(F.col("base"), F.col("ref")).alias("got")).filter("got is null or got <> want").collect()]
    assert wrong == []
