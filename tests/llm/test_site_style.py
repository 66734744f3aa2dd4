"""Main texts of pages, and site style trees against plain loops."""

import html
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import queries, site_style

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **how):
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, PAGES), **how).collect()}


def test_query_equals_the_articles(spark, data):
    """The given pages mark their articles: what a pattern cuts out, with references decoded."""
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?:br|/?p|/?h1)>", " ", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just words &amp; &lt;more&gt; &eacute;&#233;&nbsp;x", "just words & <more> éé x"),
        ("<p>a<p>b <b>c</b>d<br>e</p>f", "a b cd e f"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table>", "one two x y z"),
        ("<p>a < b and <3</p><!-- no <p>no</p> --><p>c", "a < b and <3 c"),
        ("<script>var t='<p>no</p>'</script><style>p{}</style><p title='a>b'>yes</p><script>no", "yes"),
        ("<body><nav>no</nav><header>no</header><article><header><h1>T</h1></header><p>x</p><aside>no</aside><footer>no</footer></article><footer>no</footer>", "T x"),
        ("<main><p>x</p><form><p>no</p><button>no</button></form><div class='comments-area'><article class=comment><p>no</p></article></div></main><p>no</p>", "x"),
        ("<form id=aspnet><article><p>x</p></article></form>", "x"),
        ("<form id=aspnet><p>words of the page</p></form><p>y</p>", "words of the page y"),
        ("<div class='cookie-notice'>no</div><div class='page has-sidebar'><div id='sidebar'>no</div><div class='entry-content'><p>x</p><div class='adsbygoogle ad'>no</div></div></div>", "x"),
        ("<div role=navigation>no</div><div role=main><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>x</p></div>", "x"),
        ("<ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><div>some text</div>", "some text"),
        ("<ul><li><a href=/>Home</a></ul>", "Home"),
        ("<nav>only a menu</nav>", ""),
        ("<article></article><p>outside</p>", "outside"),
        ("<article><p>x</article><p>y", "x"),
        ("<b><p>bold</b> and</p> after</i>", "bold and after"),
        ("<article><h1>T</h1><p>cut off &am", "T cut off &am"),
        ("<article><p>x</p><foot", "x"),
    ],
)
def test_one_page(page, text):
    assert site_style.main_text(page, {}) == text


def unmarked(n, paragraphs):
    menu = "<div class=c1><div>Start here</div><div>All about us and our work</div></div>"
    return f"<html><body>{menu}<div class=c2><h2>Title {n}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=c3>We are not liable for anything said on these pages.</div></body></html>"


def said(n, k=12):
    return [" ".join(f"w{n}x{i}" for i in range(p, p + 30)) for p in range(0, k * 30, 30)]


def test_branches_that_a_host_repeats_go(spark):
    """No element is named; only what the host's pages share tells menu and notice from text. A page alone keeps all."""
    rows = [(i, f"http://a.example.com/{i}", unmarked(i, said(i, 1 + i % 3))) for i in range(6)] + [(99, "http://alone.example.com/", unmarked(99, said(99)))]
    for most in (10**6, 0):
        got = texts(spark, rows, most=most)
        assert all(got[i] == " ".join([f"Title {i}", *said(i, 1 + i % 3)]) for i in range(6))
        assert "Start here" in got[99]


def test_constant_branch_within_marked_articles_goes(spark):
    page = lambda n: f"<article><h1>T{n}</h1><p>{said(n, 1)[0]}</p><div class=x7>Tell your friends about it</div></article>"
    got = texts(spark, [(i, f"http://b.example.com/{i}", page(i)) for i in range(10)])
    assert all(got[i] == f"T{i} {said(i, 1)[0]}" for i in range(10))
    few = texts(spark, [(i, f"http://b.example.com/{i}", page(i)) for i in range(3)])
    assert few[0].endswith("friends about it")


def test_copies_stay_whole(spark):
    """A host most of whose pages are copies, exact and near: their text is shared, and stays."""
    page = lambda n, w: f"<nav>no</nav><article><h1>Same title</h1><p>{w}</p><p>{' '.join(said(1, 2))}</p></article><footer>no</footer>"
    rows = [(i, f"http://c.example.com/{i}", page(i, "same words" if i < 20 else f"near {i}")) for i in range(30)]
    got = texts(spark, rows)
    assert all(t.startswith("Same title ") and t.endswith(said(1, 2)[1]) for t in got.values())
    plain = [(i, f"http://d.example.com/{i}", unmarked(1, said(1))) for i in range(9)]
    assert all(said(1)[3] in t for t in texts(spark, plain).values())


def test_trees_equal_plain_loops(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", unmarked(i % 5, said(i % 4, 1 + i % 3))) for i in range(14)]
    got = {(r.site, r.path): (r.n_pages, r.presentation, r.content, r.importance) for r in site_style.style_trees(spark.createDataFrame(rows, PAGES)).collect()}
    forms, words = defaultdict(Counter), defaultdict(Counter)
    for _, url, page in rows:
        nodes, blocks = site_style.parse(page)
        own = defaultdict(set)
        for n in nodes[1:]:
            own[n.path].add(tuple(n.children))
        for p, f in own.items():
            forms[url.split("/")[2], p][frozenset(f)] += 1
        for p, t in {(nodes[b.node].path, b.text) for b in blocks}:
            words[url.split("/")[2], p][t] += 1
    want = {}
    for (site, p), f in forms.items():
        m = sum(f.values())
        shape = 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in f.values())
        told, blocks = 0.0, 0
        for (s, q), t in words.items():
            if s == site and (q == p or q.startswith(p + "/")):
                of = sum(forms[s, q].values())
                told += sum(n * (1 - (math.log(n, of) if of > 1 else 0)) for n in t.values())
                blocks += sum(t.values())
        content = told / blocks if blocks else None
        weight = 0.9 ** len(f)
        want[site, p] = (m, shape, content, 1.0 if m == 1 else (1 - weight) * shape + weight * (content or 0.0))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_identity_is_sparks(spark):
    for t in ("", "é x" * 50, "html/body/div.a"):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] == site_style.identity(t)


def test_odd_rows(spark):
    """Nulls, repeats, a url without a host, names that clash, a very long page, very deep nesting, an empty table."""
    long = "<p>" + "word " * 400_000 + "</p>"
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    rows = [(1, None, "<p>a", "x", 1), (1, "no host", "<p>b", None, None), (2, "http://e.example.com/", None, "x", 1), (2, "http://e.example.com/", None, "x", 1), (None, "http://e.example.com/", "", "x", 1), (3, "http://f.example.com/", long, "x", 1), (4, "http://f.example.com/", deep, "x", 1), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, f"{PAGES}, TEXT string, `__site` int")
    got = site_style.extract(df)
    assert got.columns == ["page_id", "url", "html", "__site", "text", "n_chars"] and got.count() == 8
    by = sorted((r.page_id or 0, r.n_chars, r.text[:4]) for r in got.collect())
    assert by == [(0, 0, ""), (1, 1, "a"), (1, 1, "b"), (2, 0, ""), (2, 0, ""), (3, 1_999_999, "word"), (4, 4, "deep"), (5, 0, "")]
    assert site_style.extract(df.limit(0)).count() == 0
