import re
from html import unescape

import pytest

from fillsight.llm import pages as P

LONG = "A paragraph with enough words in it to stand out from what a page puts around its article, sentence by sentence."
BODY = '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">%s</body></html>'

CASES = {
    "menus, headers, sidebars and footers": (
        '<header><h1>Site</h1></header><nav>menu</nav><main><h1>Title</h1><p>Short.</p><aside>aside</aside><p>Tail.</p></main><footer>foot</footer>',
        "Title Short. Tail."),
    "an article without marks": (
        f'<div id="top"><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p>'
        f'<p>{LONG}</p></div></div><div><div>Imprint</div></div>',
        f"Title {LONG} Short. {LONG}"),
    "an article without marks, named frames": (
        f'<div class="page-header">Site</div><div class="main-nav"><a href=1>One</a></div><div class="content-sidebar-wrap"><div><p>{LONG}</p><p>Is.</p></div>'
        f'<div id="sidebar"><p>{LONG}</p></div></div><div class="footer-widgets"><p>{LONG}</p></div><div id="cookieNotice">{LONG}</div>',
        f"{LONG} Is."),
    "reader comments": (
        f'<article class="post"><h1>T</h1><p>Text.</p></article><section id="comments"><article><p>{LONG}</p></article></section>'
        f'<div class="comment-list"><p>{LONG}</p></div>',
        "T Text."),
    "adverts and notices inside": (
        f'<article><p>One.</p><div class="ad">{LONG}</div><div class="newsletter-signup">{LONG}<form><input value=x></form></div><p>Two.</p></article>',
        "One. Two."),
    "a page in a form": ('<form id="aspnetForm"><div class="login">in</div><article><p>Text</p></article><button>Go</button></form>', "Text"),
    "an unclosed menu and truncated markup": ("<nav><a href=a>menu</a><article><p>One<p>Two<br>Three<ul><li>a<li>b</ul><p tit", "One Two Three a b"),
    "references and white space": ("<article><p>a&nbsp;&amp;\n\t b&lt;i&gt; &#x41;&eacute; &unknown; &amp</p>c<b>d</b>e</article>", "a & b<i> Aé &unknown; & cde"),
    "scripts with markup": ('<script>var t="</p><article>x</article>";</script><article><p>a<!-- <p>no</p> --> b</p><script>if (a<b) {}</script></article>', "a b"),
    "the article's own header": ('<article><header><h1>Title</h1><span>by X</span></header><p>Text</p><footer>tags</footer></article>', "Title Text"),
    "hidden": ('<article><p>a</p><p hidden>b</p><div style="display: none">c</div></article>', "a"),
    "a list of links only": ("<ul>" + "<li><a href=x>Some link with a long text to it</a></li>" * 9 + "</ul>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    source, want = CASES[name]
    assert P.main_text(BODY % source) == want


def test_bare_text():
    assert P.main_text("just a < b text") == "just a < b text"
    assert P.main_text("") == P.main_text(None) == P.main_text("<p> </p>") == P.main_text("<script>x") == ""


def test_surge_and_dive():
    assert P.stretches([0, 0, 5, 0, 0, 7, 0, 0, 0, 1, 0, 2]) == [(2, 6, 7), (9, 12, 3)]
    assert P.stretches([]) == P.stretches([0, 0]) == []


def test_table_and_edges(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    for r in P.extract(table).join(table, ["page_id", "url"]).collect():
        inner = re.sub("</?b>", "", re.search("<article>(.*)</article>", r.html, re.S)[1])
        assert r.text == " ".join(unescape(re.sub("<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<p>" + "wörd 😀 " * 100_000), (3, None, "<" * 50_000), (4, "w", "<div>" * 20_000 + "x")]
    frame = spark.createDataFrame([(*r, "y", 7) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    found = sorted((tuple(r) for r in P.extract(frame).collect()), key=repr)
    long = ("wörd 😀 " * 100_000).strip()
    want = [(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, "v", long, len(long)), (3, None, "<" * 50_000, 50_000), (4, "w", "x", 1)]
    assert found == sorted(want, key=repr)
    assert P.extract(frame.limit(0)).collect() == []
