import random

import numpy as np
import pytest

from seafret.llm import html_text as h


def text(html):
    return h.main_text(*h.page_lines(html))


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\nb"),
        ("<article><h1>T &amp; t</h1><p>one\n two&nbsp;three<br>four</p></article>", "T & t\none two three four"),
        ("<nav>menu</nav><article><p>x</p></article><footer>f</footer>", "x"),
        ('<body><div class="ad">buy</div><p>x</p><div id="cookie-notice">ok</div></body>', "x"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside><form>f<input></form></article>", "T\nx"),
        ("<header>site</header><p>x</p>", "x"),
        ('<p>x</p><script>var t="</p>";</script><style>p{}</style><p>y</p>', "x\ny"),
        ("<p>x</p><!-- <p>no</p> --><p>y</p><!-- open", "x\ny"),
        ('<article><p>x</p><section class="comments"><article class="comment"><p>c</p></article></section></article>', "x"),
        ('<main><p title="a > b">x</p><p>1 < 2 &lt; 3</p></main>', "x\n1 < 2 < 3"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc d\ne"),
        ("<P>a<B>b</B>c</P><DIV>d</DIV>", "abc\nd"),
        ('<article class="post has-comments with-sidebar"><p>x</p></article>', "x"),
        ('<p class="ad">no<p>x', "x"),
        ("<article><p><b>a<br><p>b</article>c", "a\nb"),
        ("&#1234;&#x41;&bogus;", "ӒA&bogus;"),
        ("<textarea><p>no</p></textarea><p>x</p>", "x"),
        ("<div hidden>h</div><div style='display: none'>n</div><p>x</p>", "x"),
        ("<article>a <span class=share>s</span> b</article>", "a\nb"),
    ],
)
def test_markup(html, want):
    assert text(html) == want


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        i, j = h.lcs(np.array(a, np.int64), np.array(b, np.int64))
        assert len(i) == len(j) == plain_lcs(a, b)
        assert [a[k] for k in i] == [b[k] for k in j]
        assert list(i) == sorted(set(i)) and list(j) == sorted(set(j))


def unmarked(menu, body, foot):
    return "".join(f"<div>{x}</div>" for x in [*menu, *body, *foot])


def site(n):
    """Pages without helpful markup, with one menu and foot; two quote the same line."""
    out = []
    for i in range(n):
        body = [f"line {i} {k}" for k in range(3)] + (["quoted"] if i in (2, 3) else []) + [f"end {i}"]
        out.append((i, f"http://host.example/a/{i:03d}?x={i % 2}", unmarked(["home", "about"], body, ["(c) host"]), body))
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_shared_lines_go_wherever_pages_are_cut(spark, parts):
    pages = site(40)
    rows = [(i, u, html) for i, u, html, _ in pages] + [(100 + k, u, html) for k in range(6) for _, u, html, _ in pages[20:21]]
    rows += [(900, "http://other.example/", "<div>home</div><div>alone</div>"), (901, None, "<div>home</div>"), (902, None, None), (902, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = h.extract(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    found = {r.page_id: r.text for r in got}
    for i, _, _, body in pages:
        assert found[i] == "\n".join(body), i
    assert all(found[100 + k] == found[20] for k in range(6))
    assert (found[900], found[901], found[902]) == ("home\nalone", "home", "")
    assert all(r.n_chars == len(r.text) for r in got)


def test_marked_articles_keep_quoted_lines(spark):
    html = "<nav>menu</nav><article><p>same</p><p>{}</p></article>"
    frame = spark.createDataFrame([(i, f"http://h/{i}", html.format(i)) for i in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(frame).collect()} == {i: f"same\n{i}" for i in range(4)}


def test_alignment_decides_on_pages_with_marked_lines(spark):
    """A card or a wrapper that is marked as the article must not hide the unmarked text; shared unmarked lines go as on any page."""
    html = "<div>home</div><article class='teaser'><p>card</p></article><div>text {0}</div><div>more {0}</div><div>(c) host</div>"
    wrap = "<div>home</div><div class='page-content'><p>by {0}</p></div><div>body of {0}</div><div>(c) host</div>"
    rows = [(i, f"http://h/{i}", html.format(i)) for i in range(4)] + [(10 + i, f"http://w/{i}", wrap.format(i)) for i in range(4)]
    rows += [(20, "http://alone/", "<article class='teaser'>card</article><div>the text itself</div>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"text {i}\nmore {i}" for i in range(4)} | {10 + i: f"by {i}\nbody of {i}" for i in range(4)} | {20: "card\nthe text itself"}
    assert {r.page_id: r.text for r in h.extract(frame).collect()} == want


def test_copies_of_an_article_keep_it():
    lines, kinds = h.page_lines("<nav>m</nav><article><p>one and two</p><p>three</p></article>seen 5 times")
    assert h.main_text(lines, kinds, [0, 1, 2], [0, 1, 2]) == "one and two\nthree\nseen 5 times"


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', "one two\nthree"),
        ('<p>a<svg title="1 > 0"/>b<svg><text>no</text></svg>c</p>', "abc"),
        ('<p>a<iframe src="x" />b</p><p>c</p>', "ab\nc"),
        ("<p>a<canvas>b</p><p>c</p>", "ab\nc"),
        ("<p>a<svg>b</p><p>c<svg>d</p>", "ab\ncd"),
        ("<p>a</p><noscript><p>b</p><template><p>c</p>", "a\nb\nc"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b <object data='f'>fall <b>back</b></object></p>", "a x=1 b fall back"),
        ("<p>a</p><script>x = '<p>no</p>'", "a"),
        ("<p>a<SCRIPT>x</SCRIPT >b</p>", "ab"),
        ("<p>a<script src=x/>no</script>b</p>", "ab"),
    ],
)
def test_only_raw_elements_hide_text(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "part",
    [
        "<section id='discussion'><p>real {0}</p></section>",
        "<h2 id='related-work'>real {0}</h2>",
        "<h2 id='search-algorithms'>real {0}</h2>",
        "<p class='notice'>real {0}</p>",
        "<div class='social-history'>real {0}</div>",
        "<div id='alert-levels'><div>real {0}</div></div>",
        "<p class='ad-hoc'>real {0}</p>",
    ],
)
@pytest.mark.parametrize("page", ["<article><p>text {0}</p>%s</article>", "<p>text {0}</p>%s<p>end {0}</p>"])
def test_names_alone_hide_no_text(page, part):
    lines, kinds = h.page_lines((page % part).format(7))
    assert "real 7" in h.main_text(lines, kinds).split("\n")
    assert "real 7" in h.main_text(lines, kinds, [], []).split("\n")


def test_named_blocks_go_if_the_neighbours_have_them():
    html = "<article><p>a</p><div class='related'><h2>Related</h2><p>{}</p></div><p>b</p><section class='comments'>c</section><p>d</p></article>"
    lines, kinds = h.page_lines(html.format("x"))
    assert h.main_text(lines, kinds, [1, 2], [1, 2]) == "a\nb\nd"
    assert h.main_text(lines, kinds, [1, 2], None) == "a\nb\nd"
    assert h.main_text(lines, kinds, [1, 2], [1]) == h.main_text(lines, kinds, [1], [1]) == "a\nRelated\nx\nb\nd"


def test_empty(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string, mark string")).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><pre>x = 1 <span class="hljs-comment"># set x</span></pre></article>', "x = 1 # set x"),
        ('<pre><span class="comment"># a</span> <span class="ad">b</span></pre>', "# a b"),
        ('<article><p id="ad-1942">In 1942</p><div class="comment-quote">quoted</div></article>', "In 1942\nquoted"),
        ("<article><p>He said <label>hi</label> and <button>ok</button></p></article>", "He said hi and ok"),
        ("<article><p>a</p><div><button>Share</button><label>Name</label></div></article>", "a"),
        ('<article><p>a</p><ol class="comment-list"><li>c</li></ol><div class="ad-slot">buy</div><p>b</p></article>', "a\nb"),
        ('<p>a <em class="comment-note">word</em> b</p>', "a word b"),
        ('<article class="teaser"><p>a long teaser with many more words than the body has in it</p></article><div>the body</div>',
         "a long teaser with many more words than the body has in it\nthe body"),
        ("<article><p>a</p></article><div class='related-links'>x</div><div>b</div>", "a\nb"),
        ("<body>stray<article>a</article></body>", "a"),
    ],
)
def test_text_is_kept_by_evidence_not_by_length(html, want):
    assert text(html) == want


def test_wholly_shared_articles():
    """A card beside sentences goes however long it is; a copied article beside a note of its own stays however short it is."""
    lines, kinds = h.page_lines("<article><p>A very long shared card that has more text than the rest.</p></article><div>The body of it is short.</div>")
    assert h.main_text(lines, kinds, [0], [0]) == "The body of it is short."
    assert h.main_text(lines, kinds, [0], []) == "\n".join(lines)
    lines, kinds = h.page_lines("<article><p>copy</p></article><div>a much longer note without any sentence in it 2024-01-01</div>")
    assert h.main_text(lines, kinds, [0], [0]) == "\n".join(lines)


def test_very_long_pages_and_clashing_columns(spark):
    body = "".join(f"<p>line {i} of the page</p>" for i in range(30_000))
    rows = [(1, "http://h/1", f"<nav>m</nav><article>{body}</article>"), (2, "http://h/2", f"<nav>m</nav><article>{body}<p>x</p></article>"), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as mark", "'x' as host", "2 as path", "'y' as text", "3 as run")
    got = {r.page_id: r for r in h.extract(frame).collect()}
    assert got[1].text.count("\n") == 29_999 and got[2].text.endswith("\nx") and got[None].text == "" and got[None].n_chars == 0
