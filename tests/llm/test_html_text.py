import random
import time
from html import escape

import pytest

from rasterloom.llm.html_text import extract, main_text, op2_html_extraction, surges

from .common import invented

P = "A paragraph of the article, long enough to count as one of its lines and then some more words."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("<p></p><br>", ""),
        ("just text", "just text"),
        (f"<article><h1>Head &amp; tail</h1><p>{P}</p><p>Short.</p></article>", f"Head & tail\n{P}\nShort."),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><p>{P}</p></article><footer>Foot</footer>", P),
        (f"<header>Site</header><main><header><h1>Title</h1></header><p>{P}</p></main><aside><p>{P} aside</p></aside>", f"Title\n{P}"),
        (f"<article><p>a<b>b</b>\n\t c&nbsp;d<br>e&#x41;&lt;</p><script>var t='<p>no</p>'</script><style>p{{}}</style><p>{P}</p></article>", f"ab c d eA<\n{P}"),
        (f"<article><p>{P}</p><div class='comments'><p>{P} reader</p></div></article><div id=comments><p>{P} reader</p></div>", P),
        (f"<div class='ad'>{P} buy</div><article><p>{P}</p><div class=\"cookie-notice\">{P} cookies</div><form><label>{P}</label><input></form></article>", P),
        (f"<article><p>{P}<p>{P} two", f"{P}\n{P} two"),
        (f"<article><p>{P}</p><!-- {P} --><p>x &lt;b&gt; 3 < 4</p></article>", f"{P}\nx <b> 3 < 4"),
        (f"<div id='menu'><a href=1>one</a></div><div class='post-content'><p>{P}</p><p>End.</p></div><div class='footer'>f</div>", f"{P}\nEnd."),
        (f"<body><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><div>{P}</div><div>{P} again</div><p>x</p></body>", f"{P}\n{P} again\nx"),
        (f"<a title='>'>t</a><article data-x=\"<p>no</p>\"><p title='a > b'>{P}</p></article>", P),
        (f"<ARTICLE><P>{P}</P></ARTICLE><SCRIPT>no</SCRIPT>", P),
        ("<p>one<p>two", "one\ntwo"),
        (f"<article><p>{P}</p></article><article class='comment'><p>{P} reader</p></article>", P),
        (f"<article><div hidden>{P} no</div><p>{P}</p><p style='display:none'>{P} no</p></article>", P),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        *[(f"<div {w}><p>Site</p><article><p>{P}</p><div class='ad'>{P} buy</div><p>End.</p></article></div><p>Foot</p>", f"{P}\nEnd.") for w in ("class='site has-sidebar'", "id=content class=with-comments", "class='post-content no-sidebar'", "class='search-result-page'", "class='sidebar'", "role=search")],
        (f"<form id=aspnetForm><div><article><p>{P}</p></article></div></form>", P),
        (f"<div class='post-content widget'><p>{P}</p></div>", P),
        (f"<article class='post comment-open'><p>{P}</p></article>", P),
        (f"<article><p class='social'>{P}</p><div class='related-work'><p>Works.</p></div><p>End.</p></article>", f"{P}\nWorks.\nEnd."),
        (f"<main><h1>Top</h1><div class='search'><article><p>{P}</p></article></div></main>", P),
        (f"<main><p>{P}</p><div class='related'><article><p>Teaser</p></article></div><p>End.</p></main>", f"{P}\nEnd."),
        (f"<div><p>{P} body</p><p>{P}</p></div><section id='comments'><article><p>{P * 9} reader</p></article></section>", f"{P} body\n{P}"),
        (f"<article><p>{P}</p></article><aside><article><p>{P * 9}</p></article></aside><div class='site-footer'>f</div>", P),
    ],
)
def test_names_of_wrappers_and_paragraphs_lose_no_article(html, text):
    assert main_text(html) == text


def test_generated_pages_give_their_articles():
    r = random.Random(6)
    for k in range(60):
        blocks = [invented(r, r.choice((1, 5, 40, 200))) + r.choice(("", " & <x>", " “q”")) for _ in range(r.randint(1, 12))]
        junk = lambda: r.choice((f"<nav><ul><li><a href=/>{invented(r, 3)}</a></li></ul></nav>", f"<div class=\"ad\">{invented(r, 40)}</div>", f"<aside>{invented(r, 60)}</aside>", f"<div class='sidebar'><p>{invented(r, 60)}</p></div>", "<script>if (a<b) { x('</p>') }</script>", f"<form><p>{invented(r, 9)}</p></form>"))  # noqa: B023, E731
        inner = "".join((junk() if r.random() < 0.2 else "") + f"<p>{escape(b)}</p>" for b in blocks)
        page = f"<!DOCTYPE html><html><head><title>no</title></head><body><header>{invented(r, 9)}</header>{junk()}<article>{inner}</article>{junk()}<section id='comments'><p>{invented(r, 50)}</p></section><footer>{invented(r, 30)}</footer>" + ("</body></html>" if k % 3 else "")
        assert main_text(page) == "\n".join(" ".join(b.split()) for b in blocks)


def test_surge_and_dive():
    assert surges([0, 5, 0, 60, 70, 0, 9, 0, 0, 0, 0, 4], 120) == [(3, 7)]
    assert surges([1, 1], 120) == [] and surges([], 0) == []
    assert surges([1, 0, 0, 0, 2], 0) == [(0, 1), (4, 5)]


@pytest.mark.parametrize("part", ["<", "<a ", "<p", "</", "<!--", "&", "<a x='", "<div class=", "<p>x", "<nav>", "<script>", "<article>", "a=\"'", "<svg>", "<math>x", "<nav><article>", "<article><nav>", "<div class=ad><p>", "<span class=ad>", "<a><div>", "<table><tr><td>"])
def test_broken_and_very_long_pages_take_linear_time(part):
    began = time.time()
    main_text(part * 100_000)
    main_text("<nav>" + part * 50_000 + "</article>" * 50_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("open_, close", [("<p class='social-history'>", "</p>"), ("<div class='related-work'><p>", "</p></div>"), ("<section class='comment-on-theory'><p>", "</p></section>"), ("<h2 id=search>", "</h2>"), ("<table class='alert-levels'><tr><td>", "</td></tr></table>"), ("<math><mi>", "</mi></math>"), ("<p class=social>", "</p>")])
@pytest.mark.parametrize("words", ["Short.", P])
def test_blocks_of_an_article_stay(open_, close, words):
    page = f"<nav><a href=/>Home</a></nav><article><p>{P} one</p>{open_}{words}{close}<p>{P} two</p></article><footer>f</footer>"
    assert main_text(page) == f"{P} one\n{words}\n{P} two"


def brute_surges(lengths, threshold, window):
    """Runs as the docstring says it, from every place anew."""
    total = lambda i: sum(lengths[i : i + window])
    kept, inside = [], False
    for i, x in enumerate(lengths):
        inside = (inside and total(i) > 0) or (x > 0 and total(i) > threshold)
        kept.append(inside and x > 0)
    return kept


def test_surges_match_brute_force():
    r = random.Random(3)
    for _ in range(300):
        lengths = [r.choice((0, 0, 0, 5, 40, 90, 200)) for _ in range(r.randint(0, 30))]
        got = [False] * len(lengths)
        for a, z in surges(lengths, 120):
            for k in range(a, z):
                got[k] = lengths[k] > 0
        assert got == brute_surges(lengths, 120, 3)


def unmarked(r, k):
    """A page that marks no article, and its text."""
    blocks = [invented(r, r.choice((30, 60, 120))) for _ in range(r.randint(2, 8))]
    tag = ("p", "div", "p")[k % 3]
    body = f"<h1>{invented(r, 4)} head</h1>"
    side = f"<div><div>{invented(r, 5)}</div></div>"
    foot = f"<footer>{invented(r, 20)}</footer>"
    nav = "<ul>" + "".join(f"<li><a href=/>{invented(r, 2)}</a></li>" for _ in range(5)) + "</ul>"
    page = f"<html><head><title>t</title></head><body>{nav}{side}<div>{body}" + "".join(f"<{tag}>{escape(b)}</{tag}>" for b in blocks) + f"</div>{foot}</body></html>"
    return page, "\n".join([body[4:-5], *blocks])


def test_lengths_alone_find_the_article_of_unmarked_pages():
    r = random.Random(8)
    for k in range(60):
        page, want = unmarked(r, k)
        assert main_text(page) == want


def test_without_surges_and_dives_most_pages_come_out_otherwise(monkeypatch):
    from rasterloom.llm import html_text

    r = random.Random(9)
    pages = [unmarked(r, k)[0] for k in range(20)]
    pages += [f"<nav><a href=/>x</a></nav><div class=ad>{invented(r, 9)}</div><article><h1>{invented(r, 4)}</h1><p>{invented(r, 40)}</p></article><footer>f</footer>" for _ in range(20)]
    was = [main_text(x) for x in pages]
    monkeypatch.setattr(html_text, "surges", lambda lengths, threshold, window=3: [(0, len(lengths))])
    assert sum(main_text(x) != y for x, y in zip(pages, was, strict=True)) == len(pages)


def test_a_short_mark_beside_the_text_is_no_mark():
    page = f"<article><p>Teaser</p></article><div><p>{P} a</p><p>{P} b</p><p>{P} c</p></div>"
    assert main_text(page) == f"{P} a\n{P} b\n{P} c"


def test_rows_and_columns(spark):
    rows = [(1, "u", f"<article>{P}</article>", "old", 7, "k"), (1, "u", f"<article>{P}</article>", "old", 7, "k"), (None, None, None, None, None, None), (2, "v", "é\U0001f600", "old", 7, "k")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, row string")
    got = extract(d)
    assert got.columns == ["page_id", "url", "row", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == [("1", P, len(P)), ("1", P, len(P)), ("2", "é\U0001f600", 2), ("None", "", 0)]
    assert extract(d.where("false")).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op2_html_extraction(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted([str((1, "u", P, len(P))), str((2, None, "", 0))])
