"""Main text of pages that no maker of training pages wrote."""

from __future__ import annotations

import pytest

from quillstone.llm import html_text

A = "The river rises in the hills north of the town and runs for sixty miles before it meets the sea."
B = "Along its banks stand old mills, most of them empty now, and a few new houses built of brick."
C = "Each spring the water comes over the lower road, and the children are rowed to school in boats."

PAGES = {
    "paragraphs in the body": (f"<body><p>{A}</p><p>{B}</p><p>{C}</p></body>", [A, B, C]),
    "one paragraph": (f"<p>{A}</p>", [A]),
    "a division in the body": (f"<body><div>{A} {B} {C}</div></body>", [f"{A} {B} {C}"]),
    "a heading and paragraphs": (f"<html><body><h1>The river</h1><p>{A}</p><p>{B}</p></body></html>", ["The river", A, B]),
    "no markup": (f"{A} {B}", [f"{A} {B}"]),
    "line breaks": (f"<html><body>{A}<br>{B}<br/>{C}</body></html>", [f"{A} {B} {C}"]),
    "article": (f"<header><a href=/>Home</a></header><article><p>{A}</p><p>{B}</p></article><footer>Copyright</footer>", [A, B]),
    "self-closed drawing": (f"<article><p>{A}</p><svg width=9 /><p>{B}</p><svg><text>label</text></svg><p>{C}</p></article>", [A, B, C]),
    "self-closed formula": (f"<article><p>{A}</p><math/><p>{B}</p><math><mi>x</mi></math><p>{C}</p></article>", [A, B, C]),
    "open drawing": (f"<article><p>{A}</p><svg><p>{B}</p></article>", [A, B]),
    "open noscript": (f"<article><p>{A}</p><noscript><p>{B}</p></article>", [A, B]),
    "open template": (f"<article><p>{A}</p><template><p>{B}</p></article>", [A, B]),
    "open frame": (f"<article><p>{A}</p><iframe src=x><p>{B}</p></article>", [A, B]),
    "open script": (f"<article><p>{A}</p></article><script>var a = '{B}'", [A]),
    "closed script": (f"<article><p>{A}</p><script>var a = '<p>{C}</p>';</script><p>{B}</p></article>", [A, B]),
    "fallback of an object": (f"<article><p>{A}</p><object data=x><p>{B}</p></object></article>", [A, B]),
    "similar names of tags": (f"<article><style-note>{A}</style-note><style>p {{}}</style><p>{B}</p></article>", None),
    "stray end tags": (f"</div></p></b><article><p>{A}</p></section></article></body></html>", [A]),
    "menu, advert and comments": (f'<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><main><h1>The river</h1><p>{A}</p><div class="ad">Buy boats now</div><p>{B}</p></main><section id="comments"><p>{C}</p></section>', ["The river", A, B]),
    "comment in markup": (f"<article><p>{A}</p><!-- <p>{B}</p> --><p>{C}</p></article>", [A, C]),
    "character references": ("<article><p>Caf&eacute; &amp; bar &#8212; open from nine, closed on Sundays &lt;usually&gt;.</p></article>", ["Café & bar — open from nine, closed on Sundays <usually>."]),
    "loose paragraphs between a menu and a foot": (f"<html><body><header><a href=/>Home</a></header><h1>The river</h1><p>{A} {B}</p><p>{C} {A}</p><p>{B} {C}</p><footer>Copyright</footer></body></html>", ["The river", f"{A} {B}", f"{C} {A}", f"{B} {C}"]),
    "list in an article": (f"<article><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul></article>", [A, B, C]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, want = PAGES[name]
    got = html_text.main_texts([source], *html_text.train())[0]
    assert B in got if want is None else got == "\n".join(want)


@pytest.mark.parametrize("n", [1, 10, 300, 5000])
def test_pages_of_any_length(n):
    """Neither a long article nor a long list of comments outweighs the other."""
    article, comments = "".join(f"<p>{B}</p>" for _ in range(n)), "".join(f"<p>{C}</p>" for _ in range(n))
    for left, right in ((f"<article>{article}</article>", f"<div class=comments><p>{C}</p></div>"), (f"<article><p>{B}</p></article>", f"<div class=comments>{comments}</div>")):
        got = html_text.main_texts([left + right], *html_text.train())[0]
        assert set(got.split("\n")) == {B} and len(got.split("\n")) == left.count("<p>")


def test_deep_page_with_stray_end_tags_is_read_in_linear_time():
    page = html_text.Page("<div>" * 20000 + "</span>" * 20000 + "<svg>" * 20000 + A)
    assert page.texts[-1] == A


def test_query(spark, tmp_path):
    """The query itself: whole texts, null html, repeated rows, an empty table, extra columns."""
    rows = [(1, "u", PAGES["article"][0], "x"), (1, "u", PAGES["article"][0], "x"), (2, None, None, "y"), (3, "v", f"<article><p>{A}</p>" + f"<p>{B}</p>" * 9000 + "</article>", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(html_text.op7_html_text(spark, str(tmp_path)).collect(), key=lambda r: r["page_id"])
    assert [(r["page_id"], r["url"]) for r in got] == [(1, "u"), (1, "u"), (2, None), (3, "v")]
    assert [r["text"] for r in got] == [f"{A}\n{B}", f"{A}\n{B}", "", "\n".join([A] + [B] * 9000)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert html_text.op7_html_text(spark, str(tmp_path / "none")).count() == 0


LONG_LINE = "The council met on Tuesday evening and decided, after a long debate, to repair the old bridge over the river before winter comes."
FRAME = '<html><body{0}><nav><a href="/">Home</a> <a href="/n">News</a></nav>{1}<footer>© 2020 The Paper. <a href="/i">Imprint</a></footer></body></html>'


@pytest.mark.parametrize(
    "body, article",
    [
        ("", '<div class="content has-comments">{}</div>'),
        ("", '<article style="overflow:hidden">{}</article>'),
        ("", '<article style="overflow: hidden; color: red" data-hidden="1">{}</article>'),
        (' class="newsletter"', '<div class="article">{}</div>'),
        (' class="single no-sidebar comments-open"', '<div class="main no-sidebar">{}</div>'),
        ("", '<article class="with-sidebar without-footer">{}</article>'),
        ("", '<div class="post-content" hidden="until-found">{}</div>'),
    ],
)
def test_classes_that_tell_of_other_parts(body, article):
    page = FRAME.format(body, article.format(f"<p>{LONG_LINE}</p><p>{LONG_LINE} Again.</p>"))
    assert html_text.main_texts([page], *html_text.train()) == [f"{LONG_LINE}\n{LONG_LINE} Again."]


@pytest.mark.parametrize("attrs", ['style="display:none"', "style='color:red; display : none'", "hidden", 'hidden=""', 'aria-hidden="true"', 'style="visibility:hidden"', 'class="is-hidden"'])
def test_elements_that_are_not_seen(attrs):
    page = FRAME.format("", f"<article><p>{LONG_LINE}</p><div {attrs}><p>{LONG_LINE} Unseen.</p></div><p>{LONG_LINE} Again.</p></article>")
    assert "hidden" in html_text.element_words("div", " " + attrs)
    assert "Unseen" not in html_text.main_texts([page], *html_text.train())[0]


def test_kept_columns(spark):
    d = spark.createDataFrame([(1, "u", "t", f"<article><p>{LONG_LINE}</p><p>{LONG_LINE}</p></article>")], "page_id long, url string, text string, html string")
    got = html_text.extract(d, keep=("text", "url"))
    assert got.columns == ["page_id", "url", "text"] and got.first()["text"] == f"{LONG_LINE}\n{LONG_LINE}"
