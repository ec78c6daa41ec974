"""Main texts of hand-made pages."""

from __future__ import annotations

import time

import pytest

from sheetlake.llm import html_density as H

P1 = "The first paragraph is long enough to be read as running text, with a comma or two."
P2 = "A second paragraph follows it; it says little more than the first one did, but it says it."
P3 = "And a third, so that the article is more than a line."
BODY = f"<h1>Title &amp; more</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"Title & more {P1} {P2} {P3}"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(12)) + "</ul>"


@pytest.mark.parametrize("html", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav>{MENU}</nav><!-- ad -->"
    f"<div class='ad'>Buy this now, it is cheap.</div><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    f"<body><header><h2>Site</h2>{MENU}</header><div id='content'>{BODY}</div><div class='sidebar'>{MENU} news</div></body>",
    f"<body><div><div class='top menu'>{MENU}</div><main>{BODY}</main></div><section id='comments'><p>{P1}</p><p>{P2}</p></section></body>",
    f"<body><form><p>{P2}</p><input></form><div class='wrap'><div class='x'>{MENU}</div><article>{BODY}"
    f"<div class='comment-list'><p>{P2}</p></div></article></div><div class='cookie-notice'>{P1}</div>",
    f"<div class=story>{BODY}</div>",
    f"<article>{BODY}</article",
    f"<article><h1>Title &amp; more<p>{P1}<p>{P2}<p><b>{P3.split()[0]}</b> {' '.join(P3.split()[1:])}",
    f"<body><article><h1>Title\n&#38;\t more</h1><p>{P1.replace(' ', chr(10))}</p><div>{P2}</div><p>{P3}</p>"
    f"<aside>{P1}</aside></article><p class='ads'>{P2}</p></body>",
])
def test_article(html):
    assert H.article(html) == TEXT


def test_small_cases():
    assert H.article(None) == H.article("") == H.article("<p> </p>") == H.article("<script>x</script>") == ""
    assert H.article("plain words  only") == "plain words only"
    assert H.article("<p>a<b>b</b>c</p><p>d</p>") == "abc d"
    assert H.article("<article><p>x<br>y</p></article>").split() == ["x", "y"] or H.article("<article><p>x<br>y</p></article>") == "xy"
    assert H.article("<article><p>" + "<b>" * 3000 + "deep") == "deep"


def test_link_text_weighs_little():
    page = H.Tree()
    page.feed(f"<body><div>{MENU * 3}</div><div><p>{P1}</p><p>{P2}</p></div></body>")
    page.close()
    H.measure(page.body)
    menu, text = (n for n in page.body.children)
    assert text.density > 5 * menu.density


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", 5), (None, None, None, None), (3, "v", "", 1), (3, "v", "", 1),
            (4, "w", "<article><p>" + "word " * 200_000, 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.main_texts(frame).collect()}
    assert out[1, "u"] == (TEXT, len(TEXT)) and out[None, None] == ("", 0) and out[4, "w"][1] == 999_999
    assert H.main_texts(frame).count() == 5 and H.main_texts(frame.limit(0)).isEmpty()


@pytest.mark.parametrize("mark", ["site has-sidebar", "page with-nav", "no-ad content", "content has-comments", "overflow-hidden"])
@pytest.mark.parametrize("html", [
    f"<body><div class='MARK'><article>{BODY}</article></div><p>{P3}</p></body>",
    f"<body><div class='MARK'><div class='MARK'><main>{BODY}</main></div><section class='comments'><article><p>{P1}</p></article></section></div>",
    f"<body><div class='MARK'>{BODY}<div class='comments'><p>{P3}</p></div></div></body>",
    f"<body><form class='MARK'><nav>{MENU}</nav><div>{BODY}</div></form><div class='ad'>{P3}</div></body>",
    f"<body><article>{BODY}<aside><article><p>{P1}</p></article></aside></article><div class='MARK'>{P1 * 9}</div></body>",
])
def test_marks_on_wrappers(html, mark):
    assert H.article(html.replace("MARK", mark)) == TEXT


TEASER = "<div><a href='/t'>A teaser of another story, linked as a whole</a><a href='/u'>and one more of them</a></div>"


@pytest.mark.parametrize("html", [
    f"<body><div class='page'><div>{MENU}</div><div>{BODY}</div></div></body>",
    f"<body><div><div><div>{MENU}</div></div><div><div>{BODY}</div></div><div>{TEASER}{MENU}</div></div></body>",
    f"<body><div><div>{BODY}</div><div>{TEASER * 4}</div></div></body>",
    f"<body><div><table><tr><td>{MENU}</td><td>{BODY}</td><td>{TEASER}</td></tr></table></div></body>",
    f"<body><div><div>{BODY}{MENU}</div></div></body>",
    f"<body><main><article>{BODY}</article>{MENU}</main></body>",
    f"<body><main><div>{BODY}</div><div>{MENU}</div></main></body>",
    f"<body><article><p>{P3}</p><article>{BODY}</article>{MENU}</article></body>",
    f"<body><div><div>{BODY}</div><div>{'<div>side</div>' * 8}</div></div></body>",
    f"<body><div>{MENU}</div><div>{BODY}</div><div>{MENU}</div></body>",
])
def test_unmarked_boilerplate_is_left_out(html):
    assert H.article(html) == TEXT


def test_short_and_linked_parts_of_the_text_stay():
    link = "See <a href='/x'>this</a> and <a href='/y'>that</a>."
    inside = f"<body><div><div>{MENU}</div><div>{BODY}<p>Yes.</p><p>{link}</p><ul><li>milk</li><li>eggs</li></ul></div></div></body>"
    assert H.article(inside) == f"{TEXT} Yes. See this and that. milk eggs"
    beside = f"<body><div><h1>Head</h1><p>Yes.</p><div>{BODY}</div><div>{MENU}</div></div></body>"
    assert H.article(beside) == f"Head Yes. {TEXT}"
    halves = f"<body><div><div>{BODY}</div><div>{MENU}</div><div><p>{P1}</p><p>{P2}</p></div></div></body>"
    assert H.article(halves) == f"{TEXT} {P1} {P2}"


@pytest.mark.parametrize("part,text", [
    ("<p>Some <b class='ad'>bold</b> words</p>", "Some bold words"), ("<p>An <span class='alert'>alert</span> word</p>", "An alert word"),
    ("<p><em class='notice'>Mind</em> it</p>", "Mind it"), ("<div class='share-price'>The share price rose by a tenth.</div>", "The share price rose by a tenth."),
    ("<section id='search-algorithms'><p>Binary search halves.</p></section>", "Binary search halves."),
    ("<div class='share-buttons'>Tell others</div>", ""), ("<div id='comments-area'><p>I disagree with all of this, says a reader.</p></div>", ""),
    (f"<div>{MENU}</div>", ""), (f"<div class='share-price'>{MENU}</div>", ""), (f"<section>{MENU}</section>", ""), (MENU, "")])
@pytest.mark.parametrize("html", [f"<body><article>{BODY}PART</article></body>", f"<body><div>{BODY}PART</div></body>",
                                  f"<body><nav>{MENU}</nav><main>{BODY}PART</main><div>{MENU}</div></body>"])
def test_marked_words_in_running_text(html, part, text):
    assert H.article(html.replace("PART", part)) == f"{TEXT} {text}".strip()


@pytest.mark.parametrize("open_,close", [("<div>", "</div>"), ("<div>", ""), ("<ul><li>", ""), ("<table><tr><td>", ""), ("<p><span>", "")])
def test_deep_pages_take_linear_time(open_, close):
    start = time.process_time()
    assert H.article(f"<body>{open_ * 20_000}{BODY}{close * 20_000}</body>") == TEXT
    assert time.process_time() - start < 4
