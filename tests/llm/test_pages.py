"""Pages whose text stands in several elements, comments and advertisements of many names, and signs that open no tag."""

from __future__ import annotations

import time

import pytest

from plumbline.llm import html_text


def p(n: int, word: str = "word") -> str:
    return f"<p>{' '.join(f'{word}{k}' for k in range(n))}</p>"


@pytest.mark.parametrize("around", ["{}", "<main>{}</main>"])
def test_sibling_articles_are_kept(around):
    text = html_text.main_text(f"<body>{around.format(f'<article>{p(120)}</article><article>{p(9, "short")}</article>')}</body>")
    assert "word119" in text and "short0" in text and "short8" in text
    teaser = '<article class="teaser"><p>buy <a href="/x">this thing here now</a></p></article>'
    assert "thing" not in html_text.main_text(f"<body>{around.format(f'<article>{p(120)}</article>{teaser}')}</body>")


def test_a_short_article_beside_a_longer_element():
    text = html_text.main_text(f"<body><article>{p(9, 'short')}</article><div>{p(120)}{p(80, 'more')}</div></body>")
    assert "short0" in text and "word119" in text and "more79" in text


def test_a_marked_wrapper_of_the_whole_text():
    text = html_text.main_text(f'<article><div class="social">{p(60, "one")}{p(50, "two")}</div></article>')
    assert "one0" in text and "two49" in text
    text = html_text.main_text(f'<article>{p(60)}{p(50)}<div class="social"><p>share this on all the networks you know</p></div></article>')
    assert "networks" not in text and "word59" in text
    text = html_text.main_text(f'<body><div class="comments">{p(200, "bad")}</div><article>{p(20)}</article></body>')
    assert "bad0" not in text


@pytest.mark.parametrize("name", ["comment-thread", "commentlist", "c-comments__thread", "user-feedback", "reply-list", "ad-300x250", "adsense-unit", "outbrain-ad", "sponsored-links"])
def test_comments_and_advertisements_by_their_class(name):
    text = html_text.main_text(f'<body><article>{p(80)}</article><div class="{name}">{p(60, "bad")}{p(30, "bad")}</div></body>')
    assert "bad" not in text and "word79" in text


@pytest.mark.parametrize("name", ["post has-comments", "no-ads", "comments-open", "commentary", "reading-room", "road"])
def test_words_that_only_tell_a_state(name):
    assert "word79" in html_text.main_text(f'<body class="{name}"><article class="{name}">{p(80)}</article></body>')
    assert "word79" in html_text.main_text(f'<body><div class="{name}">{p(80)}</div></body>')


@pytest.mark.parametrize("signs", ["<a ", '<a x="', "<!--", "</", "<", "<?", "<![CDATA[", "<!x ", '<a x="' + "y" * 3000, "<script "])
def test_signs_that_open_no_tag_take_time_in_proportion(signs):
    begin = time.process_time()
    text = html_text.main_text(f"<article>{p(30)}</article>" + signs * (400_000 // len(signs)))
    assert time.process_time() - begin < 6 and "word29" in text


def test_closing_leaves_whole_tags_and_comments_alone():
    page = f'<p>a <img src="data:{"A" * 9000}" alt="x > y"> b <!-- {"c" * 9000} <i --> d <a href=x>e</a></p>'
    assert html_text.closed(page) == page and html_text.main_text(f"<article>{page}</article>") == "a b d e"
    assert html_text.closed("x <b " + "y" * 5000) == "x &lt;b " + "y" * 5000
    assert html_text.closed("<b y>" * 3) == "<b y>" * 3
