import pytest
from tidebar.llm.html_text import extract
from test_html_text import NOISE, TAIL, P, Q, page

LONG = " ".join([P, Q] * 3)


@pytest.mark.parametrize("attrs", ['class="content has-sidebar"', 'id="menu-page"', 'class="nav-open"', 'role="search"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_marked_wrapper_does_not_empty_a_page(attrs, inner):
    body = f"<{inner}><h1>The mill</h1><p>{P}</p><p>{Q}</p></{inner}>"
    assert extract(page(f"<div {attrs}>{NOISE}{body}{TAIL}</div>")) == "\n".join(["The mill", P, Q])


@pytest.mark.parametrize("word", ["notice", "related", "social", "search", "share", "widget"])
def test_prose_under_weak_marks_stays_in_the_article(word):
    body = f'<article><p>{P}</p><p class="{word}">{Q}</p><div class="{word}"><a href="/1">One</a> <a href="/2">Two</a></div><p>{P}</p></article>'
    assert extract(page(body, NOISE, TAIL)) == "\n".join([P, Q, P])


def test_long_comments_beside_an_article_stay_out():
    assert extract(page(f'<article><p>{P}</p></article><div id="comments"><p>{LONG}</p></div>')) == P


def test_long_quote_keeps_its_surroundings():
    body = f"<div><p>{P}</p><blockquote><p>{LONG}</p></blockquote><p>{Q}</p></div>"
    assert extract(page(body, NOISE, TAIL)) == "\n".join([P, LONG, Q])


@pytest.mark.parametrize("outer", ["section", "article", "div"])
def test_sibling_sections_all_stay(outer):
    body = f"<div><{outer}><h2>One</h2><p>{P}</p><p>{Q}</p><p>{P}</p></{outer}><{outer}><h2>Two</h2><p>{Q}</p><p>{P}</p></{outer}></div>"
    assert extract(page(body, NOISE, TAIL)) == "\n".join(["One", P, Q, P, "Two", Q, P])


@pytest.mark.parametrize("first, item, last", [("<ul>", "<li>{}</li>", "</ul>"), ("<dl>", "<dd>{}</dd>", "</dl>"), ("<table>", "<tr><td>{}</td></tr>", "</table>")])
def test_lists_without_an_article_element(first, item, last):
    two = first + item.format(P) + item.format(Q) + item.format(P) + last + first + item.format(Q) + item.format("Short.") + last
    assert extract(page(f"<div>{two}</div>", NOISE, TAIL)) == "\n".join([P, Q, P, Q, "Short."])


def test_link_lists_inside_the_container_go():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Other story {i}</a></li>' for i in range(6)) + "</ul>"
    assert extract(page(f"<article><p>{P}</p>{links}<p>{Q}</p></article>")) == f"{P}\n{Q}"
