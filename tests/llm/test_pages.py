"""Main text of pages with layout classes, headings in headers, and without an article."""

from __future__ import annotations

import time

import pytest

from corpuslab.llm import html_extract

P = "<p>A paragraph of the article with quite enough words to be running text in any page at all.</p>"
T = "A paragraph of the article with quite enough words to be running text in any page at all."


def text(page):
    return html_extract.main_text(page, html_extract.fit_tree())


def test_wrappers_do_not_mark_the_article():
    for name in ("class='layout has-sidebar'", "id='page' class='no-sidebar'", "class='with-nav'", "class='sidebar-right'", "class='search'"):
        assert text(f"<div {name}><article>{P}{P}</article><div class='sidebar'>Side words.</div></div>") == f"{T}\n\n{T}", name
    assert text(f"<article>{P}<p class='legal-basis'>The law says so.</p>{P}</article>") == f"{T}\n\nThe law says so.\n\n{T}"


def test_headings_stay():
    assert text(f"<article><header class='entry-header'><h1>Title</h1><p>By me</p></header>{P}<h2 class='section-header'>Part</h2>{P}</article>") == f"Title\n\n{T}\n\nPart\n\n{T}"
    assert text(f"<article><header class='header'><h1>Title</h1></header>{P}</article>") == f"Title\n\n{T}"


def test_parts_of_other_kinds_still_go():
    for name in ("ad", "related-posts", "share-buttons share", "cookie-notice", "comments-area"):
        assert text(f"<article>{P}<div class='{name}'>Not of it.</div>{P}</article>") == f"{T}\n\n{T}", name
    assert text(f"<main>{P}{P}<section class='comments'><article class='c'>{P}</article></section></main>") == f"{T}\n\n{T}"


def test_short_blocks_and_small_articles():
    q = f"<p>{' '.join(['word'] * 40)}</p>"
    assert "Short line of text." in text(f"<body>{q}<p>Short line of text.</p><p>{' '.join(['more'] * 15)}</p>{q}</body>")
    assert text(f"<body>{q * 6}<article><p>Teaser.</p></article></body>").count("word") == 240


def test_names_that_hold_a_mark_by_chance():
    for name in ("class='entry no-sidebar'", "class='share-price'", "id='search-results'"):
        assert text(f"<article><div {name}>{P}</div>{P}</article>") == f"{T}\n\n{T}", name


def test_menus_without_a_name_fall_inside_an_article():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Part {i}</a></li>" for i in range(6)) + "</ul>"
    got = text(f"<article><h1>Title</h1>{P}{menu}{P}</article>")
    assert got.startswith("Title") and got.count(T) == 2 and sum(f"Part {i}" in got for i in range(1, 5)) == 0
    assert "See the report" in text(f"<article>{P}<p><a href='/r'>See the report</a></p>{P}</article>")


def test_wrapping_form_and_little_text():
    q = f"<p>{' '.join(['word'] * 100)}</p>"
    assert text(f"<body><form action='/x'>{q * 4}</form></body>").count("word") >= 200
    assert text("<div class='content'><p>Short one.</p></div>") == "Short one."
    assert text("<body><footer>Short one.</footer></body>") == ""


def test_no_flag_decides_alone():
    """Blocks of the table that agree in all flags, but not in the answer, are told apart by words and links."""
    seen: dict[tuple, set] = {}
    for row, y in html_extract.TABLE:
        seen.setdefault(row[6:9] + row[10:], set()).add(y)
    assert sum(len(x) == 2 for x in seen.values()) >= 3
    used = set()

    def walk(node):
        if node.feature >= 0:
            used.add(html_extract.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(html_extract.fit_tree())
    assert {"words", "links", "words_before", "words_after"} <= used or {"words", "links", "links_before", "words_after"} <= used


def test_features_are_those_of_the_blocks():
    """Words and links of each block and its neighbours, counted plainly."""
    page = "<nav><a href=1>Home page</a></nav><article><h1>One two</h1><p>a b <a href=2>c d</a> e</p><div class='ad'>Buy now please</div></article>"
    want = [("Home page", 2, 2, 0, 1, 0), ("One two", 2, 0, 1, 0, 0), ("a b c d e", 5, 2, 1, 0, 0), ("Buy now please", 3, 0, 1, 0, 1)]
    found = html_extract.blocks(page)
    assert [b.text for b in found] == [w[0] for w in want]
    for i, row in enumerate(html_extract.rows_of(found)):
        at = lambda k: (want[k][1], want[k][2] / want[k][1]) if 0 <= k < len(want) else (0, 0.0)
        assert row[:6] == (*at(i), *at(i - 1), *at(i + 1)) and (row[6], row[7], row[8]) == (bool(want[i][3]), bool(want[i][4]) or i == 0, bool(want[i][5]))


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<a '" * 250_000, "<span>" * 80_000 + "</b>" * 120_000, "<td>" + "<div><p>" * 120_000, "<a '>' " * 150_000, "<h2>x" * 200_000, "<!-- " * 200_000, "<p>" + "&amp;" * 200_000])
def test_broken_pages_of_a_megabyte(page):
    began = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - began < 8
