"""Pages whose wrappers, titles and sibling articles must not be lost."""

from pathlib import Path

import pytest

from ordinata.llm import html_text, queries

SF = "/root/testdata/sf0.001"
STORY = "<p>" + "</p><p>".join("word " * 30 + str(i) for i in range(4)) + "</p>"
MENU = '<nav><a href="/">home</a></nav><ul><li><a href="/a">one link</a></li><li><a href="/b">another link</a></li></ul>'


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page-with-sidebar">{menu}<div class="story">{title}{story}</div></div>', '<div class="content has-sidebar">{title}{story}</div>',
        '<div class="main sidebar-left">{menu}<div>{title}{story}</div><div class="sidebar">text at the side</div></div>',
        '<form id="aspnetForm"><input name=x>{menu}<div>{title}{story}</div><div class="comments"><p>reader reader</p></div></form>', '<div class="ad-hoc-analysis">{title}{story}</div>',
        '<div class="related-work">{title}{story}</div><div class="user-comments-list"><a href="/c">many readers said</a></div>', '<div class="head">{title}</div><div class="story">{story}</div><div class="footer">x</div>',
        '{menu}<div class="top">{title}</div><article>{story}</article>', '<article>{title}<p role="alert">{first}</p>{rest}</article>',
    ],
)
def test_wrappers_and_titles_stay(page):
    first, rest = STORY[3:].split("</p>", 1)
    html = f"<html><body>{page.format(menu=MENU, title='<h1>Its title</h1>', story=STORY, first=first, rest=rest)}</body></html>"
    assert html_text.main_text(html) == "\n\n".join(["Its title", *("word " * 30 + str(i) for i in range(4))])


def test_comments_go_even_if_they_are_long():
    said = f'<div id="comments"><p>{"reader " * 3000}</p></div>'
    assert html_text.main_text(f"<body><div><h1>T</h1><p>One two three.</p></div>{said}</body>") == "T\n\nOne two three."


def test_sibling_articles_stay():
    a, b = f"<h2>One</h2><p>{'alpha ' * 30}x</p><p>{'beta ' * 20}y</p>", f"<h2>Two</h2><p>{'gamma ' * 25}z</p>"
    card = '<article class="card"><a href="/q">read more about it here</a></article>'
    text = "\n\n".join(["One", "alpha " * 30 + "x", "beta " * 20 + "y", "Two", "gamma " * 25 + "z"])
    assert html_text.main_text(f"<body><div><article>{a}</article><article>{b}</article>{card}</div></body>") == text


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_page_columns(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4_text_density(spark, SF).collect():
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
