import pytest

from lexiloom.llm import html_text

LONG = "A sentence of the article that is long enough to be content, as it goes on for a while."


@pytest.mark.parametrize("tag", ['article class="post comments-open"', 'article class="hentry category-social"', 'div id="content" class="no-ads"', 'main class="share"'])
def test_names_do_not_drop_the_article(tag):
    page = f"<body><div class='ads'>Buy this now</div><{tag}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></{tag.split()[0]}></body>"
    assert html_text.main_text(page) == f"Title {LONG} {LONG}"


@pytest.mark.parametrize(
    "page",
    [
        f"<div id=post><h1>T</h1><p>lead</p><div class=body><p>{LONG * 9}</p></div><p>closing</p></div>",
        f"<main><h1>T</h1><article><p>lead</p><p>{LONG * 9}</p></article><p>closing</p></main>",
        f"<article><h1>T</h1><p>lead</p><p>{LONG * 9}</p></article><article><p>closing</p></article>",
        f"<table><tr><td><h1>T</h1><p>lead</p><p>{LONG * 9}</p></td><td>closing</td></tr></table>",
    ],
)
def test_no_part_of_the_article_is_cut(page):
    assert html_text.main_text(page) == f"T lead {LONG * 9} closing"
