"""Markup that is cut off or badly quoted, and class names that name furniture or only sound like it."""

import time

import numpy as np
import pytest

from tallyloom.llm import pages

TREE = pages.grown(np.array(pages.LABELLED, float))
BODY = "<h1>A heading</h1><p>" + "some words of the text " * 12 + "</p><p>" + "last words " * 10 + "</p>"
LINKS = "<ul>" + "<li><a href='/'>another page</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize("start", ["<img ", "<p><a ", "</div "])
@pytest.mark.parametrize("attribute", ['a{}="v"', "a{}='v'", "a{}", 'a{}="', "a{}='\"", '"', "a{}=\"v' "])
def test_cut_off_tags_end_with_the_page(start, attribute):
    for count in (20, 1_000, 20_000):
        page = f"<main>{BODY}" + start + " ".join(attribute.format(i) for i in range(count))
        began = time.process_time()
        text = pages.main_text(page, TREE)
        assert time.process_time() - began < 1
        assert text.startswith("A heading\nsome words") and text.count("last words") == 10


def test_many_cut_off_tags():
    began = time.process_time()
    for piece in ('<img a="', "<p class='x", "<a b=\"'", "<", "<!", "<!--"):
        pages.main_text(f"<main>{BODY}" + piece * 20_000, TREE)
    assert time.process_time() - began < 5


def test_quotes_that_do_not_pair():
    assert pages.main_text(f'<main>{BODY}<p class="x>Hello there, all of you</p></main>', TREE).endswith("Hello there, all of you")
    assert pages.main_text(f"<main>{BODY}<p title='a > b < c'>Hello there, all of you</p></main>", TREE).endswith("\nHello there, all of you")


@pytest.mark.parametrize("name", ["header-fixed", "site-header-wrap no-header", "has-sidebar", "nav-open"])
@pytest.mark.parametrize("body", [BODY, f"<article>{BODY}</article>", f"<main>{BODY}</main>"])
def test_layout_names_around_the_page(name, body):
    text = pages.main_text(f'<div class="{name}"><nav>{LINKS}</nav>{body}<div class="site-footer">All rights reserved here</div></div>', TREE)
    assert text.startswith("A heading\nsome words") and text.endswith("last words")


@pytest.mark.parametrize(
    "name, kept",
    [("social-contract", 1), ("related-work", 1), ("notice-text", 1), ("content-ad", 0), ("notice", 0), ("comments", 0), ("newsletter-box", 0), ("ad", 0)],
)
def test_names_within_the_article(name, kept):
    page = f'<main>{BODY}<div class="{name}"><p>A paragraph of the marked section with words</p></div><p>And one more paragraph at the end</p></main>'
    text = pages.main_text(page, TREE)
    assert ("marked section" in text) == bool(kept) and text.endswith("And one more paragraph at the end")


def test_links_within_the_article():
    page = f'<main>{BODY}<div class="related-posts">{LINKS}</div><p>And one more paragraph at the end</p></main>'
    assert "another page" not in pages.main_text(page, TREE)
