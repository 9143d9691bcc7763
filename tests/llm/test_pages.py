"""Pages that are never closed, and elements whose class says less than their text."""

import time

import pytest

from sluice.llm import wrappers

HOSTILE = {
    "tags": "<div " * 200_000,
    "quotes": '<div "' * 200_001 + ">",
    "mixed quotes": "<a \"<b '" * 100_000 + ">",
    "a far quote": "<div " * 200_000 + '"x>',
    "declarations": "<!" * 200_000,
    "comments": "<!-- " * 200_000,
    "scripts": "<script" * 100_000 + ">",
    "closing tags": "<span>" * 20_000 + "</b>" * 200_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_is_in_proportion_to_the_page(kind):
    began = time.process_time()
    wrappers.extract(HOSTILE[kind], None)
    assert time.process_time() - began < 4


STORY = "Running text of the story that goes on. " * 6


@pytest.mark.parametrize("name", ["has-sidebar", "social-science", "header-post", "widget"])
def test_most_of_the_text_is_not_noise_by_its_class(name):
    page = f'<body><div class="menu"><a href="/">Home</a></div><div class="{name}"><p>{STORY}</p><div class="promo">Buy now</div></div></body>'
    assert wrappers.extract(page, None) == STORY.strip()


def test_remarks_stay_noise_however_long():
    page = f'<body><div><p>Short story.</p></div><div class="comments"><p>{STORY}</p></div></body>'
    assert wrappers.extract(page, None) == "Short story."


def test_quotes_and_brackets_in_attributes():
    page = "<p title='a > b' data-x=\"c > 'd'\">One <b>two</b></p><p>3 < 4 and <5</p><p class=\"x>y"
    assert wrappers.extract(page, None).split("\n")[:1] == ["One two"]
    assert "3 < 4 and <5" in wrappers.extract(page, None)
