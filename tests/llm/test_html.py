"""Main text: names decide nothing alone, forms can wrap pages, cost follows the page."""

import time

import pytest

from voltloom.llm import html_text

LONG = ("word " * 100).strip()
SHORT = ("mid " * 33).strip()


@pytest.mark.parametrize("name", "register search legal tags share skip form copyright social related".split())
def test_ambiguous_names_remove_nothing_from_a_passage(name):
    middle = f'<p>{LONG}</p><p class="{name}">{SHORT}</p><p id="{name}-box">tiny</p><p>{LONG}</p>'
    want = "\n".join([LONG, SHORT, "tiny", LONG])
    assert html_text.main_text(f"<article>{middle}</article>") == want
    assert html_text.main_text(f"<div>{middle}</div>") == want


def test_forms_wrap_pages_or_go():
    article = f"<article><p>{LONG}</p></article>"
    assert html_text.main_text(f"<body><form id=aspnetForm>{article}</form></body>") == LONG
    assert html_text.main_text(f"<body><form method=post><div><p>{LONG}</p><p>{SHORT}</p></div></form><footer>about us</footer></body>") == f"{LONG}\n{SHORT}"
    assert html_text.main_text(f"<body><div><p>{LONG}</p></div><form><p>{SHORT}</p></form></body>") == LONG


def test_blocks_beside_the_text():
    assert html_text.main_text(f"{'<p>' + LONG + '</p>'}<div class='related'><p>{SHORT}</p></div>") == LONG
    assert html_text.main_text(f"<article><p>{LONG}</p></article><div><p>{SHORT}</p></div>") == LONG
    assert html_text.main_text('<p>Short note.</p><div class="copyright">Copyright 2020</div>') == "Short note."


@pytest.mark.parametrize("block", ["<div><p>{}</p></div>", "<p>{}</b>", "<p>{}", "<div class=legal>{}</div>"])
def test_cost_follows_the_page(block):
    began = time.process_time()
    html_text.main_text("<div>" + block.format("word " * 20) * 80_000 + "</div>")
    assert time.process_time() - began < 5
