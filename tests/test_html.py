"""Main content of pages without an article or main element."""

import re

import pytest

from quernstone.sources import html

PROSE = "This is a sentence of the story, with commas, and enough of it to count as prose. " * 3
MENU = "".join(f"<li><a href='/{k}'>Menu entry {k} with a long name, and more</a></li>" for k in range(12))


def page(body):
    return f"<html><head><title>t</title><script>var x = '<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("body", [
    f"<div class='menu'><ul>{MENU}</ul></div><div id='content'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='foot'><p>Copyright, all of it, reserved by us</p></div>",
    f"<div><ul>{MENU}</ul></div><div><h1>Title</h1><p>{PROSE}<p>{PROSE}</div><div><ul>{MENU}</ul></div>",
    f"<table><tr><td><ul>{MENU}</ul></td><td><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></td></tr></table>",
    f"<div class='sidebar'><p>Related, and shared, and <a href='x'>linked, all of it, to others</a></p></div><div class='post'><h1>Title</h1><p>{PROSE}</p><blockquote>{PROSE}</blockquote></div>",
])
def test_menus_go(body):
    found = html.html_to_markdown(page(body))
    assert found.count("This is a sentence of the story") == 6 and "Title" in found
    assert "Menu entry" not in found and "Copyright" not in found and "Related" not in found and "var x" not in found


def test_siblings_of_the_best_part():
    body = f"<div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p><p>short</p><div class='ads'><a href='x'>{PROSE}</a></div><div><p>{PROSE}</p><p>{PROSE}</p></div>"
    found = html.html_to_markdown(page(f"<div id='wrap'>{body}</div>"))
    assert found.count("This is a sentence") >= 15 and "](x)" not in found


@pytest.mark.parametrize("text", ["", "plain text", "<p>one</p>", "<div>" * 300 + PROSE, "<p>" * 50 + PROSE, "</div></p>", "<a href=x>" + PROSE, "<div\n\nclass=\nx><p>" + PROSE, "\x00<b", f"<p>{PROSE}</p><p>{PROSE}</p>", f"<h2>Head</h2>{PROSE}"])
def test_nothing_is_lost_where_nothing_stands_out(text):
    found = html.html_to_markdown(text)
    for word in re.findall(r"sentence|one|Head|plain", re.sub("<[^>]*>?", " ", text)):
        assert word in found


def test_raw_markdown():
    assert html.raw_markdown("https://raw.githubusercontent.com/a/b") and html.raw_markdown(" https://x/Y.MD ") and not html.raw_markdown("https://x/md") and not html.raw_markdown(None)
