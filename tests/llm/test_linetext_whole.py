"""Articles are kept whole, whatever their links, short blocks and inline elements."""

import pytest

from jobgrain.llm import linetext

LONG = ("Words of a story that goes on for a while. " * 3).strip()


@pytest.mark.parametrize("html, want", [
    ("<article><p>para</p><p><a>Linked paragraph</a></p><p>next</p></article>", ["para", "Linked paragraph", "next"]),
    ("<article><p><a href=/>First is a link</a></p><p>para</p><ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul></article>", ["First is a link", "para", "one", "two", "three", "four"]),
    (f"<div><h1>Short title</h1></div><div><p>{LONG}</p></div>", ["Short title", LONG]),
    (f"<div><div><p>{LONG}</p></div></div><div><div><p>The end.</p></div></div>", [LONG, "The end."]),
    (f"<p>{LONG}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><th>1</th><td>2</td></tr></table><p>{LONG}</p>", [LONG, "Year", "Sum", "1", "2", LONG]),
    (f"<p>{LONG}</p><p><a>Linked</a></p><p>{LONG}</p>", [LONG, "Linked", LONG]),
    (f"<p>{LONG}</p><div class=ad>Buy</div><p>Short.</p><div class=ad>Buy</div><p>{LONG}</p>", [LONG, "Short.", LONG]),
    (f"<ul>{'<li><a>Link</a>' * 5}</ul><p>{LONG}</p><ul>{'<li><a>Link</a>' * 5}</ul><p>Imprint</p>", [LONG]),
])
def test_blocks_of_an_article_stay(html, want):
    assert linetext.main_text(f"<html><body>{html}</body></html>").split("\n") == want


@pytest.mark.parametrize("inline", [
    '<svg class="icon"/>', "<math/>", '<svg viewBox="0 0 1 1"><title>t</title><path d="M0"/><g><circle r="1"/></g><text>no</text></svg>', "<svg><path d='M0'></svg>",
    "<object data=x>", "<canvas>", "<select><option>no", "<template>no", "<object><p>no</p></object>", "<template><p>no</p></template>",
])
def test_inline_elements_hide_themselves_alone(inline):
    html = f"<article><div>{inline}</div><p>One {inline}</p><p>two</p></article><svg></svg>"
    assert linetext.main_text(html) == "One\ntwo"
