"""The curve chooses the text, on pages that mark no article too; and every page is read in one pass."""

import random
import time

import pytest

from jobgrain.llm import linetext

WORDS = "Words of a story that goes on for a while, as they do. "


def brute(lines, window, surge):
    """The curve by its definition: lines is what lines_of gives."""
    marked = any(inside and text for text, _, inside, _ in lines)
    rows = []
    for text, linked, inside, emptied in lines:
        rows += [("", 0)] * window if emptied else []
        plain = len(text) - linked
        if text:
            rows.append((text, plain if not marked else len(text) + surge if inside else plain if plain >= 8 * surge else 0))
    total = lambda i: sum(w for _, w in rows[i : i + window])
    level = min(surge, max((total(i) for i in range(len(rows))), default=0) / 2)
    kept, at, found = [], 0, []
    while at < len(rows):
        if rows[at][1] == 0:
            at += 1
            continue
        end = at
        while True:  # the next line with weight that fewer than `window` lines without part from this one
            nxt = next((j for j in range(end + 1, min(len(rows), end + window + 1)) if rows[j][1]), None)
            if nxt is None:
                break
            end = nxt
        found.append((at, next((i for i in range(at, end + 1) if rows[i][1] and total(i) >= level), None), end))
        at = end + 1
    strong = [k for k, f in enumerate(found) if f[1] is not None]
    for k in range(strong[0], strong[-1] + 1) if strong else ():
        first, surged, end = found[k]
        kept += [t for t, _ in rows[surged if k == strong[0] else first : end + 1] if t]
    return "\n".join(kept)


@pytest.mark.parametrize("seed", range(40))
def test_matches_the_definition(seed):
    rng = random.Random(seed)

    def block():
        n = rng.choice((1, 2, 4, 9, 30))
        return rng.choice((f"<p>{'word ' * n}</p>", f"<p>{'word ' * n}</p>", f"<li><a href=/>{'link ' * n}</a>", "<div class=ad>Buy</div>", f"<div>a <a>{'l ' * n}</a></div>", "<hr>"))

    parts = [block() for _ in range(rng.randrange(0, 40))]
    if seed % 3 == 0:
        a, b = sorted(rng.sample(range(len(parts) + 1), 2)) if len(parts) > 1 else (0, 0)
        parts = [*parts[:a], "<article>", *parts[a:b], "</article>", *parts[b:]]
    html = "<body>" + "".join(parts)
    for window, surge in ((3, 40), (1, 10), (5, 100)):
        assert linetext.main_text(html, window, surge) == brute(linetext.lines_of(html), window, surge)


def test_choice_follows_the_curve():
    page = lambda teaser, story: f"<div>{teaser}</div>" + "<p><a href=/>More</a></p>" * 3 + f"<div><p>{story}</p><p>End.</p></div>" + "<p><a href=/>More</a></p>" * 3 + "<div>Imprint</div>"
    story = (WORDS * 3).strip()
    assert linetext.main_text(page("Read this", story)) == f"{story}\nEnd."
    assert linetext.main_text(page(story, "Read this")) == story  # the same blocks, other lengths
    assert linetext.main_text(page("Little", "Short")) == "Little\nShort\nEnd.\nImprint"  # a page of little text has a low level
    assert linetext.main_text(page("Read this", story), surge=1) == f"Read this\n{story}\nEnd.\nImprint"


def test_marks_are_evidence_beside_the_lengths():
    story = (WORDS * 8).strip()
    assert linetext.main_text(f"<div>Read this too, it is new.</div><article><p>Short.</p><p>{story}</p></article><div>And that.</div>") == f"Short.\n{story}"
    assert linetext.main_text(f"<article><p>Teaser.</p></article><div><p>{story}</p></div>") == f"Teaser.\n{story}"


@pytest.mark.parametrize("html, want", [
    ('<article><p class="x"">Hello you</p></article>', "Hello you"),
    ('<article><p title=">">One</p><p title=\'a"\'>Two</p></article>', "One\nTwo"),
    ('<article><p a="1"b=\'2\'c>One</p></article>', "One"),
    ("<article><p>1 < 2 & 3 <4</p></article>", "1 < 2 & 3 <4"),
    ("<article><p>a</></p><p>b</1></p></article>", "a\nb"),
    ("<article><p>a<!-- x > y --><? php ?><!DOCTYPE z></p></article>", "a"),
    ("<article><header><h1>Head</h1><p>Lead</p></header><p>Body</p><footer>By me</footer></article>", "Head\nLead\nBody"),
    ('<article><div class="related-work"><p>Others did so.</p></div><div class="related">More</div><div class="ad-slot-3">Buy</div></article>', "Others did so."),
    ("<article><p>In <b>bold <i>both</b> still</i> more</p></article>", "In bold both still more"),
    ("<header><p>Site</p></header><article><p>a</p><aside><p>b</p></aside><p>c</p></article>", "a\nc"),
])
def test_tags_as_browsers_read_them(html, want):
    assert linetext.main_text(f"<html><body>{html}") == want


@pytest.mark.parametrize("piece", ["<aaa", "<b ", "<b>x", "<b>x</i>", "<div>", "<div></section>", "<span class=ad>", '<a x="', "<a x='", "<li><div>", "&", "< ", "<!-", "<svg><p>", "<object><p>", "<script>", "<title></title ", "\n", "<p><td><div>"])
def test_hostile_pages_take_linear_time(piece):
    def took(n):
        html = piece * (n // len(piece))
        start = time.process_time()
        linetext.main_text(html)
        return time.process_time() - start

    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.01)
