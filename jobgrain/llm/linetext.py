"""Main text of web pages by the distribution of text over their lines of blocks."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are never text of an article.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas select option textarea button form input head title nav header footer aside menu dialog".split())
#: Elements of one tag, without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line of text of their own; br does too, but inside a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Names in class, id or role of what surrounds an article.
AROUND = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies
consent disqus disclaimer footer gdpr header menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup privacy promo promos promotion
recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets""".split())
#: Words beside such a name that say no more than what kind of box it is.
BOX = frozenset("""area articles bar block bottom box button buttons center col column container content count form global group inner item items left links list main module outer page panel
popular post posts primary right row secondary section site slot stories thread top unit wrap wrapper""".split())
#: Elements that close an open p, and those that a sibling of the same kind closes.
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: Elements whose names say nothing of this kind: whole pages, articles, and their headings.
WHOLE = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Names of what readers say.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Boxes that may hold adverts or comments inside an article.
BOXES = frozenset("div aside section ul ol dl table figure ins".split())
#: Elements whose content is text up to their own end, whatever it looks like.
RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: Elements of other languages, in which a tag may close itself.
FOREIGN = frozenset(("svg", "math"))
#: Elements whose content closes nothing outside, if they are closed themselves.
APART = tuple(FOREIGN | {"object", "template", "canvas", "select"})

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: One attribute, or the end of the tag. A quote that does not open a value is part of a name, as browsers read it.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


def _surrounds(name: str, attributes: list[tuple[str, str]], in_article: bool, inside: bool = False) -> bool:
    """Whether an element holds what surrounds an article, by its tag, class, id, role or hiding. The header of an article is its own. inside: within an article or main element."""
    if name in HIDDEN and not (name == "header" and in_article):
        return True
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NONE.search(value):
            return True
        # inside a marked article a name is no proof for its own paragraphs, headings and inline elements; a box's class is one, its id
        # only of readers' comments
        named = key == "role" or key in ("class", "id") and (not inside or name in BOXES)
        if named and name not in WHOLE and any(map(_names_around, value.lower().split())):
            if key != "id" or not inside or not READERS.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
                return True
    return False


def _names_around(word: str) -> bool:
    """Whether one class name says so: it consists of such names, kinds of boxes and numbers. 'related-work' or 'has-sidebar' say
    something else."""
    parts = [p for p in re.split(r"[^a-z0-9]+", word) if p and not p.isdigit()]
    return not AROUND.isdisjoint(parts) and all(p in AROUND or p in BOX for p in parts)


class _Lines:
    """Reads a page from left to right, once; every step costs what it reads or closes, whatever the nesting."""

    def __init__(self, html: str):
        self.html = html
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # by name, the places in the stack of its open elements
        self.ends: dict[str, int] = {}
        self.linked = self.hidden = self.articles = 0

    def end_line(self, emptied: bool = False) -> None:
        joined = _SPACE.sub(" ", "".join(self.text)).strip()
        if joined or emptied:
            self.lines.append((joined, min(self.linked, len(joined)), self.articles > 0, emptied))
        self.text.clear()
        self.linked = 0

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, was_hidden = self.stack.pop()
            self.open[name].pop()
            self.hidden -= was_hidden
            if name in BLOCKS:
                self.end_line(was_hidden and not self.hidden)
            self.articles -= name in ("article", "main")

    def add(self, part: str) -> None:
        if part and not self.hidden:
            part = unescape(part) if "&" in part else part
            self.text.append(part)
            if self.open["a"]:
                self.linked += len(part.strip())

    def last(self, *names: str) -> int:
        """The place in the stack of the innermost open element of these names; -1 for none."""
        return max((self.open[n][-1] for n in names if self.open[n]), default=-1)

    def closed_later(self, name: str, at: int) -> bool:
        if name not in self.ends:
            self.ends[name] = max((m.start() for m in re.finditer(rf"</{name}\s*>", self.html, re.I)), default=-1)
        return self.ends[name] >= at

    def close_siblings(self, name: str, at: int) -> None:
        """Elements that this one closes, unless something between keeps them open."""
        for kinds, stops in ((("p",), ("td", "th", "div", "section", "article")) if name in CLOSES_P else ((), ()), (SIBLINGS.get(name, ()), ("ul", "ol", "dl", "table"))):
            place = self.last(*kinds)
            if place >= 0 and place > self.last(*stops, *(n for n in APART if self.open[n] and self.closed_later(n, at))):
                self.close(place)

    def start(self, name: str, attributes: list[tuple[str, str]], closed: bool, at: int) -> int:
        """An element begins; returns where reading goes on."""
        if name == "br":
            self.add(" ")
            return at
        if name == "body":  # a form or menu left open in the head ends here
            self.close(0)
        self.close_siblings(name, at)
        if name in BLOCKS:
            self.end_line()
        if name in VOID or closed and (name in FOREIGN or any(self.open[n] for n in FOREIGN)):
            return at
        if name in RAW:
            end = RAW[name].search(self.html, at)
            return end.start() if end else len(self.html)
        off = _surrounds(name, attributes, bool(self.open["article"]), self.articles > 0)
        # an element that neither parts lines nor hides anything is of no account, but inside one of its own name
        if off or name in BLOCKS or name == "a" or self.open[name]:
            self.open[name].append(len(self.stack))
            self.stack.append((name, off))
            self.hidden += off
            self.articles += name in ("article", "main")
        return at

    def end(self, name: str) -> None:
        if self.open[name]:
            self.close(self.open[name][-1])
        elif name == "p":
            self.end_line()

    def read(self) -> list[tuple[str, int, bool, bool]]:
        html, at = self.html, 0
        while at < len(html):
            tag = html.find("<", at)
            self.add(html[at:tag] if tag >= 0 else html[at:])
            if tag < 0:
                break
            if html.startswith("<!--", tag):
                end = html.find("-->", tag + 4)
                at = end + 3 if end >= 0 else len(html)
                continue
            name = _NAME.match(html, tag + 1)
            if not name:
                if html[tag + 1 : tag + 2] in ("!", "?", "/"):
                    end = html.find(">", tag)
                    at = end + 1 if end >= 0 else len(html)
                else:
                    self.add("<")
                    at = tag + 1
                continue
            attributes, at = [], name.end()
            if html.startswith(">", at):
                at += 1
            else:
                while True:
                    m = _ATTRIBUTE.match(html, at)
                    if not m:  # the page ends inside the tag
                        at = len(html)
                        break
                    at = m.end()
                    if m[1]:
                        break
                    attributes.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
            if html[tag + 1] == "/":
                self.end(name[1].lower())
            else:
                at = self.start(name[1].lower(), attributes, html.startswith("/>", at - 2), at)
        self.close(0)
        self.end_line()
        return self.lines


def lines_of(html: str) -> list[tuple[str, int, bool, bool]]:
    """The lines of a page without markup: (text, letters in links, inside an article, emptied), one a block in page order.
    Blocks that surround articles are empty lines and emptied, so that they still part what stands before them from what
    follows; other empty lines are left out."""
    return _Lines(html).read()


def weights_of(lines: list[tuple[str, int, bool, bool]], surge: int) -> list[int]:
    """What each line counts in the curve: its letters outside links. Where a page marks an article or main element, this is
    evidence beside the lengths: lines inside count with their links and `surge` more, and lines outside only if they are
    long, with 8 * surge letters or more outside links."""
    marked = any(inside and text for text, _, inside, _ in lines)

    def weight(text: str, linked: int, inside: bool) -> int:
        plain = len(text) - linked
        if not marked:
            return plain
        return len(text) + surge if inside and text else plain if plain >= 8 * surge else 0

    return [weight(text, linked, inside) for text, linked, inside, _ in lines]


def main_text(html: str, window: int = 3, surge: int = 40) -> str:
    """The article's blocks, joined by newlines.

    The weights of lines (see weights_of) are summed over sliding windows of lines; a block emptied of what surrounds articles
    is as wide as a window. The text surges where a window that begins with weight sums to `surge`, or on pages of little
    text to half of the largest sum, and dives after the last weight before a window without any, be it links or an
    emptied block. Text is kept from the first surge to the last dive, without the windows that hold no weight; stretches
    that never surge are kept between two that do.
    """
    lines = lines_of(html)
    texts, weights = [], []
    for (text, _, _, emptied), weight in zip(lines, weights_of(lines, surge), strict=True):
        if emptied:
            texts += [""] * window
            weights += [0] * window
        if text:
            texts.append(text)
            weights.append(weight)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    curve = [upto[min(i + window, len(weights))] - upto[i] for i in range(len(weights))]
    level = min(surge, max(curve, default=0) / 2)
    some = [i for i, w in enumerate(weights) if w > 0]
    stretches: list[list[int]] = []  # of lines with weight, fewer than `window` others between two of them
    for i in some:
        if stretches and i - stretches[-1][-1] <= window:
            stretches[-1].append(i)
        else:
            stretches.append([i])
    surges = [next((i for i in s if curve[i] >= level), None) for s in stretches]
    strong = [k for k, at in enumerate(surges) if at is not None]
    kept: list[str] = []
    for k in range(strong[0], strong[-1] + 1) if strong else ():
        begin = surges[k] if k == strong[0] else stretches[k][0]
        kept += [t for t in texts[begin : stretches[k][-1] + 1] if t]
    return "\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id_col, url_col, text ('' if a page has none), n_chars. A null html is empty. Pages are read whole, one at a
    time; nothing is shuffled; repeated rows and null ids are rows like others; ids of any type are returned as they are;
    other columns are ignored; an empty table gives no rows."""

    def extract(it):
        for b in it:
            text = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    of = lambda c, name: F.col(f"`{c}`").alias(name)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(of(id_col, "id"), of(url_col, "url"), of(html_col, "html")).mapInArrow(extract, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
