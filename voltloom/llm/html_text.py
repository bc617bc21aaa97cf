"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Elements that their
tag, class, id or role names a menu, header, footer, sidebar, notice, advert,
form or reader comments are left out, unless the page's article, or most of the
page, stands inside them. Any other line weighs as much as its text outside
links. Ambiguous names decide nothing: outside a marked article they lower a
line's weight to the part ``DOUBT`` of it, as does standing outside the article
of a page that marks one; each line inside a marked article weighs ``RAISE``
characters more.

Sums over a sliding window of lines rise steeply where running text begins (a
surge point) and fall to nothing where it ends (a dive point); the text between
surge and dive points is kept. What stands in the same container as kept text
belongs to it, however short; short lines of another container at a passage's
ends do not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window, and characters a window needs for a surge.
WINDOW = 3
SURGE = 80
#: The part of its weight that a line in doubt keeps, and characters that a line inside a marked article counts for more.
DOUBT, RAISE = 0.2, 27

# Elements of HTML by their role.
_DROPPED = "script|style|noscript|template|title|textarea|svg|iframe|object|select|button|canvas|audio|video|datalist"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILER_TAGS = frozenset("nav footer aside form dialog menu head".split())
_BODY_TAGS = frozenset(("article", "main"))
#: Elements that hold a passage's blocks together.
_HOLDERS = frozenset("article body div form main section table td".split())
# Words of class, id and role that mark what is not the article, and words that may.
_READERS = frozenset("comment comments commentlist commentary disqus reply replies respond discussion responses".split())
_BOILER_WORDS = _READERS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion promos nav navbar navigation "
    "topnav menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside complementary widget widgets footer foot contentinfo masthead topbar cookie cookies "
    "consent gdpr notice notices alert alerts announcement popup modal overlay newsletter subscribe subscription signup signin sharing "
    "recommendations pagination pager toolbar paywall tagcloud searchbox searchform".split()
)
_DOUBTFUL_WORDS = frozenset("banner banners header login register share social related recommended trending copyright legal disclaimer skip search form toc tags".split())

_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <!\[CDATA\[|\]\]> | <(?P<raw>{_DROPPED})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)
    | <(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | </?[a-z][^>]*+> | <[!?/][^>]*+>""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)(?=\s|/|$)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_NEGATED = re.compile(r"\b(?:no|non|has|with|without)[-_]+[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What the names say of an element: nothing, doubt, or that it is not the article.
PLAIN, DOUBTFUL, BOILER = 0, 1, 2


def _named(tag: str, attributes: str) -> int:
    if tag in _BOILER_TAGS:
        return BOILER
    if not attributes or tag in ("html", "body"):
        return PLAIN
    found = [(name, "".join(values), hidden) for name, *values, hidden in _ATTR.findall(attributes)]
    if any(name.lower() in ("id", "role") and value.lower() in ("content", "main", "article", "main-content") for name, value, _ in found):
        return PLAIN
    said = PLAIN
    for name, value, hidden in found:
        if hidden or name.lower() == "aria-hidden" and value.lower() == "true" or name.lower() == "style" and _HIDDEN.search(value):
            return BOILER
        if name.lower() in ("class", "id", "role"):
            words = _WORDS.findall(_CAMEL.sub(" ", _NEGATED.sub(" ", value)).lower())
            if not (_READERS if tag in _BODY_TAGS else _BOILER_WORDS).isdisjoint(words):
                return BOILER
            if tag not in _BODY_TAGS and not _DOUBTFUL_WORDS.isdisjoint(words):
                said = DOUBTFUL
    return said


class _Region:
    __slots__ = ("tag", "said", "begin", "length", "body", "closed")

    def __init__(self, tag: str, said: int, begin: int):
        self.tag, self.said, self.begin, self.length, self.body, self.closed = tag, said, begin, 0, tag in _BODY_TAGS, False


def lines_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """The page's lines: text, characters outside links and boilerplate, container, whether a marked article holds it, whether in doubt."""
    runs: list[tuple[str, tuple[_Region, ...], bool, int]] = []  # text, open regions that matter, in a link, container; "" ends a line
    stack: list[_Region] = []
    open_tags: list[tuple[str, _Region | None, int]] = []
    n_open: dict[str, int] = {}
    marked: tuple[_Region, ...] = ()
    links, at, total, holders, inmost = 0, 0, 0, 0, 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            runs.append((text, marked, links > 0, inmost))
            total += len(text)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            runs.append(("", (), False, 0))
            if tag != "br":
                links = 0  # a link that was never closed ends with its block
        if m["end"]:
            if tag == "a":
                links = 0
            for k in range(len(open_tags) - 1, -1, -1) if n_open.get(tag) else ():
                if open_tags[k][0] == tag:
                    gone = [r for _, r, _ in open_tags[k:] if r is not None]
                    for t, _, _ in open_tags[k:]:
                        n_open[t] -= 1
                    if gone:
                        for r in gone:
                            r.length = total - r.begin
                        for r in gone if tag not in ("body", "html") else ():
                            r.closed = True
                        stack = [r for r in stack if r not in gone]
                        marked = tuple(stack)
                    inmost = open_tags[k][2]
                    del open_tags[k:]
                    break
        elif tag == "a":
            links = 1
        elif tag not in _VOID and not m["attr"].endswith("/"):
            said = _named(tag, m["attr"])
            if tag == "header" and said != BOILER and not any(r.body for r in stack):
                said = BOILER
            region = None
            if said or tag in _BODY_TAGS:
                region = _Region(tag, said, total)
                if tag in _BODY_TAGS and said != BOILER:
                    for r in stack:
                        r.body = r.body or r.tag == "form" or r.tag not in _BOILER_TAGS  # a wrapper of the article is no boilerplate, whatever its name
                stack.append(region)
                marked = tuple(stack)
            open_tags.append((tag, region, inmost))
            n_open[tag] = n_open.get(tag, 0) + 1
            # inside a marked article all is one container
            if tag in _HOLDERS and (tag in _BODY_TAGS or not any(r.tag in _BODY_TAGS and r.said != BOILER for r in stack)):
                holders += 1
                inmost = holders
    if at < len(page):
        runs.append((page[at:], marked, links > 0, inmost))
        total += len(page) - at
    for r in stack:
        r.length = total - r.begin
    lines: list[tuple[str, int, int, bool, bool]] = []
    parts: list[str] = []
    weight, where, inside, doubt = 0, 0, False, False

    def lowered(regions: tuple[_Region, ...]) -> int:
        said = PLAIN
        for r in regions:
            if r.said and (r.closed or r.tag == "footer") and not (r.body and r.tag not in _BODY_TAGS):
                # a named wrapper around most of the page is its body
                if (r.tag in _BOILER_TAGS and r.tag != "form") or r.tag == "header" or r.length <= 0.6 * total:
                    said = max(said, r.said)
        return said

    for text, regions, linked, container in [*runs, ("", (), False, 0)]:
        if text:
            said = lowered(regions) if regions else PLAIN
            if said != BOILER:
                parts.append(text)
                weight += 0 if linked else len(text.strip())
                inside = inside or any(r.tag in _BODY_TAGS and r.said != BOILER for r in regions)
                doubt = doubt or said == DOUBTFUL and not linked
                where = container
        elif parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                lines.append((line, weight, where, inside, doubt))
            parts, weight, inside, doubt = [], 0, False, False
    return lines


def main_text(page: str, *, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points, one line for each block."""
    lines = lines_of(page)
    article = any(inside for *_, inside, _ in lines)  # the page says where its article is

    def weigh(chars: int, inside: bool, doubt: bool) -> float:
        if inside:
            return chars + RAISE
        return chars * DOUBT if doubt or article else chars

    weights = [weigh(w, inside, doubt) for _, w, _, inside, doubt in lines]
    where = [c for _, _, c, _, _ in lines]
    n = len(lines)
    until = [0, *accumulate(weights)]
    sums = [until[min(n, i + window)] - until[i] for i in range(n)]
    kept: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if weights[i] and sums[i] >= surge:  # surge: running text begins here
            j = i
            while j < n and sums[j]:  # dive: a whole window without text
                j += 1
            while weights[j - 1] == 0:
                j -= 1
            kept.append((i, j))
            i = j
        else:
            i += 1
    if not kept:  # nothing but short lines: those that nothing speaks against
        return "\n".join(line for line, w, _, inside, doubt in lines if w and (inside or not doubt and not article))
    held: dict[int, float] = {}
    for c, w in zip(where, weights, strict=True):
        held[c] = held.get(c, 0) + w
    taken = [False] * n
    homes = set()
    for a, b in kept:
        here: dict[int, float] = {}
        for k in range(a, b):
            here[where[k]] = here.get(where[k], 0) + weights[k]
        home = max(here, key=lambda c: (here[c], -c))
        # short lines of other containers at the ends are not of the passage
        while b - a > 1 and where[a] != home and held[where[a]] < surge:
            a += 1
        while b - a > 1 and where[b - 1] != home and held[where[b - 1]] < surge:
            b -= 1
        homes.add(home)
        taken[a:b] = [True] * (b - a)
    return "\n".join(line for (line, *_), w, c, t in zip(lines, weights, where, taken, strict=True) if w and (t or c in homes))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract the main text of every whole page.

    Returns ``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points), a
    row for each input row. Null or empty pages, and pages with nothing but
    boilerplate, give an empty text. Ids and urls are passed on, null or not;
    repeated rows give repeated results, an empty table an empty one; other
    columns are not read.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) if p.is_valid else "" for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
