"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks (paragraphs, headings, list items, cells, ...) in page order. Pass one decides a block by what is
known of it alone: the zone it stands in, its share of characters inside links, its length and its share of stop words. Blocks
that are short, or that have few stop words, stay undecided. Pass two gives each of them the label of the nearest decided
neighbour: the one that shares more of its ancestors, then the nearer one, then (for headings) the one that follows. Only
pass one knows what a block says; pass two knows where it stands. On a page without any prose by stop words (another language,
a table in words) pass one takes long blocks without links instead.

Zones come from elements and from their class, id and role: menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are boilerplate whatever they say. An article or main element is a zone of its own: its undecided blocks look
for neighbours inside it, and where it has no decided block they belong to it. Where such a zone has text, what stands outside
is not the article.

One row in, one row out, each page by itself: no shuffle, no state, nothing learned. A null or empty page, or one without text,
gives the empty text; repeated rows give repeated rows. Pages may be of any length: the work is linear in it and the page is
held once. Broken markup (open paragraphs, stray end tags, missing ends) is read as browsers do for the cases that move a border.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that carry no topic, in English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could for from had has have he her his how i if in into is it its just like more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für haben hat hatte ich ihr im in ist ja kann man mehr mein mit nach nicht noch nur oder schon sehr sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette comme d'un dans de des du elle en est et eux fait il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur tout très un une vous y été être "
    "al como con de del desde donde el ella en entre era es esta este están fue ha hasta hay la las le lo los me mi muy más ni no nos o para pero por porque que se si sin sobre son su sus también te tiene todo un una y ya yo".split()
)
#: Elements that begin a block, that never hold text, and whose text is never shown as prose.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("button canvas datalist head map math noscript object option select svg template audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
#: Zones of boilerplate by element, and by a word of a class, id or role. An article inside a soft one is an article all the same.
SOFT_TAGS, HARD_TAGS = frozenset("nav header form menu dialog".split()), frozenset("aside footer".split())
SOFT_NAMES = frozenset("ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent cookie cookies dialog form gdpr header login masthead menu modal nav navbar navigation notice notices notification overlay paywall popup promo promotion search searchform signup skip sponsor sponsored toolbar topbar".split())
HARD_NAMES = frozenset("aside bottombar comment commentlist comments complementary contentinfo copyright disclaimer disqus discussion feedback foot footer newsletter pager pagination recommended recommendations related replies reply respond responses reviews share sharing sidebar sidenav social subscribe subscription teaser teasers trending widget widgets".split())
MAIN_NAMES, MAIN_WORDS = frozenset("article content entry main post story".split()), frozenset("article blog body content copy entry main news page post story text".split())
#: First words of classes that speak of other elements.
ABOUT_OTHERS = frozenset("category format has no status tag type with without".split())
#: Words that make a header one of an article.
OF_ARTICLE = frozenset("article content entry page post story".split())

_RAW = "script|style|title|textarea|iframe|noframes|xmp"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<({_RAW})(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|<[/a-zA-Z][^>]*+\Z""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDES = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/>=])|aria-hidden\s*+=\s*+["']?true|style\s*+=\s*+["'][^"']*display\s*:\s*none)""", re.I)
_STRIP = "\"'“”„«»‘’.,;:!?()[]{}|…-–—*"

_HIDDEN, _HARD, _SOFT, _PLAIN, _MAIN = "hidden", "hard", "soft", "plain", "main"


def _zone(tag: str, attributes: str, outer: str) -> str:
    """Zone of an element inside a zone: hidden, hard or soft boilerplate, plain, or main."""
    if outer == _HIDDEN or tag in HIDDEN or _HIDES.search(attributes):
        return _HIDDEN
    if outer == _HARD or tag in ("html", "body"):
        return outer
    own = _MAIN if tag in ("article", "main") else _HARD if tag in HARD_TAGS else _SOFT if tag in SOFT_TAGS else _PLAIN
    if own == _SOFT and tag == "header" and outer == _MAIN:
        own = "title"
    for _, *value in _NAMES.findall(attributes):
        for name in "".join(value).split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if not words or words[0] in ABOUT_OTHERS:
                continue
            said = set(words)
            if said & HARD_NAMES:
                return _HARD
            if said & SOFT_NAMES:
                own = "title" if "header" in said and (said & OF_ARTICLE or outer == _MAIN) else _SOFT if own != _HARD else own
            elif own == _PLAIN and said & MAIN_NAMES and said <= MAIN_WORDS:
                own = _MAIN
    if own == _HARD:
        return _HARD
    if outer == _SOFT:
        return _MAIN if tag in ("article", "main") and own == _MAIN else _SOFT
    return outer if own == _PLAIN else own


def blocks(page: str) -> Iterator[tuple[str, float, str, bool, tuple[int, ...]]]:
    """Text, share of it in links, zone, whether a heading, and ancestors of each block that has text."""
    stack: list[tuple[str, str, int]] = []  # element, zone, number
    pieces: list[str] = []
    linked: list[str] = []
    link, breaks, count, at = -1, 0, 0, 0  # link: height of the stack where a link began

    def flush():
        nonlocal breaks
        breaks = 0
        if not pieces:
            return None
        text = "".join(pieces)
        in_links = " ".join(linked)
        pieces.clear()
        linked.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if not text:
            return None
        in_links = " ".join((html.unescape(in_links) if "&" in in_links else in_links).split())
        zone = stack[-1][1] if stack else _PLAIN
        heading = any(tag in HEADINGS for tag, _, _ in stack[-3:])
        return text, min(1.0, len(in_links) / len(text)), zone, heading, tuple(n for _, _, n in stack)

    def say(text: str):
        nonlocal breaks
        if text and not (stack and stack[-1][1] == _HIDDEN):
            pieces.append(text)
            if link >= 0:
                linked.append(text)
            if breaks and not text.isspace():
                breaks = 0

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = -1
            elif any(tag == x for x, _, _ in stack):
                if tag in BLOCKS and (b := flush()):
                    yield b
                while stack.pop()[0] != tag:
                    pass
                if link > len(stack):
                    link = -1
        elif tag == "a":
            link = len(stack)
        elif tag == "br":
            breaks += 1
            pieces.append(" ")
            if breaks > 1 and (b := flush()):
                yield b
        elif tag in BLOCKS or tag in HIDDEN:
            if tag in BLOCKS and (b := flush()):
                yield b
            if tag in BLOCKS:
                ends = CLOSES.get(tag, ())
                if stack and (stack[-1][0] == "p" or stack[-1][0] in ends or (stack[-1][0] in HEADINGS and tag in HEADINGS)):
                    stack.pop()
                while tag == "tr" and stack and stack[-1][0] in ends:
                    stack.pop()
                if link > len(stack):
                    link = -1
            if tag not in EMPTY and not m[4].endswith("/>"):
                count += 1
                stack.append((tag, _zone(tag, m[4], stack[-1][1] if stack else _PLAIN), count))
    say(page[at:])
    if b := flush():
        yield b


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS or w.strip(_STRIP) in STOP_WORDS for w in words) / len(words)


def first_pass(found: list[tuple], short: int, stops: float, links: float) -> list[bool | None]:
    """True: article; False: boilerplate; None: undecided."""
    labels: list[bool | None] = []
    for text, in_links, zone, heading, _ in found:
        if zone in (_HIDDEN, _HARD, _SOFT) or (zone == "title" and not heading):
            labels.append(False)
        elif in_links > (links if zone != _MAIN or len(text) >= short else 0.9) or (zone == _PLAIN and ("©" in text or (len(text) < short and in_links > 0))):
            labels.append(False)
        elif heading or len(text) < short or stop_share(text) < stops:
            labels.append(None)
        else:
            labels.append(True)
    if True not in labels:  # no prose in a known language: long blocks without links are the best there is
        labels = [True if x is None and f[2] in (_MAIN, _PLAIN) and len(f[0]) >= short and not f[1] and not f[3] else x for f, x in zip(found, labels)]
    return labels


def second_pass(found: list[tuple], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour; those of an article look inside it alone."""
    n, out = len(found), list(labels)
    inside = [f[2] in (_MAIN, "title") for f in found]

    def nearest(order: range) -> list[int | None]:
        near: list[int | None] = [None] * n
        last: dict[bool, int | None] = {True: None, False: None}
        for i in order:
            near[i] = last[inside[i]]
            if labels[i] is not None:
                if found[i][2] in (_MAIN, _PLAIN) or not any(inside):
                    last[inside[i]] = i
        return near

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    for i in range(n):
        if labels[i] is not None:
            continue
        ways = []
        for j, later in ((before[i], False), (after[i], True)):
            if j is not None:
                shared = next((k for k, (a, b) in enumerate(zip(found[i][4], found[j][4])) if a != b), min(len(found[i][4]), len(found[j][4])))
                ways.append((-shared, abs(i - j), later != found[i][3], not labels[j], labels[j]))
        out[i] = min(ways)[-1] if ways else inside[i] or not any(x is not None for x in labels)
    if any(o and x for o, x in zip(out, inside)):
        out = [bool(o and x) for o, x in zip(out, inside)]
    return [bool(o) for o in out]


def main_text(page: str | None, short: int = 70, stops: float = 0.1, links: float = 0.33) -> str:
    """Blocks of the article, one a line."""
    found = list(blocks(page or ""))
    return "\n".join(f[0] for f, keep in zip(found, second_pass(found, first_pass(found, short, stops, links))) if keep)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", short: int = 70, stops: float = 0.1, links: float = 0.33) -> DataFrame:
    """All columns of pages in a struct `row`, and the main text of html_col as `out`.

    short: characters from which a block can be decided by its words; stops: least share of stop words of prose;
    links: share of characters in links from which a block is boilerplate."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, short, stops, links) for p in column], dtype=object)

    return pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), run(F.coalesce(pages[f"`{html_col}`"].cast("string"), F.lit(""))).alias(out))


def op13_html_text(spark, sf_dir: str) -> DataFrame:
    from fidelis.llm.common import table

    text = extract(table(spark, sf_dir, "pages"))
    return text.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
