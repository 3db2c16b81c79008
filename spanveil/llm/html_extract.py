"""Main text of web pages: flat text blocks, classified by a decision tree over a block's and its neighbours' shallow features.

A page becomes a flat list of blocks, cut at block-level tags. What an open element marks as furniture - a menu, footer, sidebar, notice, advert,
form or reader comment, by its tag or by class, id or role - is left out first, so a block's neighbours are the blocks of text around it, and those
of another part of the page (inside against outside the article) don't count. Features of a block: its words and link density, the same of both neighbours,
whether it is a heading, is in the article, is outside of a page's article, how its container's plain words compare with the
largest one's, and whether it has the wording of boilerplate. The tree is grown by Gini impurity from the blocks of LAYOUTS, a small table of typical pages.

What counts as the article: every article and main element, or what names itself so. All of it that nothing marks is kept: first paragraphs within a
link, lists of references, titles. Its own header belongs to it, by tag or by name (entry-header), a page's header doesn't; asides, footers and menus in it
don't. An element that holds the article, or inside it half of its words, is no furniture by one part of a compound name such as related-work; reader
comments take nine tenths. Names of a state, such as no-comments, mark nothing. Hidden elements are left out unless they hold the article. Inline elements
are left out if their whole name is an advert's or the like, outside pre and code. A heading such as "3 comments" or "Leave a reply" hides what follows
until the next heading of its level or the end of its container.

Defined cases: a null or empty page has no text. Unclosed and stray tags are tolerated: an end tag closes the
nearest open container of its name, or nothing. Of a raw element such as <script> only its own end tag is read. A silent element
that is never closed hides what comes before the next block-level tag; only <script> hides all that follows, as in browsers.
A page's html and body are never furniture, nor is a form around the article. Quotes that never pair up end at the next `>`; a tag
that never ends is text. The time is linear in the page. A `text` column of the input must be renamed first: extract_pages replaces it. White space is what Unicode calls so. A page of furniture only has an empty text. Repeated rows each get a result.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.session import ship, table

_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+>"
_NAME = r"<(/?)([A-Za-z][A-Za-z0-9-]*+)"
#: A comment, a tag with its values in quotes, text, or a sign that begins none of them.
_PART = re.compile(rf"""{_COMMENT}|{_NAME}((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+'|)|["'])*+)>|([^<]++)|<""", re.S)
#: The same where quotes don't pair: a tag ends at the next sign that could end one.
_PLAIN_PART = re.compile(rf"{_COMMENT}|{_NAME}([^>]*+)>|([^<]++)|<", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])(?!\s*=\s*["']?until-found)|style\s*=\s*(?:"[^"]*?(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*?(?:display\s*:\s*none|visibility\s*:\s*hidden)|display:none))""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[-_]+")

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template svg math iframe object select textarea button title canvas audio video".split())
#: Those whose content is no markup, and those that may hold one of their own name.
RAW = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "noscript", "iframe", "textarea", "title")}
NESTING = frozenset("template svg math object".split())
#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end with the next block-level tag at the latest; all other block-level elements stay open until their end tag.
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 hr p".split())
CONTAINERS = BLOCKS - LEAVES
#: What ends an open element of a kind without an end tag, and inside what it may be.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot")}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), **dict.fromkeys("td th tr tbody tfoot thead".split(), ("table",))}
FURNITURE = frozenset("aside footer form head menu nav dialog".split())
#: Words of a class, id or role that mark furniture; reader comments among them.
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies respond".split())
FURNITURE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookiebar cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promotion related search searchform share sharedaddy sharing sidebar signin signup sitemap social sponsor sponsored subscribe taboola tags toc toolbar topbar widget".split()
)
#: The same for inline elements.
INLINE_WORDS = frozenset("ad ads advert advertisement adverts cookie cookies newsletter promo promotion share sharing social sponsor sponsored subscribe".split())
HEADER_WORDS = frozenset("header".split())
#: Parts of a compound name that tell a state of something larger, such as has-sidebar, and mark nothing.
STATE_WORDS = frozenset("active closed disabled enabled full has hidden hide is layout no not open page show single template theme with without wrap wrapper".split())
ARTICLE_WORDS = frozenset("article article-body articlebody content entry entry-content main post post-body post-content story".split())
#: Headings behind which readers, not the article, have their say.
COMMENTS_HEADING = re.compile(r"(?:\d+\s+(?:comments?|responses?|replies|reply|kommentare?|commentaires?|comentarios?)\b.{0,40}|(?:comments?|kommentare|commentaires|comentarios)\s*\(?\d*\)?:?|(?:reader|user)s?'?\s+comments?|leave\s+a\s+(?:reply|comment)|post\s+a\s+comment|join\s+the\s+(?:discussion|conversation))", re.I)
#: Wording of boilerplate in short blocks.
BOILERPLATE = re.compile(
    r"\u00a9|\(c\)\s*\d{4}|\bcopyright\b.{0,10}\d{4}|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|\bsubscribe\b|\bsign up\b|\bnewsletter\b|\badvertisement\b|\bsponsored\b|share (?:this|on)\b|follow us|log in\b|powered by|alle rechte vorbehalten|tous droits r|todos los derechos|you (?:may|might) also like|related (?:posts|articles|stories)|read more|back to top|skip to content",
    re.I,
)
SHORT = 30

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "elsewhere", "heading", "share", "boilerplate")
#: Typical pages: `[` and `]` are a container, its first sign A for the article and E for the rest of a page that has one. A block is its number of words, with
#: /n if n of them are linked, h before a heading, b behind boilerplate, + behind main text.
LAYOUTS = """
[ 1/1 1/1 1/1 2/2 1/1 ] [ h7+ 60/2+ 45+ 80/3+ 9+ 55+ 6+ ] [ 3/3 4/4 2/2 ] [ 6b ]
[ 2/2 1/1 1/1 ] [ h4+ 25+ 12+ h3+ 40+ 3+ 70+ 15/4+ ] [ 9b ]
[ 4 ] [ 1/1 2/2 1/1 1/1 ] [ 3/3 5/5 4/4 6/6 ] [ h9+ 8+ 120/5+ 30+ 2+ 64+ ] [ h2 5/5 6/6 8/8 ] [ 12b 1/1 1/1 ]
[ h3/3 1/1 1/1 1/1 ] [ [ h8+ 4/2+ 5+ ] [ 90+ 75/6+ 14+ 8+ 33+ ] ] [ h1 7/7 9/9 6/6 ] [ 4b 2/2 ]
1/1 1/1 2/2 h6+ 50+ 70/3+ 20+ 45+ 11+ 3/3 2/2 1/1 8b
1/1 3/3 h5+ 30+ 3+ 41+ h2+ 66/1+ 5+ 1/1 1/1 14b
2 1/1 1/1 h10+ 22+ 19+ 95+ 4/4 3/3 5b
[ 1/1 1/1 ] [ 38+ 52+ 27+ 7+ ] [ 2/2 10b ]
[ 15/1b ] [ 2/2 3/3 ] [ h6+ 21+ 18+ 26+ 10+ 4+ ] [ 5 3/3 ] [ 7b 3/3 ]
[ 18b 1/1 ] [ h5+ 48/4+ 6/6+ 52+ 9/9+ 31+ ] [ 8/8 7/7 9/9 ] [ 3 ]
[ 3/3 2/2 ] [ h7+ 34+ [ 5+ 6+ 4+ 9+ ] 28+ 16+ ] [ 2 ]
[ 3/3 ] [ 85+ ] [ 1/1 ] [ 8b ]
[ h3 2/2 3/3 4/4 2/2 ] [ h2 6/6 7/7 5/5 ] [ 4b ]
[ 10/10 12/12 9/9 14/14 ] [ 8/8 11/11 ] [ 5 ]
[ 1/1 4/4 ] [ 3 4 5/1 2 ] [ h6+ 40+ 24/2+ 11+ ] [ 30/28 25/20 ] [ 16b ]
[ 2/2 1/1 ] [ h3+ 9+ 10+ 22+ 8+ 7+ 36+ ] [ 12/6 10/5 ]
[ 5 ] [ 6/1 ] [ 2/2 2/2 ] [ h8+ 62+ 58/2+ ] [ 11b 9b ]
[ 1/1 2/2 1/1 ] [ h5+ 14+ 15+ 13+ 4+ ]
[ 1/1 ] [ 2/2 3/3 ] [ h3+ 30+ 16+ 2+ ]
1/1 2/2 h4+ 19+ 35+ 5+
[ 7+ 6+ ]
[ 9+ ]
[ 25b ] [ 1/1 2/2 ]
[ 1/1 2/2 ] [ h3+ 12+ 9+ 6+ ] [ 5b ]
[ 2/2 2/2 1/1 ] [ 11+ 3+ 14+ ] [ 2/2 ]
[ 1/1 1/1 ] [ h4+ [ 33+ 20+ ] [ 41+ 8+ ] [ 26+ 5+ ] ] [ 3 2/2 ] [ 7b ]
[ [ 3/3 ] [ 2/2 ] [ 2/2 ] ] [ [ h9+ ] [ 5+ ] [ 60+ 58+ 44+ ] [ 30+ 7+ ] ] [ [ 12 ] [ 9/9 ] ] [ 8b ]
A[ h6+ 40+ 5+ 60/3+ 8/8+ 2+ 1+ 70+ 3/3+ 4/4+ 9/9+ 11b+ ] E[ 1/1 2/2 ] E[ 40 ]
A[ 7/7+ h2+ 33+ 12+ 6+ 2/2+ 1/1+ ] E[ 3 8b ] E[ h3 15 22 ]
A[ h1+ 2+ 3+ 90/4+ 25b+ ] E[ h4 60 2/2 ] E[ 5/5 4/4 ]
A[ h12+ 6/6+ 45+ 1+ ] E[ 25/3 h2 18 ] E[ 1/1 ]
A[ 3/3+ 3/3+ 3/3+ 4/4+ ] E[ 70 30 ] E[ h8 9 ]
A[ 55+ ] E[ 4 ] E[ h5/5 12/12 7/7 ]
"""


class Block(NamedTuple):
    """A block with a word that is no furniture; box: the container that it stands in."""

    text: str
    words: int
    linked: int
    article: bool
    elsewhere: bool
    heading: bool
    box: int


def features(found: list[Block]) -> list[tuple]:
    """FEATURES of each block; neighbours of another part of the page are as if there were none."""
    shape = [(b.words, b.linked / b.words) for b in found]
    plain: dict[int, int] = {}
    for b in found:
        plain[b.box] = plain.get(b.box, 0) + b.words - b.linked
    most = max(plain.values(), default=0) or 1
    out = []
    for i, b in enumerate(found):
        before = shape[i - 1] if i and found[i - 1].article == b.article else (0, 0.0)
        after = shape[i + 1] if i + 1 < len(found) and found[i + 1].article == b.article else (0, 0.0)
        out.append((*shape[i], *before, *after, int(b.article), int(b.elsewhere), int(b.heading), plain[b.box] / most, int(b.words <= SHORT and bool(BOILERPLATE.search(b.text)))))
    return out


def labelled(layouts: str = LAYOUTS) -> list[tuple]:
    """The blocks of the layouts: their features and 1 for main text."""
    rows = []
    for line in layouts.strip().splitlines():
        found, labels, boxes, made = [], [], [(0, "")], 0
        for sign in line.split():
            if sign.endswith("["):
                made += 1
                boxes.append((made, sign[0] if sign != "[" else boxes[-1][1]))
            elif sign == "]":
                boxes.pop()
            else:
                words, linked, boiler = re.fullmatch(r"h?(\d+)(?:/(\d+))?(b?)\+?", sign).groups()
                box, part = boxes[-1]
                found.append(Block("copyright 2024" if boiler else "", int(words), int(linked or 0), part == "A", part == "E", sign[0] == "h", box))
                labels.append(int(sign.endswith("+")))
        rows += [(*x, y) for x, y in zip(features(found), labels)]
    return rows


def grow(rows: list[tuple], depth: int = 9):
    """A leaf's majority, or (feature, threshold, tree at or below, tree above)."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            gini = 0.0
            for side in ([r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]):
                p = sum(r[-1] for r in side) / len(side)
                gini += len(side) * p * (1 - p)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, k, cut)
    if best is None:
        return int(2 * ones >= len(rows))
    _, k, cut = best
    return k, cut, grow([r for r in rows if r[k] <= cut], depth - 1), grow([r for r in rows if r[k] > cut], depth - 1)


TREE = grow(labelled())


def decide(x: tuple, tree=None) -> int:
    tree = TREE if tree is None else tree
    while isinstance(tree, tuple):
        k, cut, below, above = tree
        tree = below if x[k] <= cut else above
    return tree


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Whole names of class, id and role, and the parts of compound ones; a name that tells a state has none."""
    if not attributes:
        return set(), set()
    own = [w for m in _NAMES.finditer(attributes) for v in m.groups() if v for w in v.split()]
    parts = ([p.lower() for p in _HUMP.split(n)] for n in own)
    return {n.lower() for n in own}, {p for x in parts if not STATE_WORDS.intersection(x) for p in x}


def _article(tag: str, names: set[str]) -> bool:
    return tag in ("article", "main") or bool(names & ARTICLE_WORDS)


def _furniture(tag: str, attributes: str, in_article: bool, around: bool, most: bool) -> bool:
    """Whether an element is furniture. around: the article is in it; most: it has nine tenths of its article's words, or the article."""
    if tag in ("html", "body"):
        return False
    names, parts = _names(attributes)
    named = names if around or tag in ("main", "article") else names | parts
    if around and not most:
        named = named | parts & COMMENT_WORDS
    headed = not in_article and not around and (tag in ("header", "hgroup") or bool(named & HEADER_WORDS))
    by_tag = tag in FURNITURE and not (tag == "form" and around)
    return by_tag or headed or bool(named & FURNITURE_WORDS) or (not around and _hides(attributes))


def _hides(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    m = _HIDDEN.search(attributes)
    # A bare `hidden` inside another attribute's value hides nothing.
    return bool(m) and (m[0].lower().startswith("style") or bool(_HIDDEN.search(_QUOTED.sub("=", attributes))))


def _raw_end(html: str, at: int, tag: str) -> int | None:
    """Where a raw element that starts before `at` ends; None if another one starts first or none ends."""
    for m in RAW[tag].finditer(html, at):
        if m[1]:
            return m.end()
        if tag != "script":
            return None
    return len(html) if tag == "script" else None


def _parts(html: str) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """(closing, tag, attributes, text) of tags and texts in order, without comments and closed raw elements.

    A tag whose quotes never pair up is read to the next `>`, and so are all tags behind it; behind the last `>` everything is text. Each
    of the two can happen once, so the time is linear.
    """
    out: list[tuple[str | None, str | None, str | None, str | None]] = []
    pattern, at = _PART, 0
    last = html.rfind(">")
    while at < len(html):
        for m in pattern.finditer(html, at):
            at = m.end()
            closing, tag, attributes, chars = m.groups()
            if tag is None:
                if chars is not None:
                    out.append((None, None, None, unescape(chars) if "&" in chars else chars))
                elif m[0] == "<":
                    if html[at : at + 1].isalpha() or html[at : at + 1] in ("!", "?", "/"):
                        if m.start() > last:
                            out.append((None, None, None, unescape(html[m.start() :])))
                            return out
                        if pattern is _PART:
                            pattern, at = _PLAIN_PART, m.start()
                            break
                    out.append((None, None, None, "<"))
                continue
            tag = tag.lower()
            if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
                end = _raw_end(html, at, tag)
                if end is not None:
                    at = end
                    break
            out.append((closing, tag, attributes, None))
    return out


def _outline(parts: list[tuple[str | None, str | None, str | None, str | None]]) -> tuple[dict[int, int], set[int], set[int], bool]:
    """Where each closed silent element ends, by its start; the starts of the containers around the article, and of those of them that hold most
    of it; whether the page has an article.

    The article is every article or main element whose names have no part of furniture, and whatever marks itself as
    article and has at least half as many words as the largest of them. On a page without any, what holds two thirds of the page's
    words is around it. Inside an article a container with half of its words is around it as well.
    """
    silent_ends: dict[int, int] = {}
    ends: dict[int, int] = {}
    stack: list[tuple[str | None, int]] = []
    opened: dict[str, int] = {}  # open elements of each name
    last: dict[str, int] = {}  # place on the stack of a silent element that can't hold its own kind
    for i, (closing, tag, attributes, _) in enumerate(parts):
        if tag is None or not (tag in CONTAINERS or tag in SILENT and tag not in RAW):
            continue
        if closing:
            if opened.get(tag):
                while True:
                    name, start = stack.pop()
                    if name is not None:
                        opened[name] -= 1
                        if name in CONTAINERS:
                            ends[start] = i
                    if name == tag:
                        break
                if tag in SILENT:
                    silent_ends[start] = i
            continue
        if tag in SILENT:
            if attributes.rstrip().endswith("/"):
                continue
            if tag not in NESTING:
                if opened.get(tag):
                    stack[last[tag]] = (None, stack[last[tag]][1])
                    opened[tag] -= 1
                last[tag] = len(stack)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, i))
    before, n, until = [], 0, -1  # words before each part
    marked: list[tuple[int, bool]] = []
    opens: list[int] = []
    for i, (closing, tag, attributes, chars) in enumerate(parts):
        before.append(n)
        if i <= until:
            continue
        until = silent_ends.get(i, until)
        if chars is not None:
            n += len(chars.split())
        elif tag in CONTAINERS and not closing:
            opens.append(i)
            if tag in ("article", "main") or attributes:
                names, name_parts = _names(attributes)
                if _article(tag, names) and not names & FURNITURE_WORDS:
                    marked.append((i, tag in ("article", "main") and not name_parts & FURNITURE_WORDS))
    before.append(n)
    end_of = lambda i: ends.get(i, len(parts))
    words = lambda i: before[end_of(i)] - before[i]
    size = {i: words(i) for i, _ in marked}
    largest = max(size.values(), default=0)
    article = [i for i, plain in marked if plain or 2 * size[i] >= largest]
    around, most = set(article), set(article)
    held = [0] * (len(parts) + 1)  # articles that start before each part
    for i in article:
        held[i + 1] += 1
    for i in range(len(parts)):
        held[i + 1] += held[i]
    own: list[int] = []  # open articles
    is_article, covered, reach = set(article), 0, -1
    for i in opens:
        end = end_of(i)
        while own and end_of(own[-1]) <= i:
            own.pop()
        if i in is_article:
            if i > reach:
                covered += words(i)
                reach = end
            own.append(i)
        elif article and held[end] > held[i] or not article and 3 * words(i) >= 2 * n > 0:
            around.add(i)
            most.add(i)
        elif own and 2 * words(i) >= words(own[-1]) > 0:
            around.add(i)
            if 10 * words(i) >= 9 * words(own[-1]):
                most.add(i)
    return silent_ends, around, most, bool(article) and 3 * covered >= n > 0


class _Open(NamedTuple):
    """An open container: what blocks in it are."""

    tag: str
    article: bool
    furniture: bool
    number: int


def blocks(html: str) -> list[Block]:
    """Every block with a word that no element marks as furniture."""
    out: list[Block] = []
    stack = [_Open("", False, False, 0)]
    text: list[str] = []
    linked: list[str] = []
    in_link, heading, until, hidden, leaf, level = False, False, -1, False, False, 0
    counts: dict[str, int] = {}  # open containers of each name
    places: dict[str, list[int]] = {t: [] for t in {*ENDED_BY, *(w for ws in WITHIN.values() for w in ws)}}  # of these on the stack
    inline: list = []  # name and depth of an inline element that is left out
    comments: tuple[int, int] | None = None  # level of a heading over comments, and the size of the stack there
    verbatim = 0
    parts = _parts(html)
    silent_ends, around, most, has_article = _outline(parts)

    def end_block() -> None:
        nonlocal comments
        if text:
            words = "".join(text).split()
            if words and not leaf and not stack[-1].furniture:
                line = " ".join(words)
                if comments and (len(stack) < comments[1] or heading and level <= comments[0] and not COMMENTS_HEADING.fullmatch(line)):
                    comments = None
                if heading and len(words) <= 8 and comments is None and COMMENTS_HEADING.fullmatch(line):
                    comments = (level, len(stack))
                if comments is None:
                    at = stack[-1]
                    out.append(Block(line, len(words), min(len(words), len("".join(linked).split())), at.article, has_article and not at.article, heading, at.number))
            text.clear()
            linked.clear()

    def pop() -> str:
        tag = stack.pop().tag
        counts[tag] -= 1
        if tag in places:
            places[tag].pop()
        return tag

    for i, (closing, tag, attributes, chars) in enumerate(parts):
        if i <= until:
            continue
        if tag is None:
            if not hidden and not inline:
                text.append(chars)
                if in_link:
                    linked.append(chars)
            continue
        if tag == "a":
            in_link = not closing
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "code":
            verbatim = max(0, verbatim + (-1 if closing else 1))
        if tag in SILENT and not closing:
            if not attributes.rstrip().endswith("/"):
                until = silent_ends.get(i, until)
                hidden = hidden or i not in silent_ends
            continue
        if tag not in BLOCKS:
            if inline:
                if tag == inline[0]:
                    inline[1] += -1 if closing else 1
                    if not inline[1]:
                        inline.clear()
            elif attributes and not closing and not verbatim and not counts.get("pre") and not attributes.rstrip().endswith("/") and tag not in ("img", "input", "br", "wbr", "link", "meta", "source", "embed", "area", "col", "track"):
                if _names(attributes)[0] & INLINE_WORDS or _hides(attributes):
                    inline[:] = [tag, 1]
            continue
        end_block()
        hidden, leaf, verbatim = False, False, 0
        inline.clear()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        level = int(tag[1]) if heading else 0
        if tag in LEAVES:
            leaf = not closing and bool(attributes) and _furniture(tag, attributes, stack[-1].article, False, False)
            continue
        in_link = False
        if closing:
            if counts.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in ENDED_BY:
            barrier = max((places[w][-1] for w in WITHIN[tag] if places[w]), default=-1)
            ended = [places[e][-1] for e in ENDED_BY[tag] if places[e] and places[e][-1] > barrier]
            if ended:
                while len(stack) > max(ended):
                    pop()
        up = stack[-1]
        furniture = up.furniture or bool(attributes or tag in FURNITURE or tag in ("header", "hgroup")) and _furniture(tag, attributes, up.article, i in around, i in most)
        article = up.article or _article(tag, _names(attributes)[0]) and not furniture
        if tag in places:
            places[tag].append(len(stack))
        counts[tag] = counts.get(tag, 0) + 1
        # Paragraph-like containers stand in the container around them.
        number = up.number if tag in ("blockquote", "pre", "figure", "figcaption", "ul", "ol", "li", "dl", "dt", "dd", "hgroup", "address", "center") else i + 1
        stack.append(_Open(tag, article, furniture, number))
    end_block()
    return out


def main_text(html: str | None) -> str:
    """The blocks that the tree accepts, one to a line."""
    found = blocks(html) if html else []
    return "\n".join(b.text for b, x in zip(found, features(found)) if decide(x))


@F.arrow_udf(T.StringType())
def extract(html: pa.Array) -> pa.Array:
    return pa.array([main_text(h.as_py()) for h in html], type=pa.string())


def extract_pages(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages with one more column: the main text of html."""
    ship(pages.sparkSession)
    return pages.withColumn(name, extract("html"))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
