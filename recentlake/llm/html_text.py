"""HTML extraction (operator 1): flat text blocks classified by a decision tree.

A page is cut into flat blocks at its block-level tags.  Each block has its
number of words, its link density (share of words inside links), the same of
the blocks before and after it, and where it stands: inside an element that is
never article text (navigation, header of the page, footer, sidebar, form,
notice, advert, comments), inside ``article`` or ``main``, in a heading or a
list.  A decision tree, trained on the small table ``LABELLED`` when the
operator starts, marks the blocks of the article; these are joined by line
feeds in page order.

Elements are told by their tags and by words in class, id and role (``HINTS``,
alone or beside words for parts of a page, ``AROUND_HINTS``); such a word on an
element around ``main`` does not count.  A quote opens a value only after ``=``.

Scripts, styles, comments and markup are never text, nor is the content of
``RAW`` and ``HELD`` elements; character references are decoded, white space
inside a block becomes one space, nothing else is dropped or cut.  Unclosed and
stray tags are tolerated: a closing tag closes what was opened since its opening
tag, or nothing; a ``HELD`` element without an end tag holds nothing.

Special cases: null and empty html, and pages without a content block, give
the empty text; null page_id and url are kept; equal rows are extracted each;
an empty table gives an empty result; columns other than page_id, url and html
are not read.  Work for each page is proportional to its length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page, up to the end tag or the page's end.
RAW = frozenset("script style iframe textarea title".split())
#: The same, but without an end tag they hold nothing.
HELD = frozenset("noscript template svg canvas audio video annotation annotation-xml".split())
#: Those of them that may stand in each other.
NESTED = frozenset(("svg", "template"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics".split())
NEVER = frozenset("head nav footer aside form menu dialog button select fieldset".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl".split())
#: Names in class, id and role that mark such an element.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer footnav "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup login "
    "comment comments disqus replies respond reviews share sharing social related recommended recommendations "
    "widget widgets pagination pager skiplink complementary contentinfo search".split())
#: Words beside a hint that leave it one: what pages call the parts of such elements.
AROUND_HINTS = HINTS | frozenset(
    "a and area articles bar block blocks body bottom box btn button buttons card cards center close column container content "
    "custom desktop div footer fixed form full global group head header heading hidden icon icons id inline inner items item js "
    "label large left link links list main mobile module modules more mid middle new news of on open outer page panel posts post "
    "primary region right row secondary section site size slot small static sticky stories story strip tag tags text the title top "
    "unit units user view wide wrap wrapper wp google dfp zone".split())
#: First words of names that tell how a page is laid out, not what an element is.
_LAYOUT = frozenset("content layout main page body primary columns grid".split())
_HINT_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NOT_HINTS = frozenset("has with no without is not".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    never: bool
    content: bool
    heading: bool
    listed: bool


def _marked(attributes: str) -> bool:
    """Whether class, id, role or style mark an element as no article text."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    bare = attributes
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = [p.lower() for p in _HINT_PARTS.findall(one)]
                # "related-posts" is a hint, "related-work" and "content-sidebar-right" are none.
                if parts and parts[0] not in _NOT_HINTS and not HINTS.isdisjoint(parts) and AROUND_HINTS.issuperset(parts) \
                        and not (parts[0] in _LAYOUT and "sidebar" in parts):
                    return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        elif name == "aria-hidden" and value.lower() == "true":
            return True
    if "hidden" in attributes:
        bare = ATTRIBUTE.sub(" ", attributes)
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", bare))


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, never, content, heading, list: of what it adds
    places: dict[str, list[int]] = {}  # where on the stack the open elements of a tag are
    never = content = heading = listed = links = 0
    endless: set[str] = set()  # tags with no end tag in the rest of the page
    parts: list[str] = []
    words = linked = 0

    def add(raw: str) -> None:
        nonlocal words, linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text.split())
            words += n
            linked += n if links else 0

    def close() -> None:
        nonlocal parts, words, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, len(text.split()), min(linked, words), never > 0, content > 0, heading > 0, listed > 0))
        parts, words, linked = [], 0, 0

    def pop() -> None:
        nonlocal never, content, heading, listed
        tag, a, b, c, d = stack.pop()
        places[tag].pop()
        never, content, heading, listed = never - a, content - b, heading - c, listed - d

    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = token[1] == "/"
        if tag in RAW:
            if not closing and not token[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 if end else n
                at = at or n
            continue
        if tag in HELD:
            if not closing and not token[3].endswith("/") and tag not in endless:
                # Another opening tag before the end tag: this one was left open.
                end = re.compile(rf"</{'' if tag in NESTED else '?'}{tag}[\s/>]", re.I).search(page, at)
                if end is None:
                    endless.add(tag)
                elif page[end.start() + 1] == "/":
                    at = page.find(">", end.start()) + 1 or n
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag in ("br", "img", "mtd"):
                parts.append(" ")
            if tag != "span" or not (closing or _marked(token[3])) and not places.get("span"):
                continue
        else:
            links = 0  # a link left open ends with its block
        if closing:
            if places.get(tag):
                if tag != "span" or never:
                    close()
                depth = places[tag][-1]
                while len(stack) > depth:
                    pop()
            elif tag not in INLINE:
                close()
            continue
        if tag not in INLINE or _marked(token[3]):
            close()
        if tag in VOID or token[3].endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            while stack and stack[-1][0] in (("p", tag) if tag != "tr" else ("p", "td", "th", "tr")):
                pop()
        elif stack and stack[-1][0] == "p" and tag != "span":
            pop()
        if tag == "main" and never:
            # What holds the page's main part is no notice or sidebar, whatever its classes say.
            kept = [(t, a if t in NEVER else 0, b, c, d) for t, a, b, c, d in stack]
            never -= sum(x[1] for x in stack) - sum(x[1] for x in kept)
            stack[:] = kept
        in_article = content > 0
        out = tag in NEVER or tag == "header" and not in_article or \
            tag not in ("html", "body", "article", "main") and _marked(token[3])
        entry = (tag, int(out), int(tag in CONTENT or 'role="main"' in token[3]), tag in HEADINGS, tag in LISTS)
        places.setdefault(tag, []).append(len(stack))
        stack.append(entry)
        never, content, heading, listed = never + entry[1], content + entry[2], heading + entry[3], listed + entry[4]
    close()
    return found


# -- the decision tree -----------------------------------------------------------

FEATURES = ("never", "content", "page_has_content", "words", "link_density", "words_before", "link_density_before",
            "words_after", "link_density_after", "heading", "listed")
#: Labelled blocks, in the order of FEATURES, then 1 for article text.
LABELLED = (
    # inside elements that are never article text
    (1, 0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 0, 1, 9, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0),
    (1, 0, 1, 12, 0.1, 40, 0.0, 0, 0.0, 0, 0, 0), (1, 1, 1, 30, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0),
    (1, 1, 1, 4, 0.5, 80, 0.0, 20, 0.0, 1, 0, 0), (1, 0, 0, 55, 0.0, 90, 0.0, 3, 1.0, 0, 0, 0),
    (1, 0, 0, 2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0), (1, 1, 1, 120, 0.0, 35, 0.0, 14, 0.0, 0, 0, 0),
    (1, 1, 1, 3, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0), (1, 1, 1, 40, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0),
    (1, 0, 0, 40, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0), (1, 0, 0, 20, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0),
    (1, 1, 1, 15, 0.0, 30, 0.0, 30, 0.0, 0, 1, 0), (1, 0, 0, 6, 0.0, 25, 0.0, 30, 0.0, 1, 0, 0),
    (1, 0, 1, 25, 0.0, 0, 0.0, 10, 0.0, 0, 0, 0), (1, 0, 0, 18, 0.0, 70, 0.0, 16, 0.0, 0, 1, 0),
    (1, 0, 0, 30, 0.0, 45, 0.0, 28, 0.0, 0, 0, 0), (1, 0, 0, 9, 0.0, 35, 0.0, 60, 0.0, 0, 0, 0),
    (1, 0, 0, 75, 0.0, 25, 0.0, 33, 0.0, 0, 0, 0), (1, 0, 0, 14, 0.0, 27, 0.0, 5, 0.0, 0, 1, 0),
    (1, 0, 0, 26, 0.0, 0, 0.0, 31, 0.0, 0, 0, 0), (1, 0, 0, 31, 0.0, 28, 0.0, 0, 0.0, 0, 0, 0),
    (1, 0, 0, 48, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), (1, 0, 0, 5, 0.1, 62, 0.0, 41, 0.1, 1, 0, 0),
    (1, 0, 0, 100, 0.0, 80, 0.0, 60, 0.0, 0, 0, 0), (1, 0, 0, 21, 0.2, 26, 0.0, 22, 0.0, 0, 0, 0),
    # the article element's own blocks
    (0, 1, 1, 8, 0.0, 6, 1.0, 60, 0.0, 1, 0, 1), (0, 1, 1, 75, 0.0, 8, 0.0, 40, 0.0, 0, 0, 1),
    (0, 1, 1, 1, 0.0, 50, 0.0, 33, 0.0, 0, 0, 1), (0, 1, 1, 2, 0.0, 0, 0.0, 90, 0.0, 1, 0, 1),
    (0, 1, 1, 34, 0.3, 20, 0.0, 45, 0.1, 0, 0, 1), (0, 1, 1, 5, 1.0, 44, 0.0, 51, 0.0, 0, 0, 1),
    (0, 1, 1, 7, 0.0, 40, 0.0, 9, 0.0, 0, 1, 1), (0, 1, 1, 220, 0.0, 3, 0.0, 0, 0.0, 0, 0, 1),
    (0, 1, 1, 3, 0.0, 18, 0.0, 5, 0.0, 0, 0, 1), (0, 1, 1, 12, 0.6, 25, 0.0, 30, 0.0, 0, 1, 1),
    (0, 1, 1, 1, 0.0, 2, 0.0, 1, 0.0, 0, 0, 1), (0, 1, 1, 4, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1),
    (0, 1, 1, 3, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1), (0, 1, 1, 2, 0.0, 8, 0.9, 3, 0.0, 1, 0, 1),
    (0, 1, 1, 6, 1.0, 6, 1.0, 5, 1.0, 0, 1, 1), (0, 1, 1, 1, 1.0, 0, 0.0, 30, 0.0, 0, 0, 1),
    (0, 1, 1, 25, 0.9, 2, 1.0, 40, 0.8, 0, 0, 1), (0, 1, 1, 40, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1),
    (0, 1, 1, 2, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (0, 1, 1, 5, 0.5, 5, 0.6, 6, 0.7, 0, 1, 1),
    # outside it, on pages that have one
    (0, 0, 1, 3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (0, 0, 1, 10, 0.0, 3, 0.4, 12, 0.0, 0, 0, 0),
    (0, 0, 1, 26, 0.1, 70, 0.0, 5, 0.0, 0, 0, 0), (0, 0, 1, 6, 1.0, 6, 1.0, 6, 1.0, 0, 1, 0),
    (0, 0, 1, 45, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0), (0, 0, 1, 30, 0.0, 3, 1.0, 30, 0.0, 0, 0, 0), (0, 0, 1, 5, 0.0, 7, 0.9, 40, 0.0, 1, 0, 0),
    (0, 0, 1, 20, 0.0, 30, 0.0, 60, 0.0, 0, 0, 0), (0, 0, 1, 1, 0.0, 40, 0.0, 70, 0.0, 0, 0, 0),
    (0, 0, 1, 80, 0.0, 5, 0.0, 90, 0.0, 0, 0, 0), (0, 0, 1, 5, 0.0, 30, 0.0, 25, 0.0, 1, 0, 0),
    (0, 0, 1, 150, 0.0, 0, 0.0, 150, 0.0, 0, 0, 0), (0, 0, 1, 4, 0.0, 60, 0.0, 60, 0.0, 0, 1, 0),
    (0, 0, 1, 60, 0.0, 40, 1.0, 55, 0.0, 0, 0, 0), (0, 0, 1, 95, 0.1, 6, 0.9, 70, 0.0, 0, 0, 0),
    (0, 0, 1, 38, 0.0, 20, 1.0, 25, 1.0, 0, 0, 0), (0, 0, 1, 52, 0.0, 12, 0.8, 30, 0.1, 0, 0, 0),
    (0, 0, 1, 22, 0.0, 35, 0.0, 41, 0.0, 0, 0, 0), (0, 0, 1, 65, 0.0, 33, 0.0, 28, 0.0, 0, 0, 0),
    (0, 0, 1, 12, 0.0, 28, 0.1, 50, 0.0, 0, 1, 0), (0, 0, 1, 7, 0.0, 45, 0.0, 38, 0.0, 1, 0, 0),
    (0, 0, 1, 33, 0.2, 25, 0.0, 62, 0.0, 0, 0, 0), (0, 0, 1, 9, 0.0, 52, 0.0, 30, 0.0, 0, 0, 0),
    # pages without such an element: size and links of the block and its neighbours
    (0, 0, 0, 60, 0.0, 8, 0.0, 45, 0.0, 0, 0, 1), (0, 0, 0, 35, 0.1, 60, 0.0, 50, 0.0, 0, 0, 1),
    (0, 0, 0, 22, 0.0, 4, 0.0, 70, 0.0, 0, 0, 1), (0, 0, 0, 18, 0.2, 33, 0.0, 4, 0.8, 0, 0, 1),
    (0, 0, 0, 6, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1), (0, 0, 0, 2, 0.0, 30, 0.0, 28, 0.1, 0, 0, 1),
    (0, 0, 0, 7, 0.0, 3, 1.0, 48, 0.0, 1, 0, 1), (0, 0, 0, 9, 0.0, 50, 0.0, 26, 0.0, 0, 1, 1),
    (0, 0, 0, 4, 0.0, 24, 0.0, 80, 0.0, 1, 0, 1), (0, 0, 0, 15, 0.0, 20, 0.0, 16, 0.0, 0, 0, 1),
    (0, 0, 0, 5, 0.0, 40, 0.0, 25, 0.0, 0, 0, 1), (0, 0, 0, 4, 0.0, 22, 0.0, 21, 0.0, 0, 1, 1),
    (0, 0, 0, 8, 0.0, 25, 0.0, 9, 0.0, 0, 1, 1), (0, 0, 0, 3, 0.0, 30, 0.0, 35, 0.0, 1, 0, 1),
    (0, 0, 0, 25, 0.0, 0, 0.0, 2, 1.0, 0, 0, 1), (0, 0, 0, 40, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1),
    (0, 0, 0, 90, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (0, 0, 0, 12, 0.1, 45, 0.0, 2, 1.0, 0, 0, 1),
    (0, 0, 0, 3, 1.0, 3, 1.0, 4, 1.0, 0, 1, 0), (0, 0, 0, 5, 0.8, 40, 0.0, 3, 1.0, 0, 0, 0),
    (0, 0, 0, 14, 0.9, 2, 1.0, 60, 0.0, 0, 0, 0), (0, 0, 0, 4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (0, 0, 0, 6, 0.0, 4, 0.0, 5, 0.6, 0, 0, 0), (0, 0, 0, 3, 0.0, 50, 0.0, 2, 0.5, 0, 0, 0),
    (0, 0, 0, 30, 0.7, 25, 0.0, 30, 0.6, 0, 0, 0), (0, 0, 0, 8, 0.5, 5, 0.5, 6, 0.7, 0, 1, 0),
    (0, 0, 0, 2, 0.0, 0, 0.0, 3, 1.0, 1, 0, 0), (0, 0, 0, 7, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0),
    (0, 0, 0, 40, 1.0, 0, 0.0, 5, 0.0, 0, 0, 0), (0, 0, 0, 60, 0.9, 30, 0.0, 45, 0.0, 0, 0, 0),
    (0, 0, 0, 25, 0.8, 0, 0.0, 30, 0.0, 0, 1, 0), (0, 0, 0, 8, 1.0, 50, 0.0, 40, 0.0, 0, 0, 0),
    (0, 0, 0, 12, 0.7, 28, 0.1, 22, 0.0, 0, 0, 0), (0, 0, 0, 35, 1.0, 5, 0.0, 0, 0.0, 0, 0, 0),
    (0, 0, 0, 25, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1), (0, 0, 0, 31, 0.0, 5, 0.0, 0, 0.0, 0, 0, 1),
    (0, 0, 0, 27, 0.0, 5, 0.0, 3, 0.0, 0, 0, 1), (0, 0, 0, 20, 0.0, 24, 0.0, 3, 0.0, 0, 0, 1),
    (0, 0, 0, 24, 0.1, 60, 0.0, 1, 0.0, 0, 0, 1), (0, 0, 0, 36, 0.0, 0, 0.0, 2, 0.0, 0, 0, 1),
    (0, 0, 0, 55, 0.0, 40, 1.0, 30, 0.0, 0, 0, 1), (0, 0, 0, 48, 0.1, 6, 0.9, 35, 0.9, 0, 0, 1),
    (0, 0, 0, 70, 0.0, 25, 1.0, 20, 1.0, 0, 0, 1), (0, 0, 0, 27, 0.0, 8, 1.0, 24, 0.0, 0, 0, 1),
    (0, 0, 0, 31, 0.0, 4, 1.0, 27, 0.0, 0, 0, 1), (0, 0, 0, 27, 0.0, 31, 0.0, 4, 1.0, 0, 0, 1),
    # the same lengths between long lists of links, and between paragraphs
    (0, 0, 0, 6, 0.0, 40, 1.0, 55, 0.9, 0, 0, 0), (0, 0, 0, 2, 0.0, 30, 0.9, 28, 1.0, 0, 0, 0),
    (0, 0, 0, 9, 0.0, 50, 1.0, 26, 1.0, 0, 1, 0), (0, 0, 0, 4, 0.0, 24, 0.8, 80, 0.9, 1, 0, 0),
    (0, 0, 0, 15, 0.0, 20, 1.0, 16, 0.9, 0, 0, 0), (0, 0, 0, 5, 0.0, 40, 0.9, 25, 0.8, 0, 0, 0),
    (0, 0, 0, 8, 0.0, 25, 1.0, 22, 1.0, 0, 1, 0), (0, 0, 0, 3, 0.0, 30, 0.8, 35, 1.0, 1, 0, 0),
    (0, 0, 0, 11, 0.1, 60, 1.0, 45, 0.9, 0, 0, 0), (0, 0, 0, 5, 0.1, 33, 1.0, 70, 1.0, 0, 0, 0),
    (0, 0, 0, 10, 0.0, 26, 0.9, 31, 1.0, 0, 0, 0), (0, 0, 0, 13, 0.0, 44, 1.0, 90, 0.8, 0, 0, 0),
    (0, 0, 0, 6, 0.0, 60, 0.1, 55, 0.0, 0, 0, 1), (0, 0, 0, 10, 0.0, 26, 0.0, 31, 0.1, 0, 0, 1),
    (0, 0, 0, 13, 0.1, 44, 0.0, 90, 0.0, 0, 0, 1), (0, 0, 0, 11, 0.0, 30, 0.2, 45, 0.0, 0, 0, 1),
)
DEPTH = 9


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH):
    """A binary decision tree by Gini impurity: ``(feature, limit, low, high)``
    nodes and label leaves."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, k] <= limit
            parts = [labels[low], labels[~low]]
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(limit), low)
    if best is None:
        return int(share >= 0.5)
    _, k, limit, low = best
    return (k, limit, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def trained_tree(table=LABELLED):
    rows = np.array(table, float)
    return grow(rows[:, :-1], rows[:, -1])


def classify(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        feature, limit, low, high = tree
        tree = low if row[feature] <= limit else high
    return tree


def main_text(page: str | None, tree) -> str:
    """The article's blocks, joined by line feeds."""
    if not page:
        return ""
    found = blocks(page)
    has_content = int(any(b.content and not b.never for b in found))
    density = [b.linked / b.words if b.words else 0.0 for b in found]
    kept = []
    for k, b in enumerate(found):
        before, after = k - 1, k + 1
        row = (int(b.never), int(b.content), has_content, b.words, density[k],
               found[before].words if before >= 0 else 0, density[before] if before >= 0 else 0.0,
               found[after].words if after < len(found) else 0, density[after] if after < len(found) else 0.0,
               int(b.heading), int(b.listed))
        if classify(tree, row):
            kept.append(b.text)
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = trained_tree()
    picked = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(picked.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return picked.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
