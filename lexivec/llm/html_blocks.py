"""Main text of web pages by two-pass block rules (operator 10).

A page is cut into blocks at block-level tags; scripts, styles, comments and the
head are markup and never text.  A block knows its words, its stop-word density, its
link density and the container it stands in.

First pass, in every part of a page: a block that is mostly link text is bad; a long one
is good if it holds enough stop words, bad if it holds too few; short ones, and long
ones between the two, stay undecided.  Containers are evidence on top.  Navigation,
headers, footers, asides and containers named as adverts, notices, comments and the
like turn a block bad.  In the article container a block needs more link text to be bad
and is undecided, not bad, where stop words are few.  A form counts for nothing by
itself: its long blocks are judged by their text; if none of them is good, its short ones
are bad.  Where a page
has no good block, the outermost named containers are taken to be wrappers of the page and
their names are void, level by level (not so those of adverts, comments and consent).

Second pass: an undecided block takes the class of its nearest decided neighbours in the
same part of the page (article or elsewhere; both sides agree, else the nearer one; at a
tie the previous one, for a heading the next).  Without any, it is good in the
article, and elsewhere if the page has no article and no good block.  Good blocks, in page order, are
the text.

Stop words are a fixed list for a few languages; in others a page keeps the long blocks of
its article container only.  Words, lengths and densities are those of whole blocks;
nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import prepare

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in is that for on are with as be at this have from or by not but what all were when we there can an
your which their if do will each about how up out them then she many some so these would other into has more
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
le la les de des du et un une en est que qui dans pour pas au sur par plus avec ce il elle sont son ses aux ou mais
el los las y en del que un una por con no su para es al lo como más o pero sus le ya este sí porque esta entre
""".split())

# Tags that end a block, and containers of boilerplate.
BLOCK_TAGS = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template noscript head title svg math iframe object textarea select button label legend".split())
BAD_TAGS = frozenset("nav header footer aside menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKING_TAGS = BAD_TAGS | HIDDEN_TAGS | {"form"}
#: Words in class, id or role that name a boilerplate container.
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies disclaimer discussion footer header masthead menu nav navbar navigation newsletter notice notices
pagination popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe
toolbar widget""".split())

#: Those of them that hold boilerplate even where nothing else on a page is good.
NEVER_VOID = frozenset("""ad ads advert adverts advertisement advertising comment comments consent cookie cookies newsletter
replies reply respond""".split())

#: Least link density of a bad block, least stop-word density of a good one, and
#: the words from which a block is long enough to be judged by itself.
LINK_DENSITY, STOP_DENSITY, LONG_WORDS = 0.6, 0.2, 12
#: Stop-word density of a bad block, at most; link density of a bad block of an article.
FEW_STOPS, ARTICLE_LINKS = 0.1, 0.9
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>=+~^_/\\-\u2013\u2014\u2026\u00ab\u00bb\u201c\u201d\u2018\u2019\u201e"

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}


class Place(NamedTuple):
    """Where a block stands."""
    barred: bool = False  # in boilerplate, by tag or by a name that is never void
    named: int = 0        # containers around it whose names tell of boilerplate
    form: int = 0         # position of the form around it, if any
    article: bool = False


class Block(NamedTuple):
    text: str
    link: float  # share of its characters that are link text
    place: Place
    heading: bool = False


class _Open:
    __slots__ = ("parts", "linked", "place", "heading")

    def __init__(self, place: Place, heading: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        self.place, self.heading = place, heading


def _inside(place: Place, tag: str, attributes: str, at: int) -> Place:
    """The place of what stands in a container that starts at ``at``."""
    names = {w for g in _NAMES.findall(attributes) for w in re.split(r"[^a-z]+", "".join(g).lower())} if attributes else set()
    own = {"header"} if place.article else set()  # an article's own header holds its title
    barred = tag in HIDDEN_TAGS or tag in BAD_TAGS - own or bool(NEVER_VOID & names)
    named = bool((BAD_NAMES - NEVER_VOID - own) & names)
    article = tag in GOOD_TAGS or "articlebody" in attributes.lower()
    return Place(place.barred or barred, place.named + named, at if tag == "form" else place.form, place.article or article)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out = [_Open(Place())]
    stack: list[tuple[str, Place]] = []  # open containers and the place before them
    place, links, at = Place(), 0, 0

    def text(raw: str) -> None:
        raw = entities.unescape(raw)
        out[-1].parts.append(raw)
        if links and raw.strip():
            out[-1].linked += len("".join(raw.split()))

    find = _MARKUP.search
    while True:
        m = find(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at: m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if not closing and tag in _RAW_END:  # raw text up to its end tag
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in HIDDEN_TAGS:
                out.append(_Open(place))
                continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag not in BLOCK_TAGS and not (closing or tag in MARKING_TAGS or "class" in m[3] or "id" in m[3]):
            continue
        if tag == "body" and not closing:
            stack, place = [], Place()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    place = stack[k][1]
                    del stack[k:]
                    break
        elif tag not in VOID_TAGS and not m[3].rstrip().endswith("/"):
            now = _inside(place, tag, m[3], at) if tag not in ("html", "body") else place
            if tag in BLOCK_TAGS or now != place:
                if tag not in ("p", "li", "br") or now != place:
                    stack.append((tag, place))
                    place = now
        if tag in BLOCK_TAGS:
            links = 0
        if tag in BLOCK_TAGS or place != out[-1].place:
            out.append(_Open(place, not closing and tag in HEADINGS))
    found = []
    for b in out:
        t = " ".join("".join(b.parts).split())
        if t:
            found.append(Block(t, b.linked / len(t.replace(" ", "")), b.place, b.heading))
    return found


def first_pass(block: Block, void: int = 0) -> int:
    """1 good, -1 bad, 0 undecided, by links, length and stop words, then its containers;
    ``void`` levels of named containers don't count."""
    place = block.place
    if place.barred or place.named > void or block.link > (ARTICLE_LINKS if place.article else LINK_DENSITY):
        return -1
    words = block.text.lower().split()
    if len(words) < LONG_WORDS:
        return 0
    dense = sum(w.strip(_EDGES) in STOP_WORDS for w in words) / len(words)
    if dense >= STOP_DENSITY:
        return 1
    return -1 if dense <= FEW_STOPS and not place.article else 0


def second_pass(found: list[Block], classes: list[int]) -> list[bool]:
    """Whether each block is main text: undecided ones take the class of the nearest
    decided neighbours in their part of the page."""
    out = [c > 0 for c in classes]
    lone = not any(b.place.article for b in found) and not any(out)
    for part in (True, False):
        at = [i for i, b in enumerate(found) if b.place.article == part and not b.place.barred]
        before: dict[int, int] = {}
        after: dict[int, int] = {}
        for near, order in ((before, at), (after, at[::-1])):
            last = -1
            for i in order:
                if classes[i]:
                    last = i
                elif last >= 0:
                    near[i] = last
        for i in at:
            if not classes[i]:
                b, a = before.get(i), after.get(i)
                if b is None and a is None:
                    out[i] = part or lone
                else:
                    first = a is None or (b is not None and (i - b < a - i or (i - b == a - i and not found[i].heading)))
                    out[i] = classes[b if first else a] > 0
    return out


def classify(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    wrapped = max((b.place.named for b in found), default=0)
    outside = any(b.place.article and not b.place.named for b in found)
    for void in range(wrapped + 1):
        classes = [first_pass(b, void) for b in found]
        texts = {b.place.form for b, c in zip(found, classes) if c > 0}
        classes = [-1 if not c and b.place.form and b.place.form not in texts else c for b, c in zip(found, classes)]
        good = second_pass(found, classes)
        if any(good) or outside:
            break
    return good


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, classify(found)) if good) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null or empty html gives an empty text; a page cut short is read to its end.
    Repeated rows and null ids or urls are kept.  Other columns are ignored; an
    empty table gives no rows."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[main_text(x) for x in b["html"]])[["page_id", "url", "text"]]

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id string, url string, text string") \
        .select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
