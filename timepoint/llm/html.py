"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; each block has its text, the share of it inside links, and the elements
it lies in. The first pass decides what it can: blocks inside navigation, headers, footers, sidebars, forms, notices,
adverts and comments (by element, or by words in class, id and role) and blocks that are mostly links are boilerplate;
blocks with many stop words that are long, or of some length with few links, are content. Short blocks, and blocks poor in
stop words whatever their length (lists of names, codes), stay undecided.
In the second pass an undecided block inherits from its nearest decided neighbours in the same container (the article,
the nearest sectioning element), or else on the page: the same label on both sides is taken over, of different ones that
of the nearer block, of equally near ones content.

A name or a form proves little where the element holds the page itself. Navigation, footers, asides, hidden parts and
comments are boilerplate whatever is in them; any other element so marked (a wrapper "right-sidebar", a form around the
page) loses its mark where it holds a main element, the page's only article with at least half of the prose, or nearly
all prose and most text of the page. Parts marked within it keep their own marks.

A page is read in time proportional to its length, also where nothing in it is closed or everything twice.

Defined results: a null or empty page has an empty text; malformed markup never fails (an unclosed element ends with its
parent, a ``<`` that begins no tag is text, an unclosed comment or script, or other raw element, runs to the end); what is
no text of the page (buttons, choices, drawings, templates) is left out, and where such an element is not closed it ends
with its parent or at the next block; a page without any decided block is taken whole, or as nothing where all of it is
boilerplate. Rows are never merged; extra columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column

LONG = 140
SHORT = 25
MAX_LINKS = 0.5
MIN_STOP_WORDS = 0.15
#: Share of a page's prose from which a marked element is taken to be around the page.
NEARLY_ALL = 0.8

#: Elements by their role in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements that hold no markup, up to their closing tag or the end.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements with markup that is no text of the page.
LEFT_OUT = frozenset("noscript template object svg canvas select button annotation annotation-xml".split())
#: Blocks that such an element may hold.
HELD_TAGS = frozenset("option legend hr br".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset("nav aside footer form menu dialog head fieldset".split())
#: Those whose mark stands whatever they hold.
SURE_TAGS = frozenset("nav aside footer head".split())
CONTAINERS = frozenset(["article", "main"])
SECTIONS = frozenset("article main section div body td aside nav header footer form ul ol dl table blockquote".split())
STACKED = BLOCK_TAGS | LEFT_OUT | frozenset("span b i em strong ins section".split())
#: Elements that an opening tag of the same kind closes.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "button": {"button"}, "select": {"select"}}
_ENDS = {tag: closed | SECTIONS | LEFT_OUT for tag, closed in SIBLINGS.items()}
#: Words of class, id and role that name a part beside the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist respond disqus reply replies share sharing social related recommended "
    "widget pagination pager complementary contentinfo search searchbox toc alert disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Beside a word of comments these say how the page is, not what the element is ("comments-open").
STATE_WORDS = frozenset("open opened closed enabled disabled allowed on off".split())
HEADER_WORDS = frozenset(["header", "banner", "masthead"])
ARTICLE_WORDS = frozenset(["article", "post", "entry", "content", "main"])
#: Elements around the whole page or article, whose names say nothing against their content.
WHOLE_TAGS = frozenset(["html", "body", "main", "article"])
#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "the of and to in a is that for it with as was on be by at this from or are an not have he his they you we but which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le les et des que du un dans qui une est pour au sur par plus ne pas se ce "
    "el en los del las por con una su para al lo como más o pero sus".split()
)
#: A comment, a tag with its attributes (a quoted value may hold ">"), or a declaration.
_TOKEN = re.compile(
    r"""<!--(.*?)(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_SHUT = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW_TAGS}
_NEXT = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in LEFT_OUT}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[^\W_]+")
_HAVING = re.compile("(?:has|with|without|no|hide|show)[-_]", re.I)
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Mark:
    """A part beside the article by its name or form only (or the page, as the first), and what lies in it."""

    number: int
    over: Mark | None = None
    prose: int = 0
    text: int = 0
    articles: int = 0
    mains: int = 0


@dataclass
class Element:
    tag: str
    number: int
    aside: bool  # in a part beside the article
    content: bool  # in an article
    container: int  # the nearest article, else the nearest section
    sure: bool  # in a part beside the article whatever it holds
    mark: Mark  # the nearest part that is so by name or form only
    out: bool = False  # in an element that is left out
    closed: bool = True  # whether that one has a closing tag


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None


#: What an element's attributes say of it.
UNNAMED, NAMED, SURE = 0, 1, 2


def named_aside(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element's attributes say that it is no part of the article, and whether that is sure."""
    said = UNNAMED
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return SURE
        if name in ("class", "id", "role") and tag not in WHOLE_TAGS:
            for token in value.split():
                if _HAVING.match(token):  # "has-sidebar" names what is around a sidebar
                    continue
                words = {w.lower() for w in _NAME_WORDS.findall(token)}
                if words & COMMENT_WORDS and not words & STATE_WORDS:
                    return SURE
                if words & ASIDE_WORDS or not inside and words & HEADER_WORDS and not words & ARTICLE_WORDS:
                    said = NAMED
    return said


def blocks(page: str, wrappers: frozenset[int] = frozenset()) -> tuple[list[Block], list[Mark]]:
    """The blocks of a page that have text, and its marks, in order; the elements of the given numbers get no mark."""
    marks = [Mark(0)]
    top = Element("", 0, False, False, 0, False, marks[0])
    stack, found, current, links, numbers = [top], [], Block(top), 0, 0
    at, end = 0, len(page)
    # Where on the stack each tag and the sections are open, so that a closing tag is met without a search.
    places: dict[str, list[int]] = defaultdict(list)
    sections: list[int] = []

    def push(element: Element) -> None:
        places[element.tag].append(len(stack))
        if element.tag in SECTIONS:
            sections.append(len(stack))
        stack.append(element)

    def cut(depth: int) -> None:
        for element in reversed(stack[depth:]):
            places[element.tag].pop()
            if element.tag in SECTIONS:
                sections.pop()
        del stack[depth:]

    def close() -> None:
        nonlocal current
        text = " ".join("".join(current.parts).split())
        if text:
            current.text = text
            found.append(current)
        current = Block(stack[-1])

    def say(raw: str) -> None:
        if raw and not stack[-1].out and (current.element.aside or not stack[-1].aside):  # else in an inline advert or the like
            text = html.unescape(raw)
            current.parts.append(text)
            if links:
                current.linked += len(text)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[3] is None:  # a comment or declaration
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in RAW_TAGS:
            if not closing and not m[4].endswith("/"):
                stop = _SHUT[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if not closing and not stack[-1].closed and tag in BLOCK_TAGS and tag not in HELD_TAGS:  # it ends here
            depth = len(stack)
            while stack[depth - 1].out and not stack[depth - 1].closed:
                depth -= 1
            cut(depth)
        if tag == "a" and (closing or not stack[-1].out):
            links = 0 if closing else 1
        was_out = stack[-1].out
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS and not was_out:
                close()
            continue
        if closing:
            depth = places[tag][-1] if places.get(tag) else 0
            if depth and not (tag not in BLOCK_TAGS and tag not in LEFT_OUT and sections and sections[-1] > depth):
                cut(depth)
        elif tag in STACKED and not (tag in LEFT_OUT and m[4].endswith("/")):
            if tag in SIBLINGS:
                last = max((places[t][-1] for t in _ENDS[tag] if places.get(t)), default=0)
                if last and stack[last].tag in SIBLINGS[tag]:
                    cut(last)
            over, numbers = stack[-1], numbers + 1
            if over.out or tag in LEFT_OUT:
                after = None if over.out else _NEXT[tag].search(page, at)
                closed = over.closed if over.out else after is not None and after[1] == "/"
                push(replace(over, tag=tag, number=numbers, out=True, closed=closed))
                continue
            inside = over.content or tag in CONTAINERS
            named = named_aside(tag, m[4], inside)
            sure, mark = over.sure or tag in SURE_TAGS or named == SURE, over.mark
            marked = named or tag in NOT_CONTENT or tag == "header" and not inside
            if marked and not sure and numbers not in wrappers:
                mark = Mark(numbers, over.mark)
                marks.append(mark)
            elif tag in CONTAINERS and not sure:
                mark.mains += tag == "main"
                mark.articles += tag == "article" and not over.content
            aside = over.aside or sure or mark is not over.mark
            apart = tag in CONTAINERS or aside and not over.aside or tag in SECTIONS and not inside
            container = numbers if apart else over.container
            push(Element(tag, numbers, aside, inside, container, sure, mark))
        if tag in BLOCK_TAGS and not (was_out and stack[-1].out):
            close()
    stack = stack[:1]
    close()
    return found, marks


def around_page(found: list[Block], marks: list[Mark]) -> frozenset[int]:
    """Numbers of the elements that are marked although they hold the page or its article."""
    for block in found:
        if not block.element.sure:
            block.element.mark.text += len(block.text)
            block.element.mark.prose += len(block.text) if by_text(block) else 0
    for mark in reversed(marks[1:]):  # what is in a part is in the one over it
        mark.over.prose += mark.prose
        mark.over.text += mark.text
        mark.over.articles += mark.articles
        mark.over.mains += mark.mains
    page = marks[0]
    return frozenset(
        m.number
        for m in marks[1:]
        if m.mains
        or m.articles == page.articles == 1 and 2 * m.prose >= page.prose
        or m.prose and m.prose >= NEARLY_ALL * page.prose and 2 * m.text >= page.text
    )


def classify(block: Block) -> bool | None:
    """First pass: content, boilerplate, or undecided."""
    return False if block.element.aside else by_text(block)


def by_text(block: Block) -> bool | None:
    """What a block is by its length, stop words and links."""
    n = len(block.text)
    if block.linked > MAX_LINKS * n and not block.element.content:
        return False
    if n < SHORT:
        return None
    words = _WORDS.findall(block.text.lower())
    dense = sum(w in STOP_WORDS for w in words) >= MIN_STOP_WORDS * len(words) if words else False
    return True if dense and (n >= LONG or block.linked * 4 < n) else None


def neighbours(found: list[Block], keys: list[int], *, marked: bool = True) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided blocks of its key, before and after; without ``marked`` only those decided by text."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        side: list[int | None] = [None] * len(found)
        for i in order:
            side[i] = last.get(keys[i])
            if found[i].label is not None and (marked or not found[i].element.aside):
                last[keys[i]] = i
        sides.append(side)
    return list(zip(*sides))


def inherit(found: list[Block]) -> None:
    """Second pass: undecided blocks take the label of their nearest decided neighbours, first in their container.

    Long blocks come first: such a block is no part of an advert or menu beside it, so it looks at blocks that were decided
    by their text only; short ones then look at all that are decided.
    """
    containers, page = [b.element.container for b in found], [0] * len(found)
    for long in (True, False):
        within, overall = neighbours(found, containers, marked=not long), neighbours(found, page, marked=not long)
        labels = [b.label for b in found]
        for i, block in enumerate(found):
            if labels[i] is not None or long and len(block.text) < LONG:
                continue
            near = [j for j in within[i] if j is not None]
            if not near and not block.element.content:
                near = [j for j in overall[i] if j is not None]
            if len({labels[j] for j in near}) == 1:
                block.label = labels[near[0]]
            elif near:
                a, b = near
                block.label = labels[b] if b - i < i - a else labels[a] if i - a < b - i else True
            else:
                block.label = True  # nothing near, or alone in an article


def main_text(page: str | None) -> str:
    """The article's blocks in order, joined by one space."""
    if not page:
        return ""
    found, marks = blocks(page)
    wrappers = around_page(found, marks) if len(marks) > 1 else frozenset()
    if wrappers:
        found, _ = blocks(page, wrappers)
    for block in found:
        block.label = classify(block)
    inherit(found)
    if any(b.element.content and b.label for b in found):
        found = [b for b in found if b.element.content]
    return " ".join(b.text for b in found if b.label)


def extracted(page: Column) -> Column:
    """Column function for ``main_text``."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract.asNondeterministic()(page)


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    return pages.select(
        column(pages, page_id).alias("page_id"), column(pages, url).alias("url"), extracted(column(pages, markup)).alias("text")
    )
