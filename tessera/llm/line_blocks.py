"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: every block-level tag ends one, so nested layout leaves empty lines.
The lengths of the lines are summed over a sliding window; where the sum surges text begins, where
it dives to nothing text ends, and the lines between are kept. What markup tells bears on the
lengths: lines of menus, headers, forms, adverts, comments and the like have none, links count for
nothing, and lines of an article element count as long as a surge asks for, however short they are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Lines of a window, and the summed characters of a surge (half of the page's largest sum, where that is less).
WINDOW, SURGE = 3, 80
#: A heading belongs to the text that follows it by this many lines or fewer.
NEAR = 6

TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</[^A-Za-z>][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, with content that is no markup, and that begin and end lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
#: Elements whose start ends an open one of those named, unless one of the barriers lies between.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("ul ol dl table tbody thead tfoot select div section article main body".split())

#: Elements that are never part of an article's text.
NEVER = frozenset("nav aside footer menu noscript template svg object canvas audio video select button datalist dialog applet map progress meter".split())
#: Roles and words of classes and ids that say the same, whatever lies within.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored promo promotion promoted"
    " comment comments commentlist disqus reply replies respond responses related recommended recommendations".split()
)
#: The same, unless an article begins within: such names also stand on a wrapper of the whole page.
LAYOUT = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar sidenav aside widget widgets cookie cookies"
    " consent gdpr notice notices notification notifications alert alerts popup modal overlay banner newsletter subscribe subscription signup"
    " login form search share sharing social pagination pager toolbar copyright disclaimer skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: has-sidebar and the like are said of what is beside it; an article has a header of its own.
NEGATED, OWN = frozenset("has no not with without".split()), frozenset("article post entry content story".split())
RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)


class Line(NamedTuple):
    at: int  # its number, empty lines counted
    text: str
    linked: int  # characters of it in links
    aside: bool  # in an element that is no part of the article
    article: int  # number of the outermost article around it, 0 if none
    main: bool
    parent: int  # number of the element that it lies in
    heading: bool


class Element(NamedTuple):
    tag: str
    aside: str  # "" or why it is no part of the article: never, layout
    article: int
    main: bool
    number: int


def names_of(attributes: str) -> tuple[list[str], set[str]]:
    """The classes and ids of a tag, and its roles."""
    names, roles = [], set()
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if key.lower() in ("class", "id"):
            names += value.split()
        else:
            roles |= set(value.lower().split())
    return names, roles


def why_aside(tag: str, names: list[str], roles: set[str], within: bool) -> str:
    """never or layout, if the element is no part of an article; within: whether it lies in one, where headers are the article's."""
    if tag in NEVER:
        return "never"
    if tag in ("html", "body", "main"):
        return ""
    found = "layout" if tag == "form" or roles & ROLES or (tag == "header" and not within) else ""
    for name in names:
        words = [w.lower() for w in WORD.findall(name)]
        seen = set(words) | {part.lower() for part in re.split(r"[-_]", name)}
        if seen & NEGATED:
            continue
        if seen & ASIDE:
            return "never"
        hit = seen & LAYOUT
        if hit and not (hit == {"header"} and (within or seen & OWN)):
            found = "layout"
    return found


def lines_of(page: str) -> list[Line]:
    """The lines of a page that hold text, white space within them made one blank, in page order."""
    stack, found, here, linked = [Element("", "", 0, False, 0)], [], [], 0
    at = number = pos = articles = 0
    heading = False

    def end_line() -> None:
        nonlocal at, linked, heading
        if here:
            text = " ".join("".join(here).split())
            if text:
                top = next(e for e in reversed(stack) if e.tag not in INLINE and e.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"))
                inmost = stack[-1]
                found.append(Line(at, text, linked, bool(inmost.aside), inmost.article, inmost.main, top.number, heading))
            here.clear()
        at, linked, heading = at + 1, 0, False

    def say(raw: str) -> None:
        nonlocal linked, heading
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            here.append(text)
            if any(e.tag == "a" for e in stack[-4:]):
                linked += len(text.strip())
            heading = heading or any(e.tag in ("h1", "h2", "h3") for e in stack[-4:])

    while match := TAG.search(page, pos):
        say(page[pos:match.start()])
        pos = match.end()
        closing, tag, attributes = match.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            here.append(" ")
            continue
        block = tag not in INLINE
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not block and any(e.tag not in INLINE and e.tag != "p" for e in stack[depth + 1:]):
                depth = 0  # an inline element does not end a block that began within it
            # What an aside element says inline is set apart from the words around it.
            if block or (depth and stack[depth].aside and not stack[depth - 1].aside):
                end_line()
            if depth:
                del stack[depth:]
            continue
        if tag in RAW:
            if tag != "title":
                here.append(" ") if tag in ("textarea", "iframe") else None
            over = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            pos = over.end() if over else len(page)
            continue
        names, roles = names_of(attributes) if "=" in attributes else ([], set())
        if block:
            end_line()
            # An open paragraph, or item of the same list, ends here.
            ended = ENDED_BY.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in BARRIERS or (stack[i].tag not in INLINE and not ENDED_BY.get(tag)):
                    break
        elif tag == "a" and any(e.tag == "a" for e in stack[-3:]):
            depth = max(i for i in range(len(stack)) if stack[i].tag == "a")
            if all(e.tag in INLINE for e in stack[depth:]):
                del stack[depth:]
        if tag in VOID or attributes.endswith("/") and tag in ("path", "svg"):
            continue
        above = stack[-1]
        is_main = tag == "main" or "main" in roles or "articlebody" in roles
        own = why_aside(tag, names, roles, above.article > 0 or above.main)
        opens = (tag == "article" or is_main) and not own
        aside = above.aside if above.aside == "never" or (above.aside and not opens) else own
        article = above.article
        if tag == "article" and not aside and not article:
            articles += 1
            article = articles
        if not block and aside and not above.aside:
            end_line()
        number += 1
        stack.append(Element(tag, aside, article, above.main or (is_main and not aside), number))
    say(page[pos:])
    end_line()
    return found


def sums_of(lengths: list[int], window: int = WINDOW) -> list[int]:
    """At each line, the summed lengths of it and those after it in the window."""
    total, found = 0, [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        found[i] = total
    return found


def surges_and_dives(sums: list[int], surge: float) -> Iterator[tuple[int, int]]:
    """(first, end): from a line where the sum is above surge to the line where it has fallen to nothing."""
    begun = None
    for i, s in enumerate(sums):
        if begun is None and s > surge:
            begun = i
        elif begun is not None and s == 0:
            yield begun, i
            begun = None
    if begun is not None:
        yield begun, len(sums)


def plain(line: Line) -> int:
    """The length of a line that counts: without links, and none where most of it is links."""
    return 0 if 2 * line.linked > len(line.text) else len(line.text) - line.linked


def kept(lines: list[Line], lengths: dict[int, int], surge: float, window: int) -> list[Line]:
    """The lines between surges and dives; lengths: of the lines that may be kept, by number."""
    by_line = [0] * (max(lengths, default=-1) + 1)
    for at, n in lengths.items():
        by_line[at] = n
    inside = set()
    for first, end in surges_and_dives(sums_of(by_line, window), surge):
        inside.update(range(first, end))
    return [x for x in lines if x.at in inside and x.at in lengths]


def of_articles(lines: list[Line]) -> list[Line]:
    """The lines that markup says are the article: of main, or of the articles in it if these hold half of it; of all articles without main."""
    inside = [x for x in lines if x.main]
    own = [x for x in inside or lines if x.article]
    linked = {}
    for x in own:
        text, links = linked.get(x.article, (0, 0))
        linked[x.article] = (text + len(x.text), links + x.linked)
    # Cards that only link elsewhere are no articles.
    own = [x for x in own if 2 * linked[x.article][1] <= linked[x.article][0]]
    if inside and 2 * sum(len(x.text) for x in own) < sum(len(x.text) for x in inside):
        return inside
    return own


def blocks_of_text(page: str, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The blocks of a page's main text."""
    lines = [x for x in lines_of(page) if not x.aside]
    told = of_articles(lines)
    if told:
        lengths = {x.at: max(plain(x), surge + 1) for x in told}
        return [x.text for x in kept(lines, lengths, surge, window)]
    lengths = {x.at: plain(x) for x in lines if not RIGHTS.search(x.text)}
    by_line = [0] * (max(lengths, default=-1) + 1)
    for at, n in lengths.items():
        by_line[at] = n
    need = min(surge, max(sums_of(by_line, window), default=0) / 2)
    dense = kept(lines, lengths, need, window)
    # Short lines beside the dense ones in the same element, and headings just before, are the text's too.
    parents, may = {x.parent for x in dense if lengths[x.at] > need / 2}, [x for x in lines if x.at in lengths]
    for i, x in enumerate(may):
        leads = x.heading and any(y.parent in parents and y.at - x.at <= NEAR for y in may[i + 1:i + 1 + NEAR])
        if lengths[x.at] and (x.parent in parents or leads):
            lengths[x.at] = max(lengths[x.at], surge + 1)
    return [x.text for x in kept(lines, lengths, need, window)]


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks_of_text(page or ""))


def text_of(html: Column) -> Column:
    """The main text of each page; '' where there is none or html is null."""

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extracted(F.coalesce(html, F.lit("")))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text, and n_chars, its code points, in place of html_col.

    Null and empty pages, and those without an article, have ''. Each row is worked on by itself:
    repeated rows and null ids come back as they are, an empty table gives no rows, a page of any
    length is read whole. Columns named like the two new ones are replaced. Nothing is shuffled.
    """
    found = pages.drop(*{text_col, "n_chars"} - {html_col}).withColumn(text_col, text_of(F.col(html_col)))
    return found.drop(*{html_col} - {text_col}).withColumn("n_chars", F.length(text_col).cast("long"))


def op11(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
