"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block of text. A line's length is its characters outside links.
Tags and classes only weigh on it: elements that never hold the article (menus, scripts, forms, adverts,
...) have no length and no text; where a page marks its article or main element, links inside count in
full, and lines outside count a quarter. An empty line stands between lines of different containers, and WINDOW
empty lines where an article begins or ends, or where a part of the page (menu, header, footer, sidebar, ...) was left
out between two containers; what is left out inside one container leaves no gap, nor do adverts and asides, which stand inside
running text.

The lengths of WINDOW lines from each line on are summed. A stretch runs from where the sum leaves zero to
the dive point, where it falls back to zero; it is kept if it has a surge point, at which the sum reaches
SURGE characters (on pages of little text, half of the page's largest sum, taken inside the marked article if there is one).
All lines between, from the first with a length to the last, are the text.

Defined results: null and empty html give an empty text; a page without text too; unclosed elements end
with what holds them; a tag that is never closed ends the page; a quotation mark that is never closed
counts as none; repeated rows get equal rows; an empty table gives no rows. Extra columns are ignored (by
``extracted`` carried; a column named like a result raises ValueError). Time is linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, with_columns

WINDOW = 3
SURGE = 60
OUTSIDE = 4  # what the length of lines outside a marked article is divided by
# HTML's elements by use, and the class names that mark what isn't the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
NEVER = set("nav footer aside form script style noscript iframe template svg select button textarea dialog head title canvas object audio video menu".split())
NOT_TEXT = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "site-header site-footer page-header page-footer cookie cookies cookie-notice cookie-banner notice notices consent gdpr popup modal overlay newsletter subscribe signup login search related recommended "
    "share sharing social widget toolbar pagination pager comment comments comment-list discussion disqus respond replies".split()
)
# of these, what stands inside running text: it separates nothing
INSERTED = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion newsletter subscribe related recommended share sharing social widget".split())
ARTICLE = {"article", "main"}
BLOCKS = set("p li dt dd h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure figcaption table thead tbody tfoot tr td th caption hr address center details summary".split())  # not containers
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RESULT = T.StructType([T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])


def marks(attributes: str) -> set[str]:
    return {w for m in _MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of each piece of markup; comments and declarations have no name.

    The caller may send a place to go on from. A tag without end reaches to the end of the page. Once
    a quotation mark was never closed, the rest of the page is read without regard to them, so no part is scanned twice.
    """
    at, quoted = 0, True
    last = {c: page.rfind(c) for c in ">\"'"}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            found = (at, len(page) if end < 0 else end + 3, "", False, "")
        elif m := _NAME.match(page, at):
            end = m.end()
            while quoted and (stop := _STOP.search(page, end)) and stop[0] != ">":
                quoted = last[stop[0]] > stop.start()
                end = page.find(stop[0], stop.end()) + 1 if quoted else end
            if quoted and not stop:  # no end outside quotation marks
                quoted = False
            end = stop.start() if quoted else page.find(">", m.end()) if last[">"] > at else -1
            end = len(page) if end < 0 else end
            found = (at, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end])
        elif page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:
            end = page.find(">", at)
            found = (at, len(page) if end < 0 else end + 1, "", False, "")
        else:
            at += 1
            continue
        at = (yield found) or found[1]


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length, whether in an article) of each line; empty lines have neither text nor length."""
    found: list[tuple[str, int, int, int, int]] = []  # text, characters outside links, article, container, elements left out before
    held: list[str] = []
    linked: list[str] = []
    stack: list[str] = []
    opened: dict[str, int] = {}  # how often a name is on the stack
    containers, articles = [0], []  # numbers of the open ones
    hidden = 0  # depth of the stack from which on all is left out; 0: nothing is
    firm = False  # hidden by a comment section: articles in it stay hidden
    number = left_out = links = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            outside = max(0, len(text) - len(" ".join(entities.unescape("".join(linked)).split())))
            found.append((text, outside, articles[0] if articles else 0, containers[-1], left_out))
        held.clear()
        linked.clear()

    at, tags, go_on = 0, tags_of(page), None
    while True:
        try:
            begin, end, name, closing, attributes = tags.send(go_on)
        except StopIteration:
            begin, end, name, closing, attributes = len(page), len(page), "", False, ""
        go_on = None
        text = page[at:begin]
        if text and not hidden:
            held.append(text)
            if links:
                linked.append(text)
        if begin == len(page):
            break
        at = end
        if not name:
            continue
        if name not in INLINE and not hidden:
            flush()
        if closing:
            while opened.get(name):
                gone = stack.pop()
                opened[gone] -= 1
                links -= gone == "a"
                if gone in ARTICLE:
                    articles.pop()
                if gone not in INLINE and gone not in BLOCKS:
                    containers.pop()
                if hidden > len(stack):
                    hidden, firm = 0, False
                if gone == name:
                    break
            continue
        if hidden and not firm and name in ARTICLE:
            hidden = 0
        if name in VOID or attributes.endswith("/"):
            continue
        number += 1
        stack.append(name)
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        if name in ARTICLE:
            articles.append(number)
        if name not in INLINE and name not in BLOCKS:
            containers.append(number)
        if not hidden:
            classes = marks(attributes)
            if name in NEVER or name == "header" and not articles or classes & NOT_TEXT and name not in ("html", "body"):
                flush()
                if not (classes & INSERTED or name == "aside" and not classes & NOT_TEXT):
                    left_out += 1
                hidden = len(stack)
                firm = any(c.startswith(("comment", "discuss", "disqus", "respond", "repl")) for c in classes)
        if name in RAW:
            raw_end = re.compile(rf"</{name}\b", re.I).search(page, at)
            to = raw_end.start() if raw_end else len(page)
            if not hidden:
                held.append(page[at:to])
            at = go_on = to
    flush()

    out: list[tuple[str, int, bool]] = []
    marked = any(article for _, _, article, _, _ in found)
    before = (0, 0, 0)
    for text, outside, article, container, gone in found:
        place = (article, article or container, gone)
        if before[0] != place[0] or before[1] != place[1] and before[2] != gone:
            out.extend([("", 0, False)] * WINDOW)
        elif before[1] != place[1]:
            out.append(("", 0, False))
        before = place
        length = len(text) if article else outside if 2 * outside >= len(text) else 0
        out.append((text, length // OUTSIDE if marked and not article else length, bool(article)))
    return out


def blocks_of(lengths: list[int], window: int = WINDOW) -> list[int]:
    """The sum of the lengths of ``window`` lines from each line on."""
    total = [0, *accumulate(lengths)]
    return [total[min(i + window, len(lengths))] - total[i] for i in range(len(lengths))]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(page or "")
    blocks = blocks_of([length for _, length, _ in lines], window)
    inside = max((b for b, (_, length, article) in zip(blocks, lines, strict=True) if article and length), default=0)
    least = min(surge, (inside or max(blocks, default=0)) / 2)
    out: list[str] = []
    i = 0
    while i < len(lines):
        if not blocks[i]:
            i += 1
            continue
        dive = i
        while dive < len(lines) and blocks[dive]:
            dive += 1
        first = next(k for k in range(i, dive) if lines[k][1])  # the window reaches ahead of the surge
        article = any(a for _, _, a in lines[first:dive])
        if max(blocks[i:dive]) >= (least if article or not inside else surge):
            out.extend(text for text, _, _ in lines[first:dive] if text)
        i = dive
    return " ".join(out)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with main_text and n_chars (its code points). One pass, no shuffle."""

    def make():
        def work(html: pa.Array):
            texts = [main_text(t) for t in html.to_pylist()]
            return [texts, [len(t) for t in texts]]

        return work

    return with_columns(pages, [column], RESULT, make)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "main_text", "n_chars").withColumnRenamed("main_text", "text")
