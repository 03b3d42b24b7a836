"""Operator 3: main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; scripts, forms, menus, headers,
footers, sidebars, notices, adverts and reader comments weigh nothing, by element and
by the words of their class, id or role. Such words on a wrapper count for nothing if it
holds a main element, or if it holds an article and half of the page's text while no
article stands outside marked elements. Sums of text lengths over sliding windows of
lines give the distribution: a surge is where it rises above the threshold, a dive is
where it falls back, and the lines between a surge and its dive are the text. Where the
page names its article (article, main), lines outside weigh nothing and the threshold
is 0, so that short blocks inside stay; otherwise links do not count and the threshold
is ``OPEN_THRESHOLD`` characters, or 0 on pages that never reach it.

Null or empty html gives an empty text. Unclosed elements and cut pages are read to
their end. Repeated rows are treated alike; no page is dropped or cut.
"""

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.words import slices, texts_of

WINDOW, OPEN_THRESHOLD = 3, 80
#: Elements whose content is never text of the page.
SILENT = ("script", "style", "title", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "canvas", "datalist")
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
BLOCKS = set(
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A paragraph ends where one of these begins; the same holds for list items and cells.
CLOSES_P = BLOCKS - {"br"}
#: Words of class, id or role that mark an element beside the article.
BESIDE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-?bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|site-?header|page-?header|masthead|cookies?|consent|notice|gdpr|popup|modal|overlay|subscribe|newsletter|"
    r"comments?|comment-?list|replies|respond|disqus|share|sharing|social|related|recommended|widget|complementary|contentinfo|"
    r"toolbar|pagination|skip-?link|alert)(?:$|[^a-z])"
)
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(%s)\b[^>]*>.*?(?:</\1\s*>|\Z)" % "|".join(SILENT), re.S | re.I)
_TAG = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|[!?][^>]*(?:>|\Z))")
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Line(NamedTuple):
    text: str
    aside: bool  # inside an element that is not text of the page
    main: bool  # inside a named article
    linked: int  # characters inside links


def _marked(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body", *MAIN):
        return False
    return any(BESIDE.search((a or b or c).lower()) for a, b, c in _MARKS.findall(attributes))


def lines_of(page: str) -> list[Line]:
    """Text lines in page order, with references decoded and white space made single."""
    page = _SILENT.sub(" ", page)
    out: list[tuple[Line, tuple[int, ...]]] = []  # with the numbers of the marked elements around it
    stack: list[tuple[str, bool, bool, bool]] = []  # name, beside, main, marked
    pieces: list[str] = []
    marked: list[int] = []
    holds_main: set[int] = set()
    holds_article: set[int] = set()
    beside = main = links = linked = at = number = 0

    def close_line():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((Line(text, beside > 0, main > 0, min(linked, len(text))), tuple(marked)))
        pieces.clear()
        linked = 0

    def pop():
        nonlocal beside, main, links
        name, was_beside, was_main, was_marked = stack.pop()
        if was_marked:
            marked.pop()
        beside -= was_beside
        main -= was_main
        links -= name == "a"

    for tag in _TAG.finditer(page):
        piece = page[at : tag.start()]
        if piece:
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close_line()
        if tag[1] or tag[4]:
            # An end tag closes what is open inside; one that opened nothing is passed over.
            if any(open_[0] == name for open_ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID and not (tag[3] or tag[6] or "").rstrip().endswith("/"):
            if name in CLOSES_P and any(o[0] == "p" for o in stack[-4:]):
                while stack[-1][0] != "p":
                    pop()
                pop()
            if name == "main":
                holds_main.update(marked)
            elif name == "article":
                holds_article.update(marked)
            was_beside, was_main = name in ASIDE and not (name == "header" and main > 0), name in MAIN
            was_marked = not was_beside and _marked(name, tag[3] or tag[6] or "")
            stack.append((name, was_beside, was_main, was_marked))
            if was_marked:
                marked.append(number)
                number += 1
            beside += was_beside
            main += was_main
            links += name == "a"
    pieces.append(page[at:])
    close_line()
    void = holds_main
    if holds_article and not any(line.main and not line.aside and void.issuperset(marks) for line, marks in out):
        held = dict.fromkeys(holds_article, 0)
        for line, marks in out:
            for mark in held.keys() & marks if not line.aside else ():
                held[mark] += len(line.text)
        total = sum(len(line.text) for line, _ in out if not line.aside)
        void = void | {mark for mark, chars in held.items() if 2 * chars >= total}
    return [line._replace(aside=line.aside or not void.issuperset(marks)) for line, marks in out]


def between(weights: np.ndarray, threshold: int, window: int = WINDOW) -> np.ndarray:
    """Which lines lie between a surge of the distribution and the dive that follows it."""
    n = len(weights)
    totals = np.concatenate([[0], np.cumsum(weights)])
    ends = np.minimum(np.arange(n) + window, n)
    blocks = totals[ends] - totals[:n]  # window sum that starts at each line
    keep = np.zeros(n, bool)
    inside = False
    for i in range(n):
        if not inside and blocks[i] > threshold and weights[i] > 0:
            inside = True  # surge
        elif inside and (weights[i] == 0 and blocks[i] <= threshold or blocks[i] == 0):
            inside = False  # dive
        keep[i] = inside
    return keep


def main_text(page: str) -> str:
    """Blocks of the main text, joined by one space."""
    lines = lines_of(page)
    if not lines:
        return ""
    named = any(line.main and not line.aside for line in lines)
    weights = np.array(
        [0 if line.aside or (named and not line.main) else len(line.text) if named else len(line.text) - line.linked for line in lines]
    )
    threshold = 0 if named else OPEN_THRESHOLD
    keep = between(weights, threshold)
    if not keep.any() and not named:
        keep = between(weights, 0)
    return " ".join(line.text for line, kept in zip(lines, keep) if kept and not line.aside and (line.main or not named))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page) for page in texts_of(part, "html").to_pylist()]
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
