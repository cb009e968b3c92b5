"""Main text of web pages by two-pass block rules.

A page is cut into blocks.  First pass: every block is weighed by its link density, its length and its density of stop words, and by
the containers around it, whose elements, roles and class names are evidence and no filter: an article speaks for a block,
a sidebar, a footer or an advert against it, a menu only a little, since its links tell; long and dense prose outweighs what speaks
against it.  The sum calls a block good or bad, or leaves it ambiguous; short blocks and headings are ambiguous unless links or
containers are clearly against them.  Second pass: an ambiguous block takes the label of the nearest decided block, inside an
article of that article (of two equally near ones the earlier; a heading that of the block after it).  Where an article has no decided block, its
ambiguous blocks are good; where a page has no good block, the ambiguous ones with the best containers are.

Only what is never text is left out before that: head, scripts, styles, templates, embedded objects, form controls, forms (but for articles inside
them) and sections of reader comments.  A container that is never closed is no evidence.  Stop words are those of four languages; on a page whose
text holds few of them, its own frequent short words count as well.

Defined results: null or empty html, and pages without text, give an empty
string and n_chars 0; very long pages are read whole, in time that grows with their length;
unclosed and stray tags are tolerated as browsers do; null ids and
urls are passed on; a repeated row is answered alike; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome.llm import tables

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template")}

# Element names and the words by which classes and ids give a container away.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style title textarea noscript iframe template svg select button object canvas".split())
AGAINST_ELEMENTS = frozenset("footer aside dialog".split())
LINKING_ELEMENTS = frozenset("nav menu".split())
AGAINST_ROLES = frozenset("banner contentinfo complementary search form alert alertdialog dialog".split())
LINKING_ROLES = frozenset("navigation menu menubar toolbar".split())
AGAINST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notification alert sidebar footer header masthead social share sharing related recommended recommendations newsletter subscribe "
    "subscription signup popup modal overlay widget login search copyright skip teaser".split()
)
LINKING_WORDS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar".split())
COMMENTS = frozenset("comment comments disqus respond reply replies discussion".split())
OWN = frozenset("article entry post content main story body text".split())
#: Containers whose class or id is looked at.
CONTAINERS = frozenset("div section ul ol dl table p span figure header details article fieldset center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The open blocks that a new block of each name closes, besides a paragraph.
IMPLIED = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could for from had has have he her his how i if in into is it its more no "
    "not of on one or our out she so than that the their them there they this to up was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im ist ja "
    "mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses "
    "son sont sur un une vous y al como con de del el ella en entre era es esta este ha la las lo los más me mi muy no o para pero por que "
    "se ser si sin sobre su sus también un una y ya".split()
)
LINKS_BAD, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.20, 0.30
#: Below this density of the four languages' stop words, a page's own frequent words of at most so many letters count as well.
FOREIGN, OWN_LETTERS, OWN_WORDS = 0.20, 4, 40
GOOD, BAD, OPEN = 1, 0, -1
#: What containers weigh: clearly against, a little against, for, and an article or main element.
AGAINST, LITTLE, FOR, ARTICLE = -3, -1, 1, 2


def _weight(tag: str, attributes: str, inside_main: bool) -> int | None:
    """What a container says about the text inside it; None for one that holds no text of the page."""
    if tag in NEVER:
        return None
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = found.get("role", "").strip().lower()
    names = [{w.lower() for w in WORDS_OF_NAME.findall(n)} for k in ("class", "id") for n in found.get(k, "").split()] if tag in CONTAINERS else []
    words = set().union(*names)
    if words & COMMENTS:
        return None
    if tag in AGAINST_ELEMENTS or role in AGAINST_ROLES or tag == "header" and not inside_main:
        return AGAINST
    # A name of nothing but such words is clear; one that also says something else is a hint.
    if any(n and n <= AGAINST_WORDS for n in names) and not (words & OWN and words & AGAINST_WORDS <= {"header", "banner"}):
        return AGAINST
    if tag in LINKING_ELEMENTS or role in LINKING_ROLES or words & (LINKING_WORDS | AGAINST_WORDS):
        return LITTLE
    return FOR if words & OWN else 0


class _Page:
    """The blocks of one page: (text, characters inside links, heading, innermost article or main or 0, innermost container with a weight or 0).

    Every tag takes constant time on average: the stack of open elements knows where its blocks and its elements of each name are.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool, int, int]] = []
        self.text: list[str] = []
        self.linked = 0
        #: Elements so far; of containers with a weight: those that were closed, the weight of each, and the one around it.
        self.count = 0
        self.closed: set[int] = set()
        self.weights: dict[int, int] = {}
        self.outer: dict[int, int] = {}
        #: Open elements: (tag, whether text is left out, article or main around, in link, number, innermost container with a weight).
        self.open: list[tuple[str, bool, int, bool, int, int]] = [("", False, 0, False, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.headings = 0
        at = 0
        while m := MARKUP.search(html, at):
            self.words(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            else:
                at = self.start(tag, m[3] or m[6] or "", html, at)
        self.words(html[at:])
        self.cut()

    def words(self, raw: str) -> None:
        _, out, _, link, _, _ = self.open[-1]
        if raw and not out:
            text = unescape(raw)
            self.text.append(text)
            if link:
                self.linked += len(text.strip())

    def cut(self) -> None:
        """End the current block."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.linked, self.headings > 0, self.open[-1][2], self.open[-1][5]))
            self.text, self.linked = [], 0

    def push(self, element: tuple[str, bool, int, bool, int, int]) -> None:
        tag = element[0]
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.block_places.append(len(self.open))
            self.headings += tag in HEADINGS
        self.open.append(element)

    def pop_to(self, place: int) -> None:
        """Close the open element at ``place`` and all inside it."""
        while len(self.open) > place:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
                self.headings -= tag in HEADINGS

    def start(self, tag: str, attributes: str, html: str, at: int) -> int:
        if tag in BLOCKS:
            self.cut()
            if tag != "br":
                self.imply(tag)
        if tag in RAW_END:
            end = RAW_END[tag].search(html, at)
            if end is None:
                return len(html)
            close = html.find(">", end.end())
            return len(html) if close < 0 else close + 1
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return at
        _, out, main, link, _, around = self.open[-1]
        weight = _weight(tag, attributes, bool(main))
        self.count += 1
        if tag in ("article", "main") and weight is not None and weight >= 0:
            main = self.count
            out = out and not any(self.places.get("form", ()))  # an article in a form is text
        if weight:
            self.weights[self.count], self.outer[self.count] = weight, around
            around = self.count
        self.push((tag, out or weight is None or tag == "form", main, link or tag == "a", self.count, around))
        return at

    def imply(self, tag: str) -> None:
        """Close what a new block closes by itself: a paragraph, and a list item or cell by its like."""
        if self.block_places:
            place = self.block_places[-1]
            name = self.open[place][0]
            if name == "p" or name in IMPLIED.get(tag, ()):
                self.pop_to(place)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        places = self.places.get(tag)
        if not places or tag not in BLOCKS and self.block_places and places[-1] < self.block_places[-1]:
            return
        self.closed.add(self.open[places[-1]][4])
        self.pop_to(places[-1])

    def evidence(self) -> dict[int, int]:
        """What the containers around the text in each container say together; one that was never closed says nothing."""
        said: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}
        for number, around in self.outer.items():  # from the outermost in
            against, little, for_it = said[around]
            if number in self.closed:
                w = self.weights[number]
                against, little, for_it = min(against, w if w == AGAINST else 0), min(little, w if w == LITTLE else 0), max(for_it, w)
            said[number] = against, little, for_it
        return {number: against or little + for_it for number, (against, little, for_it) in said.items()}


def stop_words(blocks: list[tuple[str, int, bool, int, int]]) -> frozenset[str]:
    """The stop words that fit a page."""
    found = Counter(w.strip(".,;:!?\"'()") for text, linked, *_ in blocks if linked <= LINKS_BAD * len(text) for w in text.lower().split())
    if sum(n for w, n in found.items() if w in STOP_WORDS) >= FOREIGN * sum(found.values()):
        return STOP_WORDS
    own = sorted(((-n, w) for w, n in found.items() if n > 1 and len(w) <= OWN_LETTERS and w.isalpha()))
    return STOP_WORDS | {w for _, w in own[:OWN_WORDS]}


def _density(text: str, stops: frozenset[str]) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in stops for w in words) / len(words)


def _first_pass(text: str, linked: int, heading: bool, evidence: int, stops: frozenset[str]) -> int:
    """A block's label by its links, length, stop words and containers; ``evidence`` is ARTICLE and more inside an article."""
    n = len(text)
    if linked > LINKS_BAD * n:
        return OPEN if heading and evidence >= ARTICLE else BAD
    if heading or n < SHORT:
        return BAD if evidence <= AGAINST or linked and not heading and evidence < ARTICLE else OPEN
    stop = _density(text, stops)
    if stop < STOP_LOW:
        prose = -2 if n > LONG else 0
    else:
        prose = 1 + (stop >= STOP_HIGH and n > LONG) + (n > 4 * LONG) + (n > 10 * LONG)
    total = prose + evidence
    return GOOD if total >= 2 and prose > 0 else BAD if total < 0 else OPEN


def _second_pass(first: list[int], headings: list[bool]) -> list[int]:
    before: list[int] = []
    last = None
    for i, x in enumerate(first):
        last = i if x != OPEN else last
        before.append(-1 if last is None else last)
    out, nxt = list(first), None
    for i in range(len(first) - 1, -1, -1):
        if first[i] != OPEN:
            nxt = i
        elif before[i] < 0 and nxt is None:
            out[i] = GOOD
        elif nxt is None or before[i] >= 0 and i - before[i] <= nxt - i:
            # A heading belongs to what follows it.
            out[i] = first[nxt] if headings[i] and nxt is not None else first[before[i]]
        else:
            out[i] = first[nxt]
    return out


def classify(blocks: list[tuple[str, int, bool, int, int]], evidence: dict[int, int]) -> list[int]:
    """GOOD or BAD for each block."""
    stops = stop_words(blocks)
    said = [e if (e := evidence[around]) <= AGAINST or not main else e + ARTICLE for _, _, _, main, around in blocks]
    first = [_first_pass(text, linked, heading, e, stops) for (text, linked, heading, _, _), e in zip(blocks, said)]
    headings = [b[2] for b in blocks]
    out = _second_pass(first, headings)
    sections: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if b[3]:
            sections.setdefault(b[3], []).append(i)
    for own in sections.values():
        for i, label in zip(own, _second_pass([first[i] for i in own], [headings[i] for i in own])):
            out[i] = label
    if any(first[i] != OPEN for i in range(len(out))) and GOOD in out:
        return out
    # Nothing is good, or nothing decided: the ambiguous blocks with the best containers.
    best = max((e for e, f in zip(said, first) if f == OPEN), default=0)
    return [GOOD if f == OPEN and e == best else BAD for e, f in zip(said, first)]


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = _Page(html)
    labels = classify(page.blocks, page.evidence())
    return " ".join([b[0] for b, label in zip(page.blocks, labels) if label == GOOD])


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points)."""

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return html.map(extract)

    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text")
    ).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(tables.read(spark, sf_dir, "pages"))
