"""Main text of web pages: two-pass block rules over a page's blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow

# Element names of HTML, frequent function words, and words that name page furniture.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe svg math object audio video canvas textarea title select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset head".split())
HOME = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer dropdown footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommend recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
STOP_WORDS = frozenset("a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind und von war wie wir zu zum zur al como con del el ella en entre era es esta este fue ha la las lo los más me muy no o para pero por que se ser si sin sobre su sus también un una y".split())

# First parts of class names that say how a page is laid out, not what an element is.
MODIFIERS = frozenset("has no with without is not hide hidden show layout page body js single col row grid content main entry article post".split())

#: Characters from which a block is long, and up to which it is short; share of characters in links; share of stop words.
LONG, SHORT, LINKS, STOPS = 140, 70, 0.4, 0.12
#: Share of a page's text from which an element that only its class, or a form's tag, marks as furniture may be a wrapper of the page.
WRAPPER = 0.5

# a quote begins a value only behind an equals sign; elsewhere it is a character like others
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z0-9]+")

GOOD, BAD, UNSURE = 1, -1, 0


@dataclass
class Region:
    """An element that its tag, role or class marks as furniture. ``soft``: by class or as a form, which may also wrap a page."""

    soft: bool
    chars: int = 0
    heading: bool = False


@dataclass
class Block:
    """Pieces of text with the regions they lie in and whether they are links, and the regions around the block."""

    regions: tuple[Region, ...] = ()
    home: int = 0  # number of the article or main element around it, 0 if none
    heading: bool = False
    text: list[tuple[str, tuple[Region, ...], bool]] = field(default_factory=list)


def _names_furniture(value: str, whole: bool) -> bool:
    """Whether one of an element's classes names furniture: as a ``whole``, or by a part, unless the name only says that a page has such a thing."""
    for name in value.split():
        parts = [] if whole else _PARTS.findall(name)
        if name in NAMES or parts and parts[0] not in MODIFIERS and NAMES.intersection(parts):
            return True
    return False


def _furniture(tag: str, rest: str, inside_home: bool) -> Region | None:
    if tag in FURNITURE and tag != "form" or tag == "header" and not inside_home:
        return Region(False)
    soft = tag == "form"
    for m in _ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name in ("hidden", "aria-hidden", "role", "class", "id"):
            value = html.unescape((m[2] or "").strip("\"'")).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return Region(False)
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                soft = soft or _names_furniture(value, tag == "article")
    return Region(True) if soft else None


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order. Comments, tags and the content of raw elements are left out; a tag that the page's end cuts is markup."""
    found, now = [], Block()
    stack: list[tuple[str, tuple[Region, ...], int]] = []  # element, regions around, home
    links = homes = at = 0

    def put(text: str):
        if text:
            regions = stack[-1][1] if stack else ()
            now.text.append((text, regions, links > 0))
            for r in regions:
                r.chars += len(text.strip())

    def fresh():
        nonlocal now
        if now.text:
            found.append(now)
        tag, regions, home = stack[-1] if stack else ("", (), 0)
        now = Block(regions, home, tag in HEADINGS)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if any(tag == name for name, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                links = 0 if tag in BLOCK else links
            if tag in BLOCK:
                fresh()
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK:
                fresh()
            continue
        if tag == "br":
            put(" ")
        if tag in BLOCK:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and any(tag == name for name, _, _ in stack):
                near = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                if not any(name in ("ul", "ol", "dl", "table", "div", "section", "blockquote", "article", "main", "aside", "form") for name, _, _ in stack[near + 1 :]):
                    del stack[near:]  # these end where the next begins
            links = 0
        if tag == "a":
            links += 1
        if tag not in VOID and not m[3].endswith("/"):
            _, regions, home = stack[-1] if stack else ("", (), 0)
            if tag in ("h1", "main"):
                for r in regions:
                    r.heading = True
            region = _furniture(tag, m[3], bool(home))
            if region:
                regions = (*regions, region)
            if tag in HOME and not home:
                homes += 1
                home = homes
            if tag in BLOCK or region or tag == "a":
                stack.append((tag, regions, home))
        if tag in BLOCK:
            fresh()
    if now.text:
        found.append(now)
    return found


def first_pass(text: str, linked: int, furniture: bool) -> int:
    """Decide by place, link density, length and stop words; short blocks stay unsure."""
    if furniture or linked > LINKS * len(text):
        return BAD
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))
    if len(text) >= LONG and stops >= STOPS:
        return GOOD
    if len(text) >= LONG and stops < STOPS / 4 and linked:
        return BAD
    return UNSURE


def _plain(pieces: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(pieces))).strip()


def main_text(page: str | None) -> str:
    """Kept blocks, joined by line feeds.

    An element that only its class, or a form's tag, marks as furniture is taken
    for a wrapper if it holds most of the page's text and either its heading or
    all that could be kept. Inline furniture is cut out of its block.

    An unsure block takes the label of its nearest decided neighbour, among
    those of its article or main element that aren't furniture, or among all where
    it has no such element; at equal distance a heading takes the label of what
    follows it, and for others the good one wins only inside one. Without any
    decided neighbour it is kept inside an article or main element, or if the page
    has nothing else.
    Where good text lies mostly inside such elements, text outside goes; a short
    teaser in an article element leaves the text around it alone.
    """
    parsed = blocks(page or "")
    chars = sum(len(t.strip()) for b in parsed for t, _, _ in b.text)

    def labelled(neutral: set[int]) -> list[tuple[str, int, int, bool, bool]]:
        out = []
        for b in parsed:
            bad = any(id(r) not in neutral for r in b.regions)
            pieces = [(t, linked) for t, regions, linked in b.text if bad or all(id(r) in neutral for r in regions)]
            if text := _plain([t for t, _ in pieces]):
                out.append((text, first_pass(text, sum(len(t.strip()) for t, linked in pieces if linked), bad), b.home, bad, b.heading))
        return out

    large = {id(r): r for b in parsed for _, regions, _ in b.text for r in regions if r.soft and r.chars > WRAPPER * chars}
    found = labelled({k for k, r in large.items() if r.heading})
    if large and not any(label == GOOD for _, label, *_ in found):
        found = labelled(set(large))
    inside, outside = (sum(len(text) for text, label, home, *_ in found if label == GOOD and bool(home) is x) for x in (True, False))
    some_home = any(home for _, label, home, *_ in found if label != BAD) and inside >= outside
    near: dict[int, list[int]] = {}
    for k, (_, label, home, furniture, _) in enumerate(found):
        if label and not (home and furniture):  # an advert says nothing of the text around it
            near.setdefault(home, []).append(k)
    every = sorted(k for ks in near.values() for k in ks)
    kept = []
    for k, (text, label, home, _, heading) in enumerate(found):
        if label == UNSURE:
            around = near.get(home, []) if home else every
            label = nearest(found, around, k, bool(home), heading)
            if label == UNSURE:
                label = GOOD if home or not some_home else BAD
        if label == GOOD and (home or not some_home):
            kept.append(text)
    return "\n".join(kept)


def nearest(found: list[tuple], around: list[int], k: int, lenient: bool, heading: bool) -> int:
    """Label of the decided block nearest to block ``k``."""
    if not around:
        return UNSURE
    place = bisect_left(around, k)
    sides = around[max(0, place - 1) : place + 1]
    at = min(abs(x - k) for x in sides)
    labels = {x - k: found[x][1] for x in sides if abs(x - k) == at}
    if len(set(labels.values())) == 1:
        return labels.popitem()[1]
    return labels[at] if heading else GOOD if lenient else BAD


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null and empty pages, and pages without main text, give an empty text. Pages
    are read whole; rows are taken one by one, so ids and urls may be null or
    repeat; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

        return one

    return map_arrow(rows, make, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
