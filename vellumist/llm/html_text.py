"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block where it can: what stands in menus,
headers, footers, sidebars, notices, adverts, forms or reader comments, or is mostly link text, is bad; what stands in
an article or main element, or is rich in stop words and not short, is good. The rest, short blocks above all, is ambiguous. A form, or an element that only its
class or id condemns, is believed only as far as density agrees: on a page without article or main it is a mere wrapper if it holds more than half
of the page's long blocks rich in stop words (reader comments and adverts are never pardoned). The
second pass gives ambiguous blocks the label of the nearest decided neighbours; between two different ones the nearer, at equal distance
good for blocks with some stop words and bad for others. If nothing on a page is decided, its ambiguous blocks are its text.

Headings, and everything else inside an article that is not boilerplate, stay whatever their length. Boilerplate containers that are never closed
end where an article or main element starts. Within a block, a line break is white space; two in a row end the block.

Defined cases: null or empty html, or a page without text, gives an empty string; repeated rows are extracted each; other columns are ignored;
broken markup is read as far as it makes sense: an unclosed tag is text only if no > follows it at all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can do for from had has have he her his how i if in into is it its more my no not of on one only or other our she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando de del donde el ella en entre era es esta este esto fue ha han hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una uno y ya".split()
)
#: Tags that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea select svg math iframe object canvas audio video button title".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget toolbar login signup search skip".split()
)
#: Marks that also name parts of an article.
OWN_PARTS = frozenset(["header", "banner", "notice", "alert"])
#: Marks that no amount of running text outweighs.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent gdpr comment comments commentlist reply replies respond disqus discussion".split())
CONTENT = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: A tag whose quoted values may hold >, the same without regard to quotes, and comments and declarations.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*+>", re.S)
HEAD_END = re.compile(r"</head\s*>|(?=<body[\s>])", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"\w+")

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINKS_OUTSIDE, LINKS_INSIDE = 0.4, 0.8


class Block:
    __slots__ = ("doubts", "heading", "inside", "linked", "parts", "skip")

    def __init__(self, skips: list[list], inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.inside, self.heading = 0, inside, heading
        self.skip = any(s[2] is None for s in skips)  # firmly
        self.doubts = [] if self.skip else [s[2] for s in skips]

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def boilerplate(tag: str, attributes: str, inside: bool) -> str:
    """Whether an element opens boilerplate: "firm", "doubtful" or "". An article's own header is part of the article."""
    if tag in BOILERPLATE and not (inside and tag == "header"):
        return "doubtful" if tag == "form" else "firm"
    if not attributes or tag in ("html", "body") or tag in CONTENT:
        return ""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            marks = MARKS.intersection(re.split(r"[^a-z0-9]+", value))
            if marks & FIRM:
                return "firm"
            if marks - OWN_PARTS if inside else marks:
                found = "doubtful"
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "firm"
    return found


class Tags:
    """The tags, comments and declarations of a page, one after another, in one linear pass.

    A < that no > follows is text. The first quote that is never closed ends the trust in quotes: a failed search goes to the end of the page, so
    it is made once, and from there on every tag ends at its first >.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def after(self, at: int) -> re.Match | None:
        while 0 <= (at := self.page.find("<", at)):
            if at > self.last and not self.page.startswith(("<!--", "<![CDATA["), at):
                return None
            m = None
            if self.quoted and at < self.last:
                m = TAG.match(self.page, at)
            if not m:
                m = OTHER.match(self.page, at) or (PLAIN_TAG.match(self.page, at) if at < self.last else None)
                self.quoted = self.quoted and not (m and m.re is PLAIN_TAG)
            if m:
                return m
            at += 1
        return None


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with what their tags say about them."""
    out: list[Block] = []
    # Open boilerplate and content elements, each with the number of open elements of its own name inside it, and a number if doubtful.
    skips: list[list] = []
    contents: list[list] = []
    links, breaks, heading, doubts = 0, 0, False, 0
    block = Block([], False, False)

    def fresh() -> Block:
        if any(p.strip() for p in block.parts):
            out.append(block)
        return Block(skips, bool(contents), heading)

    at, size, tags, headless = 0, len(page), Tags(page), False
    while at < size:
        m = tags.after(at)
        text = page[at : m.start() if m else size]
        if text:
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())
            if not text.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        if m.re is OTHER:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "head":
            if not closing and not headless:
                end = HEAD_END.search(page, at)
                at, headless = end.end() if end else at, end is None
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag == "br":
            block.parts.append(" ")
            breaks += 1
            if breaks > 1:
                block = fresh()
            continue
        if tag in VOID and tag != "hr" or not closing and attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            breaks = 0
        for held in (skips, contents):
            if held and held[-1][0] == tag:
                held[-1][1] += -1 if closing else 1
        changed = False
        if closing:
            for held in (skips, contents):
                if held and held[-1][0] == tag and held[-1][1] == 0:
                    held.pop()
                    changed = True
        else:
            if tag in CONTENT:
                skips = [] if not contents else skips
                if not skips:
                    contents.append([tag, 1, None])
                    changed = True
            elif not (skips and skips[-1][2] is None) and (kind := boilerplate(tag, attributes, bool(contents))):
                doubts += kind == "doubtful"
                skips.append([tag, 1, doubts if kind == "doubtful" else None])
                changed = True
        if tag in BLOCKS or changed:
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            block = fresh()
    fresh()
    return out


def density(block: Block, text: str) -> tuple[float, float]:
    """Shares of stop words and of link text."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words)), block.linked / max(1, len(text))


def decide(block: Block, text: str, stops: float, links: float) -> str:
    """First pass: good, bad or ""."""
    if block.skip:
        return "bad"
    if links > (LINKS_INSIDE if block.inside else LINKS_OUTSIDE):
        return "" if block.inside and block.heading else "bad"
    return "good" if block.inside or len(text) >= SHORT and stops >= STOP_HIGH else ""


def pardon(found: list[tuple[Block, str]], shares: list[tuple[float, float]]) -> None:
    """Settle the doubtful elements: of a page without content elements, those that hold most of its running text are no boilerplate."""
    running: dict[int, int] = {}
    total = 0
    if not any(b.inside for b, _ in found):
        for (b, t), (stops, links) in zip(found, shares):
            if not b.skip and len(t) >= LONG and stops >= STOP_HIGH and links <= LINKS_OUTSIDE:
                total += len(t)
                for d in b.doubts:
                    running[d] = running.get(d, 0) + len(t)
    for b, _ in found:
        b.skip = b.skip or any(2 * running.get(d, 0) <= total for d in b.doubts)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = [(b, t) for b in blocks_of(page) if (t := b.text())]
    shares = [density(b, t) for b, t in found]
    pardon(found, shares)
    marks = [(decide(b, t, *share), share[0] >= STOP_LOW) for (b, t), share in zip(found, shares)]
    # Distance and label of the nearest decided block on either side.
    sides = []
    for order in (range(len(marks)), range(len(marks) - 1, -1, -1)):
        near, label, side = 0, "", [(0, "")] * len(marks)
        for i in order:
            near += 1
            if marks[i][0]:
                near, label = 0, marks[i][0]
            side[i] = (near, label)
        sides.append(side)
    keep = []
    for (_, text), (mark, some), (da, a), (db, b) in zip(found, marks, *sides):
        if not mark:
            if not a or not b:
                mark = a or b or "good"
            else:
                mark = a if a == b or da < db else b if db < da else "good" if some else "bad"
        if mark == "good":
            keep.append(text)
    return "\n\n".join(keep)


def extract(pages: DataFrame, keep: tuple = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per page: the kept columns, text and n_chars (code points)."""
    fields = [pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in fields])

    return pages.select(*keep, html_col).mapInArrow(run, T.StructType(fields))
