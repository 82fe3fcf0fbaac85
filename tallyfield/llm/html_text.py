"""Main text of web pages by two passes of rules over their blocks.

A page is cut into tags and text, and its text into blocks: stretches that no block-level tag
interrupts. Page furniture (menus, headers, footers, asides, adverts, notices, forms, comments: by
tag, role, class and id) is marked by its container. The first pass decides by stop-word density,
length and link density: furniture and blocks of links are bad, long blocks with enough stop
words are good, and so on; short blocks, headings and, within an article, long blocks without stop
words stay open. The second pass gives each open block the label of its nearest decided neighbour
(good on ties), within the article if it stands in one. Where ``article`` elements (or else
``main``) hold at least a quarter of the good words, good blocks outside of them turn bad. A
page in a language without stop words here is judged by length and links alone.

Pages are read in time proportional to their length, whole, and pages that end anywhere are fine:
an open element ends with the page, an open tag or comment is dropped with what it holds.

Defined results: a null or empty page, or one without main text, gives an empty text. Character
references are decoded as browsers do, once; all Unicode white space, no-break spaces too, counts
as white space. ``br`` separates words, other inline tags don't. Repeated rows stay repeated; null
ids and links stay null. No rows in, no rows out. Columns other than these three don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

#: Pages whose texts a task holds at a time.
ROWS = 64
TEXT = "page_id long, url string, text string, n_chars long"
#: First-pass thresholds: characters of a short and of a sure block, share of linked characters, share of stop words.
SHORT, SURE, LINKED, FEW_STOPS, STOPS = 70, 200, 0.34, 0.08, 0.2

#: Common words of English, French, German and Spanish prose.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or our
    she so some than that the their them they this to up was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que
    qui sa se ses son sont sur un une vous été
    aber als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch oder sich
    sie sind so über um und uns vom von vor war wie wir wird zu zum zur
    al algo como con cuando del desde donde el ella ellos en era es esta este esto fue ha hay la las le lo los más me muy ni no nos o para pero
    por que se ser si sin sobre su sus también un una uno unos y ya
    """.split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdo big cite code del dfn em font i ins kbd mark nobr q s samp small strike strong sub sup tt u var".split())
#: Elements of which nothing is read, and those among them that hold text without tags.
UNREAD = frozenset("applet audio button canvas datalist iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Furniture by tag and by role; what a class or id says word by word.
FURNITURE_TAGS = frozenset("aside dialog fieldset footer form header menu nav search".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    """
    ad ads adsbygoogle advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie
    cookies copyright disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay
    pager pagination popup promo promotion recommendations recommended related replies reply respond share sharing sidebar signup skip social
    sponsor sponsored subscribe subscription toolbar topbar
    """.split()
)
#: Words that stay furniture even around an article element, and those that don't count within an article.
ALWAYS, NOT_WITHIN = frozenset("comment comments commentlist disqus replies reply respond sidebar related recommended recommendations".split()), frozenset("header masthead banner".split())
#: A class name with one of these says what else the page has; an article is a comment by its first word.
ASIDE_FROM = frozenset("has no with without hide show open enabled".split())
#: Opening one of these ends an open element of the second kind; they don't reach beyond the third.
ENDS_SAME = {"li": ("li", "ul", "ol", "menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr", "table"), "th": ("td th", "tr", "table"), "option": ("option", "select")}

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*)|(/))")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)|(["']))?)?|(=))""")
WORD = re.compile(r"[^\W\d_]+")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    container: int  # of the innermost article or main, 0 for none
    furniture: tuple[int, ...]
    good: bool | None = None


class Page:
    """The blocks of a page and its containers, read tag by tag."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.links: list[int] = []
        self.linking = False
        # of each open element: tag, whether it is furniture, the article it is in
        self.open: list[tuple[str, int, int]] = []
        self.count: dict[str, int] = {}
        self.furniture: list[int] = []
        self.kind: dict[int, str] = {}  # containers: article or main
        self.spared: set[int] = set()  # furniture that holds an article after all
        self.holds: dict[int, bool | None] = {}  # whether an article within doesn't spare it; None for a plain form
        self.number = 0
        self.container = 0
        self.read(source)
        self.end_block()

    def read(self, source: str) -> None:
        at, closed = 0, {}
        while m := TAG.search(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            comment, odd, closing, name, slash = m.groups()
            if comment:
                end = at + 1 if source.startswith(">", at) else at + 2 if source.startswith("->", at) else source.find("-->", at) + 3
                if end == 2:
                    return
                at = end
            elif odd or slash:
                at = source.find(">", at) + 1
                if not at:
                    return
            else:
                name, attributes = name.lower(), {}
                while True:
                    a = ATTRIBUTE.match(source, at)
                    if a is None or a[6]:  # the page ends within the tag
                        return
                    at = a.end()
                    if a[1]:
                        break
                    if a[2]:
                        attributes.setdefault(a[2].lower(), next((v for v in a.group(3, 4, 5) if v is not None), ""))
                if closing:
                    self.end(name)
                elif name in RAW:
                    if name not in closed:
                        closed[name] = re.compile(rf"</{name}(?=[\s/>])", re.I)
                    end = closed[name].search(source, at)
                    if end is None:
                        return
                    at = end.start()
                else:
                    self.start(name, attributes)
        self.text(source[at:])

    def text(self, text: str) -> None:
        if text and not self.count.get(""):
            self.pieces.append(text)
            self.links.append(len(text) if self.linking else 0)

    def end_block(self) -> None:
        if self.pieces:
            whole = "".join(self.pieces)
            text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if text:
                tags = [t for t, _, _ in self.open[-4:]]
                linked = round(len(text) * sum(self.links) / len(whole))
                self.blocks.append(Block(text, linked, not HEADINGS.isdisjoint(tags), self.container, tuple(self.furniture)))
            self.pieces, self.links = [], []
        self.linking = False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "br":
            self.text(" ")
        if name == "a":
            self.linking = "href" in attributes
        if name in INLINE and not attributes or name in VOID and name != "hr" or name == "a":
            return
        if name in BLOCKS:
            self.end_block()
            if name in ENDS_SAME:
                self.end_open(*ENDS_SAME[name])
            elif self.count.get("p"):  # any block-level tag ends a paragraph
                self.end_open("p", "article", "td", "th", "li", "div", "button")
            if name == "hr":
                return
        unread = name in UNREAD or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
        if name in INLINE and not unread and not self.hinted(attributes):
            return
        self.number += 1
        number, was = 0, self.container
        if name in ("h1", "nav", "header", "footer"):  # a form around these is the page
            self.spared.update(f for f in self.furniture if self.holds[f] is None)
        if unread:
            self.count[""] = self.count.get("", 0) + 1
            number = -1
        elif name == "article" or name == "main" or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody":
            names = [[w.lower() for w in HINT.findall(n)] for n in attributes.get("class", "").split()]
            if any(n and n[0] in ALWAYS and ASIDE_FROM.isdisjoint(n) for n in names):
                number = self.number
            elif not any(self.holds[f] for f in self.furniture):
                self.container = self.number
                self.kind[self.number] = "main" if name == "main" or attributes.get("role") == "main" else "article"
                self.spared.update(self.furniture)
        elif name not in ("html", "body"):
            words = self.hinted(attributes)
            by_tag = name in FURNITURE_TAGS or attributes.get("role", "").lower() in FURNITURE_ROLES
            if self.container and name == "header":
                by_tag = False
            if words or by_tag:
                number = self.number
                self.holds[number] = bool(words & ALWAYS) or name in ("nav", "aside", "footer") or (None if name == "form" and not words else False)
        if number > 0:
            self.furniture.append(number)
            self.holds.setdefault(number, True)
        self.open.append((name, number, was))
        self.count[name] = self.count.get(name, 0) + 1

    def hinted(self, attributes: dict[str, str]) -> set[str]:
        """The furniture words of an element's classes and id."""
        found: set[str] = set()
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            words = {w.lower() for w in HINT.findall(name)}
            if words & FURNITURE_WORDS and not words & ASIDE_FROM:
                found |= words & FURNITURE_WORDS
        return found - NOT_WITHIN if self.container else found

    def close(self) -> None:
        name, number, was = self.open.pop()
        self.count[name] -= 1
        self.container = was
        if number > 0:
            self.furniture.pop()
        elif number < 0:
            self.count[""] -= 1

    def end_open(self, ended: str, *within: str) -> None:
        """Ends an open element of the tags in ``ended``, unless one of ``within`` stands between."""
        ended, at = ended.split(), len(self.open) - 1
        if not any(self.count.get(t) for t in ended):
            return
        while at >= 0 and self.open[at][0] not in ended:
            if self.open[at][0] in within:
                return
            at -= 1
        while at >= 0 and len(self.open) > at:
            self.close()

    def end(self, name: str) -> None:
        if name == "a":
            self.linking = False
        if name in BLOCKS or name == "br":
            self.end_block()
        if not self.count.get(name):
            return
        at = len(self.open) - 1
        while self.open[at][0] != name:
            if name not in BLOCKS and self.open[at][0] in BLOCKS:
                return
            at -= 1
        while len(self.open) > at:
            self.close()


def first_pass(page: Page) -> dict[int, float]:
    """Labels what length, links and stop words decide; the good words of each container."""
    densities, measured = [], []
    for b in page.blocks:
        words = WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        measured.append((b, density, len(words)))
        if len(b.text) >= SHORT and 2 * b.linked <= len(b.text):
            densities.append(density)
    foreign = max(densities, default=0.0) < FEW_STOPS  # no stop words for this language
    good: dict[int, float] = {}
    for b, density, words in measured:
        if not page.spared.issuperset(b.furniture) or b.linked > LINKED * len(b.text) and (b.linked < len(b.text) or not b.container):
            b.good = False
        elif b.heading or len(b.text) < SHORT:
            b.good = None
        elif density >= STOPS or foreign or len(b.text) >= SURE and density >= FEW_STOPS:
            b.good = True
            good[b.container] = good.get(b.container, 0) + words
        elif density < FEW_STOPS and not b.container:
            b.good = False
    return good


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided one, good on ties."""
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, b in enumerate(blocks):
        last = last if b.good is None else (i, b.good)
        before.append(last)
    after, labels = None, []
    for i in range(len(blocks) - 1, -1, -1):
        if blocks[i].good is not None:
            after = (i, blocks[i].good)
            continue
        near = [(abs(i - at), not label) for at, label in (x for x in (before[i], after) if x)]
        labels.append((i, not min(near)[1] if near else blocks[i].container > 0))
    for i, label in labels:
        blocks[i].good = label


def main_text(source: str | None) -> str:
    page = Page(source or "")
    good = first_pass(page)
    for kind in ("article", "main"):
        inside = {c for c, k in page.kind.items() if k == kind and any(b.container == c and b.good is not False for b in page.blocks)}
        if inside and 4 * sum(good.get(c, 0) for c in inside) >= sum(good.values()):
            for b in page.blocks:
                if b.container not in inside:
                    b.good = False
            break
    else:
        inside = set()
    groups: dict[int, list[Block]] = {}
    for b in page.blocks:
        groups.setdefault(b.container if b.container in inside else 0, []).append(b)
    for container, blocks in groups.items():
        second_pass([b for b in blocks if b.good is not False] if container else blocks)
    return " ".join(b.text for b in page.blocks if b.good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [main_text(h.as_py()) for h in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, TEXT)
