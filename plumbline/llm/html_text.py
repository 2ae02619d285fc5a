"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; nothing but the list of lines
is kept. A line is the text between two block boundaries, with the number of
tags met in it. Its ratio is that of its letters outside links to its tags,
times a weight that elements, roles and class words give it: nought in what
never holds the article (menus, forms, asides, scripts, hidden parts), a
hundredth where a whole class word or a cookie phrase announces something
else. The ratios are smoothed with a Gaussian, which reaches less far into
other elements and never lifts a line above its own weight, and a threshold
clusters them in two: the dense lines are the content.

Short lines of the content are dense by their neighbours or are told by their
place: the region is the innermost element that holds nearly all of the dense
text, or an ``article`` (``main``, if there is none) that holds most of it.
Inside an article all lines of full weight are taken, and in its sibling
articles those that are not mostly links; elsewhere those that share an element
with a dense line, stand between such, or stand in an article of their own.

A sign that opens no tag within a bounded stretch is text, so the time is
proportional to the page whatever it holds.

Defined results: null or empty html, and pages without text, give an
empty text; a page cut off in a tag or reference is read up to there; equal
pages give equal texts; an empty table gives no rows; further columns are not
looked at.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = 1 << 16
SIGMA = 1.5
#: How far the Gaussian reaches into another element, and the weight of lines whose class or words announce something else.
ACROSS = 0.2
SOFT = 0.01
RESULT = "page_id long, url string, text string, n_chars long"

#: Elements that never hold the article's own words.
SKIPPED = frozenset("script style noscript template nav aside footer form button select option textarea iframe svg canvas object dialog menu audio video map head title".split())
#: Elements whose start and end bound a line.
BLOCKS = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video".split())
#: Elements that hold others and are closed by their own end tag.
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav noscript ol section select table template textarea ul button iframe svg canvas object audio video map head title script style".split())
#: Words of a class or id that announce something other than the article.
MARKS = frozenset("ad ads advert advertisement advertising adsbygoogle adbox adslot sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars side rail widget widgets related recommended recommendations share sharing social comment comments disqus reply replies respond responses discussion menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead footer foot copyright legal toolbar pagination pager login search searchbox tags taglist skip disclaimer teaser teasers trending popular".split())
#: Words that say nothing beside one of MARKS.
FILLERS = frozenset("area articles bar block body bottom box button buttons btn card cards center column container content element footer form global group header icons id inline inner item items js label large left link links list local main media message module more name news outer page panel post posts primary right row secondary section site slot small stories story text top unit up widget wrap wrapper".split())
#: Beginnings of a part that mark a whole word whatever its other parts, parts that do, and parts that only tell a state.
STEMS = ("comment", "reply", "replies", "feedback", "disqus", "advert", "adsense", "adslot", "sponsor", "outbrain", "taboola")
ALONE = frozenset("ad ads".split())
STATES = frozenset("has no with without open opened closed enabled disabled enable disable show hide commentary".split())
#: Marks that a wrapper of the whole text may bear too.
WRAPS = frozenset("social share sharing widget widgets promo banner modal overlay popup rail side".split())
#: Parts of a class by which an article is one of a list of others.
CARDS = frozenset("card cards tile tiles item items".split())
#: The share of a page's text that an element with such a mark holds if it is a wrapper.
WRAPPED = 0.8
#: Roles of parts other than the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Elements without content.
VOID = frozenset("br hr img input meta link wbr source col embed".split())
#: What a notice about cookies says.
NOTICE = re.compile(r"\b(?:we|this (?:web)?(?:site|page)) uses? cookies\b|\b(?:accept|allow|reject) (?:all )?cookies\b|\bcookie (?:policy|settings|preferences)\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@functools.lru_cache(1 << 14)
def announces(value: str, inside: bool, itself: bool = False) -> bool:
    """Whether a whole word of a class or id names something other than the article; a header does outside an article.

    All its parts are known, or one of them begins as comments, replies and advertisements do; of an article or main element itself the former only.
    """
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", _CAMEL.sub("-", token).lower()) if p]
        marks = [p in MARKS or (p == "header" and not inside) for p in parts]
        if any(marks) and all(m or p in FILLERS or len(p) == 1 for m, p in zip(marks, parts)):
            return True
        if not itself and not STATES.intersection(parts) and any(p in ALONE or p.startswith(STEMS) for p in parts):
            return True
    return False


def wraps(value: str) -> bool:
    """Whether all that a class or id announces may as well be said of a wrapper of the whole text."""
    parts = {p for p in re.split(r"[^a-z]+", _CAMEL.sub("-", value).lower()) if p}
    return parts & MARKS <= WRAPS and not any(p.startswith(STEMS) for p in parts)


class Line:
    __slots__ = ("box", "text", "tags", "linked", "weight")

    def __init__(self, box: int, text: str, tags: int, linked: int, weight: float):
        self.box, self.text, self.tags, self.linked, self.weight = box, text, tags, linked, weight

    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags) * self.weight


class Lines(HTMLParser):
    """Collects the lines of a page, and its elements, each with its kind and the one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = [""]
        self.parents: list[int] = [0]
        self.cards: set[int] = set()
        self.soft: dict[int, bool] = {}  # of elements that announce something else, whether they may be wrappers
        self.stack: list[tuple[str, int, float]] = [("", 0, 1.0)]  # element, number, weight
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, box, weight = self.stack[-1]
            self.lines.append(Line(box, text, self.tags, self.linked, weight * SOFT if NOTICE.search(text) else weight))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _inside(self) -> bool:
        return self.open["article"] + self.open["main"] > 0

    def _weight(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in SKIPPED or (tag == "header" and not self._inside()):
            return 0.0
        if tag in ("body", "html"):
            return 1.0
        out = 1.0
        for name, value in attrs:
            v = value or ""
            if name in ("class", "id"):
                if announces(v, self._inside() or tag in ("article", "main"), tag in ("article", "main")):
                    out = SOFT
            elif name == "role" and v.lower() in ROLES or name == "hidden" or name == "aria-hidden" and v.lower() == "true":
                return 0.0
            elif name == "style" and _HIDDEN.search(v.lower()):
                return 0.0
        return out

    def _push(self, kind: str, weight: float) -> None:
        self.kinds.append(kind)
        self.parents.append(self.stack[-1][1])
        self.stack.append((kind, len(self.kinds) - 1, min(weight, self.stack[-1][2])))
        self.open[kind] += 1

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a":
            self.links += 1
        weight = self._weight(tag, attrs) if attrs or tag in SKIPPED or tag == "header" else 1.0
        if tag in ("body", "article", "main"):  # an unclosed head or title ends here
            while self.stack[-1][0] in ("head", "title"):
                self._pop()
        if weight == SOFT:
            self.soft[len(self.kinds)] = all(wraps(v or "") for name, v in attrs if name in ("class", "id"))
        if tag == "article" and any(name == "class" and CARDS.intersection(re.split(r"[^a-z]+", (v or "").lower())) for name, v in attrs):
            self.cards.add(len(self.kinds))
        if tag in CONTAINERS:
            self._push("main" if tag != "article" and any(k == "role" and v == "main" for k, v in attrs) else tag, weight)
        elif weight < 1 and tag not in VOID:
            self.cut()
            self._push(tag, weight)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if not self.open[tag] and not (tag in ("div", "section") and self.open["main"]):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            kind = self.stack[k][0]
            if kind == tag or (kind == "main" and tag in ("main", "div", "section")):
                self.cut()
                while len(self.stack) > k:
                    self._pop()
                break
            if tag not in CONTAINERS and kind in CONTAINERS:
                break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


_OPEN = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_TAG = re.compile(r"<[/a-zA-Z!?]")
#: A tag whose attributes are all well formed; it may be long, as one that holds a picture is.
_WHOLE = re.compile(r"""<[a-zA-Z][^\s<>/"'=]*(?:\s+[^\s=<>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>""")
#: Characters within which any other tag must end; the parser looks for an end up to that of the page, again for each.
TAG_MOST = 4096


def closed(html: str) -> str:
    """The page with the signs that open no tag written as references, in time proportional to its length."""
    out, done, end, skip, last = [], 0, -1, 0, html.rfind("-->")
    for m in _TAG.finditer(html):
        at = m.start()
        if at < skip:
            continue
        if html.startswith("<!--", at):
            if at < last:
                skip = html.find("-->", at) + 3
            else:  # a comment that never ends is none
                out += [html[done:at], "&lt;"]
                done = at + 1
            continue
        if end < at:
            end = html.find(">", at)
            end = len(html) + TAG_MOST + 1 if end < 0 else end
        if end - at <= TAG_MOST:
            continue
        if end < len(html) and (whole := _WHOLE.match(html, at)):
            skip = whole.end()
            continue
        out += [html[done:at], "&lt;"]
        done = at + 1
    return "".join([*out, html[done:]]) if out else html


def parse(html: str) -> Lines:
    """The lines of a page; a tag cut off by the end of the page is left out."""
    parser = Lines()
    html = closed(_OPEN.sub("", html))
    for k in range(0, len(html), FEED):
        parser.feed(html[k : k + FEED])
    parser.close()
    parser.cut()
    return parser


def smoothed(lines: list[Line], sigma: float = SIGMA) -> list[float]:
    """Text-to-tag ratios under a Gaussian, each times the line's own weight; lines of weight nought take no part."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    ratio = [x.ratio() for x in lines]
    out = []
    for i, x in enumerate(lines):
        total = weight = 0.0
        if x.weight:
            for j in range(max(0, i - reach), min(len(lines), i + reach + 1)):
                y = lines[j]
                if y.weight:
                    w = kernel[abs(i - j)] * (1.0 if y.box == x.box else ACROSS)
                    total += w * (ratio[j] if i != j else ratio[j] / x.weight)
                    weight += w
        out.append(total / weight * x.weight if weight else 0.0)
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of the values: two means, moved until they rest."""
    low, high = min(values), max(values)
    while True:
        border = (low + high) / 2
        a, b = [v for v in values if v <= border], [v for v in values if v > border]
        if not b:
            return low - 1
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (low, high):
            return border
        low, high = new


def region(lines: list[Line], kinds: list[str], parents: list[int], cards: set[int] = frozenset()) -> list[Line]:
    """The lines of the content: the dense ones, and those that belong with them by their place."""
    if not lines:
        return []
    density = smoothed(lines)
    border = threshold(density)
    dense = [d > border for d in density]
    if not any(dense) or not any(x.weight for x in lines):
        return []
    mass = [0.0] * len(kinds)
    for x, d in zip(lines, dense):
        mass[x.box] += len(x.text) * (1.0 if d else 0.05 * (x.weight == 1))
    for n in range(len(kinds) - 1, 0, -1):
        mass[parents[n]] += mass[n]
    articles = [n for n, k in enumerate(kinds) if k == "article" and mass[n]] or [n for n, k in enumerate(kinds) if k == "main" and mass[n]]
    best = max(articles, key=lambda n: (mass[n], -n), default=0)
    if not articles or mass[best] <= 0.5 * mass[0]:
        best = max(n for n, m in enumerate(mass) if m >= 0.8 * mass[0])
    inside, beside, within = ([False] * len(kinds) for _ in range(3))
    for n in range(len(kinds)):
        inside[n] = n == best or (n > 0 and inside[parents[n]])
        beside[n] = n > 0 and ((kinds[n] == kinds[best] == "article" and parents[n] == parents[best] and n not in cards) or beside[parents[n]])
        within[n] = (kinds[n] == "article" and n not in cards) or (n > 0 and within[parents[n]])
    own = lambda x: x.weight == 1 and 2 * x.linked < len(x.text)
    if kinds[best] in ("article", "main"):
        return [x for x, d in zip(lines, dense) if d or (inside[x.box] and x.weight == 1) or (beside[x.box] and own(x))]
    boxes = {x.box for x, d in zip(lines, dense) if d}
    sure = [k for k, (x, d) in enumerate(zip(lines, dense)) if d or (x.box in boxes and x.weight == 1 and 2 * x.linked < len(x.text))]
    return [x for k, (x, d) in enumerate(zip(lines, dense)) if d or (own(x) and (within[x.box] or (inside[x.box] and (x.box in boxes or sure[0] < k < sure[-1]))))]


def unwrap(page: Lines) -> None:
    """Takes the mark from elements that hold nearly all of a page's text: those of one mark alone wrap it."""
    mass = [0] * len(page.kinds)
    for x in page.lines:
        mass[x.box] += max(0, len(x.text) - x.linked) * (x.weight > 0)
    for n in range(len(mass) - 1, 0, -1):
        mass[page.parents[n]] += mass[n]
    free = {n for n, may in page.soft.items() if may and n < len(mass) and mass[n] >= WRAPPED * mass[0]}
    if not free:
        return
    marked = [False] * len(mass)  # whether an element or one around it still announces something else
    for n in range(1, len(mass)):
        marked[n] = marked[page.parents[n]] or (n in page.soft and n not in free)
    for x in page.lines:
        if 0 < x.weight < 1 and not marked[x.box] and not NOTICE.search(x.text):
            x.weight = 1.0


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = parse(html)
    unwrap(page)
    return " ".join(x.text for x in region(page.lines, page.kinds, page.parents, page.cards))


def extract(pages: DataFrame) -> DataFrame:
    """Per page its main text and number of characters. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, RESULT)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The main text of pages of the tables' own making, whose text stands in one article; SQL has no parser for others.
OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[/!?a-zA-Z][^<>]*$', '') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(?:p|h1|br)>', ' ', 'g'), '<[^>]+>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_replace(x, '&amp$', '&amp;'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
