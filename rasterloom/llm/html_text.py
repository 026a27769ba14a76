"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block, and each line has a weight, its length under what the structure says of it.
Empty lines stand where the page changes parts: `window` of them at the edge of an element that names furniture or
marks an article, one less at the edge of any container of blocks (but not after a heading). Over all lines goes a sliding
window that sums weights. A surge point is a line whose window passes the threshold, a dive point where the window has fallen
to nothing, and the lines between stay. A block set apart and short never starts a surge, whatever its name; what follows
the article's last line ends with its dive.

Structure enters by weights alone. Lines in nav, footer, aside, forms, dialogs, hidden elements, readers' comments, and
headers outside an article weigh nothing. Those in elements all of whose words in one class name or id are of furniture weigh a
tenth, so such a block stays if its density says so (the text of paragraphs about social or related things inside an article isn't furniture at all). Lines
of a marked article (article, main, articleBody, or a block so named) weigh a threshold more, so its short paragraphs
surge by themselves, and the others a tenth; but only if the marked text is at least a tenth of the page's, else the mark is
ignored. Without a mark, lines that are mostly links weigh nothing; if then no window passes the threshold, half of the largest sum is
the threshold. A marked article inside furniture (but for readers' comments, nav and aside) is the text where it is longer than what the
page gives without it.

Character references are decoded after stripping; white space inside a block becomes one space; blocks are joined by a line
feed, in page order. A line break tag is white space. Null, empty and text-free pages give the empty string. The scanner is
linear in the page, unclosed tags, quotes, comments and deep nesting included. Repeated rows come out each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import load, ready

WINDOW = 3
#: Sum of a window that is a surge.
SURGE = 120
#: Weight of a character in an element named as furniture.
NAMED = 0.1
#: Share of the page's text from which a mark counts.
MARK = 0.1

_BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe title svg annotation annotation-xml object canvas audio video select".split())
_AWAY = frozenset("nav footer aside form button dialog menu head".split())
#: Elements that the start of a like one closes.
_OWN_END = frozenset("p li dt dd td th tr option".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer sidebar sidebars menu menus nav navbar navigation navigate breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond replies share sharing shares social related recommended recommendation recommendations newsletter subscribe subscription signup signin login popup popups modal overlay widget widgets pagination pager paging copyright search searchbox skip tagcloud trending mostread".split()
)
#: Words that may stand beside those in the name of a class; with any other (has-sidebar, related-work) it isn't one of furniture.
_BESIDE = frozenset("site page main left right top bottom primary secondary global list box bar block container wrapper wrap section area link links button buttons icon icons item items slot unit inner outer form sticky fixed mobile desktop post article entry user reader".split())
#: Of those, what an element that marks an article is not.
_NOT_ARTICLE = frozenset("comment comments related promo ad ads advert advertisement sponsored recommended teaser".split())
#: Furniture whose articles are readers'.
_REPLIES = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that also tell what a paragraph of an article is about.
_TOPICS = frozenset("social related notice notices alert alerts search skip trending recommended recommendation recommendations disclaimer copyright banner overlay modal menu menus promotion replies share sharing shares subscription".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th span em strong b i".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_MARKED = re.compile(r"(?i)(?:^|[\s_-])(?:article(?:[_-]?(?:body|content|text))?|post[_-]?(?:body|content|text)|entry[_-]?content|story[_-]?(?:body|content|text)|main[_-]?(?:content|text)|content[_-]?(?:body|main|text)?|post|story|entry)(?:$|\s)")
_ATTRIBUTE = re.compile(r"""(?i)(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=$|[\s"'/>])""")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*")


_QUOTED = re.compile(r"=\s*([\"'])")


@lru_cache(64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}(?=[\s/>])")


class _Scanner:
    """Tags and texts of a page: calls start(name, attributes), end(name) and text(s)."""

    def __init__(self, html: str) -> None:
        self.html, self.none = html, {'"': False, "'": False}
        self.open: set[str] = set()  # raw elements without an end from here on

    def _tag_end(self, at: int) -> int:
        """Place of the > that closes a tag whose attributes begin at `at`, -1 if there is none."""
        html = self.html
        stop = html.find(">", at)
        while stop >= 0:
            # only a quote that opens a value counts
            m = _QUOTED.search(html, at, stop)
            if not m:
                return stop
            q = m[1]
            close = -1 if self.none[q] else html.find(q, m.end())
            if close < 0:
                self.none[q] = True
                return stop
            at = close + 1
            if at > stop:
                stop = html.find(">", at)
        return -1

    def run(self, start, end, text) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                text(html[at:])
                return
            if lt > at:
                text(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                if html.startswith("<!--", lt):
                    z = html.find("-->", lt + 4)
                    at = n if z < 0 else z + 3
                else:
                    z = html.find(">", lt)
                    at = n if z < 0 else z + 1
                continue
            m = _NAME.match(html, lt + 1 + (nxt == "/"))
            if not m:
                if nxt == "/":  # </ and no name: markup without text
                    z = html.find(">", lt)
                    at = n if z < 0 else z + 1
                else:
                    text("<")
                    at = lt + 1
                continue
            name = m[0].lower()
            z = self._tag_end(m.end())
            if z < 0:
                return
            at = z + 1
            if nxt == "/":
                end(name)
                continue
            attributes = html[m.end() : z]
            if name in _RAW and not attributes.endswith("/"):
                close = None if name in self.open else _raw_end(name).search(html, at)
                if close:
                    z = html.find(">", close.end())
                    at = n if z < 0 else z + 1
                elif name in ("script", "style", "title"):
                    return
                else:
                    self.open.add(name)
                text(" ")
                continue
            start(name, attributes)


def _named(value: str, words: frozenset) -> set[str]:
    """Those of words that a class name in value consists of, but for words beside."""
    out = set()
    for name in value.split():
        parts = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
        if parts <= words | _BESIDE:
            out |= parts & words
    return out


def _away(name: str, attributes: str, inside: bool) -> int:
    """Whether an element isn't part of the article: 1 unless it holds the page's, 2 in any case. inside: it stands in a marked article."""
    if name in _AWAY or name == "header" and not inside:
        return 1 if name == "form" else 2
    if not attributes:
        return 0
    out, rank = 0, _rank(name, attributes)
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return 2
        if key == "role" and value.lower() in _ROLES:
            out = 1
        if key in ("class", "id") and name not in ("body", "html", "main"):
            words = _named(value, _NOT_ARTICLE if rank else _WORDS if inside else _WORDS | {"header"})
            if inside and name in _TEXT:
                words -= _TOPICS
            if words & _REPLIES or rank and words:
                return 2
            out = out or int(bool(words))
    return out


def _rank(name: str, attributes: str) -> int:
    """How a container marks the article: 3 article, 2 main, 1 by name, 0 not."""
    if name == "article":
        return 3
    if name == "main":
        return 2
    if name in ("div", "section", "td") and attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "itemprop" and value.lower() == "articlebody":
                return 3
            if key == "role" and value.lower() in ("main", "article"):
                return 2
            if key in ("class", "id") and _MARKED.search(value):
                return 1
    return 0


@dataclass(slots=True)
class Line:
    """A block: text, characters of it in links, weight of a character, rank of the article around it, whether that stands in furniture, and empty lines before it."""

    text: str
    linked: int
    prior: float
    rank: int
    lifted: bool
    gap: int


@dataclass(slots=True)
class _Open:
    """An open element, and what held outside of it: prior, away (0 none, 1 or 2 as _away()) and the name of the element that it comes from, rank, links, lifted. first: lines before it; holds: whether it holds blocks; edge: whether it stands apart."""

    name: str
    outside: tuple[float, int, str, int, int, bool]
    first: int
    holds: bool
    edge: bool


_TAGS = re.compile(r"(?i)<(/?)(nav|footer|aside|form|button|dialog|menu|header|div|section|ul|ol|li|td|tr|table|span)(?=[\s/>])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of a block ends.
_INLINE = frozenset("p span h1 h2 h3 h4 h5 h6".split())


def lines(html: str, window: int = WINDOW) -> list[Line]:
    """Blocks in page order."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    prior, away, root, rank, links, lifted = 1.0, 0, "", 0, 0, False
    linked = gap = 0
    glued = False
    # names of which the page closes fewer than it opens
    balance: Counter[str] | None = None

    def unclosed(name: str) -> bool:
        nonlocal balance
        if balance is None:
            balance = Counter()
            for m in _TAGS.finditer(html):
                balance[m[2].lower()] += -1 if m[1] else 1
        return balance[name] > 0

    def close_block() -> None:
        nonlocal linked, gap, glued
        if parts:
            s = " ".join(unescape("".join(parts)).split())
            if s:
                out.append(Line(s, min(linked, len(s)), prior, rank, lifted, 0 if glued and gap < window else gap))
                gap, glued = 0, bool(stack) and stack[-1].name in _HEADINGS
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal prior, away, root, rank, links, lifted, gap
        x = stack.pop()
        opened[x.name] -= 1
        if x.edge or x.holds:
            close_block()
            gap = max(gap, window if x.edge else window - 1)
        prior, away, root, rank, links, lifted = x.outside

    def start(name: str, attributes: str) -> None:
        nonlocal prior, away, root, rank, links, lifted, gap
        if name in _BLOCK:
            close_block()
            while stack and stack[-1].name in _INLINE:
                pop()
            if stack and stack[-1].name == name and name in _OWN_END:
                pop()
            if name == "body":
                while opened["head"]:
                    pop()
            if stack and not stack[-1].holds:
                stack[-1].holds = True
                k = stack[-1].first
                if k < len(out):
                    out[k].gap = max(out[k].gap, window - 1)
                else:
                    gap = max(gap, window - 1)
        elif name == "br":
            parts.append(" ")
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            return
        if away and name in ("article", "main"):  # furniture that is never closed ends here
            while away and unclosed(root):
                while away:
                    pop()
        found, own = _away(name, attributes, rank > 0), _rank(name, attributes)
        if not (name in _BLOCK or name == "a" or found or opened[name]):
            return
        state = prior, away, root, rank, links, lifted
        edge = bool(found or own)
        if edge:
            close_block()
            gap = max(gap, window)
        stack.append(_Open(name, state, len(out), False, edge))
        opened[name] += 1
        links += name == "a"
        if found:
            prior = min(prior, NAMED if found == 1 and name != "form" and not _by_role(attributes) else 0.0)
            away, root = max(away, found), root if away else name
        elif away == 1 and own >= 2:
            prior, away, root, rank, lifted = 1.0, 0, "", own, True
        else:
            rank = max(rank, own)

    def end(name: str) -> None:
        if name in _BLOCK:
            close_block()
        if opened[name]:
            while True:
                last = stack[-1].name
                pop()
                if last == name:
                    break
        elif name == "br":
            parts.append(" ")

    def text(s: str) -> None:
        nonlocal linked
        parts.append(s)
        if links:
            linked += len(s.strip())

    _Scanner(html).run(start, end, text)
    close_block()
    return out


def _by_role(attributes: str) -> bool:
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in _ROLES for m in _ATTRIBUTE.finditer(attributes))


def surges(lengths: list[float], threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines [surge, dive): from the first line of a window whose sum is over the threshold (and isn't empty) to where the lines of a window have fallen to nothing."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if lengths[i] and sums[i] > threshold:
            z = i
            while z < n and sums[z]:
                z += 1
            last = max(k for k in range(i, z) if lengths[k]) + 1
            out.append((i, last))
            i = z
        else:
            i += 1
    return out


def _chosen(found: list[Line], lifted: bool, window: int = WINDOW) -> list[str]:
    """The lines between surges and dives; lifted: whether articles in furniture count as such."""
    priors = [x.prior if lifted or not x.lifted else 0.0 for x in found]
    if lifted:
        priors = [p if x.lifted else 0.0 for x, p in zip(found, priors, strict=True)]
    mass = lambda least: sum(len(x.text) for x, p in zip(found, priors, strict=True) if p == 1 and x.rank >= least and (x.rank or 2 * x.linked <= len(x.text)))
    total = mass(0)
    mark = next((r for r in (3, 2, 1) if (m := mass(r)) and m >= MARK * total), 0)
    weights: list[float] = []
    at: list[int] = []
    for k, (x, p) in enumerate(zip(found, priors, strict=True)):
        weights += [0.0] * x.gap
        at += [-1] * x.gap
        if mark:
            w = NAMED * p * len(x.text) if x.rank < mark else p * len(x.text) + (SURGE if p == 1 else 0)
        else:
            w = 0.0 if 2 * x.linked > len(x.text) else p * len(x.text)
        weights.append(w)
        at.append(k)
    runs = surges(weights, SURGE, window)
    if not runs and not mark:  # a page of a few short lines
        weights = [w if k >= 0 and priors[k] == 1 else 0.0 for w, k in zip(weights, at, strict=True)]
        runs = surges(weights, max((sum(weights[i : i + window]) for i in range(len(weights))), default=0.0) / 2, window)
    return [found[at[k]].text for a, z in runs for k in range(a, z) if weights[k]]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = lines(html)
    out = _chosen(found, False)
    if any(x.lifted for x in found):
        out = max(out, _chosen(found, True), key=lambda x: sum(map(len, x)))
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages without html_col, and text and n_chars (code points); columns of those names are replaced."""
    ready(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kept = pages.select(*keep, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, ", ".join([*[schema] * bool(schema), "text string, n_chars long"]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
