"""Main text of web pages by two passes over blocks.

Elements whose tag or name (words of class, id or role) tells of navigation,
adverts, comments and the like are suspects.  What a suspect holds decides
whether it is boilerplate: a wrapper around the article or most of the page is
not, nor is an element with prose whose name has other words, too
(``market-share``).  Pass one then decides each block on its own: blocks in
boilerplate are out, blocks dense in links are boilerplate, long blocks dense
in stop words are content, short ones stay ambiguous, as do lists of links in
an article.  In a language without a list of stop words, sentences count
instead.  Pass two lets ambiguous blocks inherit from the nearest decided
neighbours of the same region.  A page that marks its article (``article`` or
``main``, in no boilerplate) says itself where content lies, unless most of
its prose lies elsewhere (an ``article`` with little of it is a teaser then):
long blocks there need no stop words, and a region without any decided block
counts as content there, as boilerplate elsewhere.  A heading right before an
article that has none is its title.

A tag reaches to the first ``>`` outside quoted values, however long these
are.  If there is none before the next ``<`` outside them, a quote was lost,
and the first ``>`` ends it.  Only the attributes ``hidden``, ``aria-hidden``
(if true) and ``style`` (``display: none``, ``visibility: hidden``) hide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, table

#: Frequent function words (fixed list: English, French, German, Spanish).
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his if in into is it its more not of on one only or other our out she so some than that the their them then there they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am an auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so und von vor war wie wird zu zum zur über "
    "al como con del el ella en era es esta este ha las lo los me mi muy más no o para pero por que se sin sobre su sus también te un una y ya yo".split()
)
#: Thresholds of pass one.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINK_DENSITY = 0.2
#: Share of the page's text from which a suspect is the page's own wrapper; share of stop words in the long blocks below which the language has no list.
WRAPPER, LISTED = 0.6, 0.1

#: Elements whose content is never text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "head", "select", "button", "canvas", "audio", "video")
#: Those of them whose content is no markup, so that without an end tag they reach to the end of the page.
RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe"))
#: Those that a slash ends, and those that hold others of their name.
SELF_CLOSED, NESTED = frozenset(("svg", "math")), frozenset(("svg", "math", "object", "template"))
#: Elements that hold no article text.
BOILER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))
REGION_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id or role that name boilerplate: readers' comments, what never wraps an article, and what may.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr banner popup newsletter subscribe copyright disclaimer notice notices".split())
FRAME_NAMES = frozenset("breadcrumb breadcrumbs footer header masthead menu modal nav navbar navigation pagination pager recommended recommendations related share sharing sidebar social toolbar widget contentinfo complementary search login signup".split())
#: Words beside them that tell of no subject: a name of such words alone is boilerplate's for sure.
FRAME_WORDS = ADVERT_NAMES | FRAME_NAMES | frozenset("area article articles aside bar block blocks bottom box btn button buttons card cards center col column container content entry field form fixed global group head inner item items label layout left link links list main module outer page panel post posts primary right row section secondary site slot small strip text title top unit view wrap wrapper".split())
#: Words of headings over links to elsewhere.
ELSEWHERE = FRAME_NAMES | ADVERT_NAMES | COMMENT_NAMES | frozenset("also latest like more next popular previous read tags topics trending".split())
#: Words before one of these that make it tell of something else, and those that make a header one of the article.
OTHERWISE = frozenset("with has no non not without is after before under".split())
OWN_HEADER = frozenset("entry post article page story content section".split())
_START = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?]|</?[a-zA-Z]", re.S)
#: The rest of a tag with short quoted values.
_REST = re.compile(r"[^<>\"']*+(?:(?:\"[^\"]{0,500}+\"|'[^']{0,500}+')[^<>\"']*+){0,50}+>")
_UNQUOTED, _BARE = re.compile(r"[^<>\"']*+"), re.compile(r"[^<>]*+")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SAME_CLOSES = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORD = re.compile(r"\w+")


class Markup:
    """Comments, declarations and tags of a page, found in time that grows with its length."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        #: Places outside quotes from which a tag finds no end.
        self.endless: set[int] = set()

    def next(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the first piece of markup from ``at`` on."""
        while m := _START.search(self.page, at):
            if m[0].startswith(("<!--", "<![")):
                return m.span()
            if m.end() > self.last:
                at = m.end()
                continue
            end = self.page.find(">", m.end()) + 1 if m[0] in ("<!", "<?") else self._tag_end(m.end())
            if end:
                return m.start(), end
            at = m.end()
        return None

    def _tag_end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose name begins before ``at``; 0 if it has none."""
        if m := _REST.match(self.page, at):
            return m.end()
        page, place, passed = self.page, at, []
        while place not in self.endless:
            passed.append(place)
            stop = _UNQUOTED.match(page, place).end()
            mark = page[stop : stop + 1]
            if mark == ">":
                return stop + 1
            close = page.find(mark, stop + 1) if mark in ("'", '"') else -1
            if close < 0:
                break
            place = close + 1
        self.endless.update(passed)
        stop = _BARE.match(page, at).end()
        return stop + 1 if page[stop : stop + 1] == ">" else 0


def attributes(tag: str) -> dict[str, str]:
    """Names (in lower case) and values of a tag's attributes, the first of equal names."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag[_NAME.match(tag).end() :]):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
    return out


def unshown(has: dict[str, str]) -> bool:
    return "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSHOWN.search(has.get("style", "")))


def skipped(markup: Markup, name: str, start: int, opened: Counter[str], ends: dict[tuple[str, int], int | None]) -> int | None:
    """Where the element ``name`` ends whose opening tag ends at ``start``; None if its parent block or the page ends first.

    ``opened`` counts the open blocks.  What is found for elements of the name
    on the way is put into ``ends``, so that each part of a page is looked
    through once for a name.
    """
    page = markup.page
    inner = [(name, start)]  # open blocks (place -1) and elements of the name
    blocks: Counter[str] = Counter()
    marks, at = 1, start

    def leave(end: int | None = None) -> tuple[str, int]:
        nonlocal marks
        tag, place = inner.pop()
        if place < 0:
            blocks[tag] -= 1
        else:
            marks -= 1
            ends[name, place] = end
        return tag, place

    while marks and (found := markup.next(at)):
        at, piece = found[1], page[found[0] : found[1]]
        named = _NAME.match(piece)
        if not named:
            continue
        tag, closing = named[1].lower(), piece[1] == "/"
        if tag == name:
            if closing:
                while leave(at)[1] < 0:
                    pass
            elif not (name in SELF_CLOSED and piece.endswith("/>")):
                if name not in NESTED:  # can't hold another one: the first has no end
                    while leave()[1] < 0:
                        pass
                inner.append((name, at))
                marks += 1
        elif tag in RAW_TEXT and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag in BLOCK_TAGS and closing:
            if blocks[tag]:
                while leave() != (tag, -1):
                    pass
            elif opened[tag]:
                break
        elif tag in BLOCK_TAGS and tag not in _VOID and not piece.endswith("/>"):
            if tag in _SAME_CLOSES and inner[-1] == (tag, -1):
                leave()
            inner.append((tag, -1))
            blocks[tag] += 1
    while inner:
        leave()
    return ends[name, start]


@lru_cache(4096)
def named(value: str, inside: bool) -> tuple[str, bool]:
    """(comments, advert, frame or nothing; whether it is sure): what the words of a class, id or role name.

    ``inside`` an article headers are its own.  A name that has words of other
    subjects, too, is unsure (``market-share``, ``promo-history``).
    """
    found, sure = "", False
    for token in value.split():
        parts = [x for x in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
        if not parts or OTHERWISE.intersection(parts[:-1]):
            continue
        for word in {parts[0], parts[-1]}:
            if word in COMMENT_NAMES:
                return "comments", True
            if word in ADVERT_NAMES:
                found = "advert"
            elif word in FRAME_NAMES and not (word == "header" and (inside or OWN_HEADER.intersection(parts))):
                found = found or "frame"
            else:
                continue
            sure = sure or FRAME_WORDS.issuperset(parts)
    return found, sure


class Suspects:
    """Elements that may be boilerplate, numbered as they open: what tells of it, the suspect around each, and what each holds."""

    def __init__(self):
        self.kinds, self.sure, self.parents, self.articles, self.chars, self.prose, self.holds = [], [], [], [], [], [], []

    def add(self, kind: str, sure: bool, parent: int, article: bool) -> int:
        for field, x in ((self.kinds, kind), (self.sure, sure), (self.parents, parent), (self.articles, article), (self.chars, 0), (self.prose, 0), (self.holds, False)):
            field.append(x)
        return len(self.kinds) - 1

    def hold(self, at: int) -> None:
        """An article opens in the suspect: those around it hold one, up to the first that is no wrapper."""
        while at >= 0 and not self.holds[at] and self.kinds[at] in ("frame", "form", "advert"):
            self.holds[at] = True
            at = self.parents[at]

    def boilerplate(self, blocks: list) -> list[bool]:
        """Which of them are, given the blocks (whose third field names the innermost suspect).

        Hidden elements, tags for navigation and the like, and comments always;
        an article named like boilerplate if there is another one; an article in
        another that has text of its own; other names and forms unless they hold
        an article or most of the text (adverts: an article), or, if the name is
        unsure, mostly prose.
        """
        n = len(self.kinds)
        aside = [k in ("hidden", "comments") for k in self.kinds]  # of these or in one
        for i in range(n):
            aside[i] = aside[i] or self.parents[i] >= 0 and aside[self.parents[i]]
        total, clean, own = 0, set(), Counter()
        for text, linked, at, region, _ in blocks:
            plain = max(0, len(text) - linked)
            if at >= 0:
                self.chars[at] += plain
                self.prose[at] += plain if plain >= LENGTH_LOW and linked <= LINK_DENSITY * len(text) and _SENTENCE.search(text) else -linked
            elif region:
                clean.add(region)
            if at < 0 or not aside[at]:
                total += plain
        for i in range(n - 1, -1, -1):
            if self.parents[i] >= 0:
                self.chars[self.parents[i]] += self.chars[i]
                self.prose[self.parents[i]] += self.prose[i]
        for text, linked, at, region, _ in blocks:
            if region and (at < 0 or self.kinds[at] != "nested"):
                own[region] += max(0, len(text) - linked)
        regions = {}
        for _, _, at, region, _ in blocks:
            while at >= 0 and at not in regions:
                regions[at] = region
                at = self.parents[at]
        out = []
        for i, kind in enumerate(self.kinds):
            wraps = self.holds[i] or not self.sure[i] and 2 * self.prose[i] > self.chars[i] or kind != "advert" and self.chars[i] > WRAPPER * total
            if kind == "nested":
                bad = own[regions.get(i, 0)] >= LENGTH_LOW
            elif self.articles[i] and kind in ("frame", "advert"):
                bad = bool(clean)
            else:
                bad = kind in ("hidden", "tag", "comments") or not wraps
            out.append(bad or self.parents[i] >= 0 and out[self.parents[i]])
        return out


def parse_blocks(page: str) -> list[tuple[str, int, bool, int, str]]:
    """(text, characters inside links, in boilerplate, region, tag) of each block with text.

    Region 0 is the page outside ``article`` and ``main``; each outermost one of
    these counts as the next region.  RAW elements are left out; an opening tag
    without its end tag before the parent block closes is passed over alone,
    unless it begins raw text.
    """
    blocks: list = []
    parts: list[str] = []
    linked = links = breaks = regions = 0
    stack: list[tuple[str, int, bool]] = []  # tag, suspect (-1: none), region
    opened: Counter[str] = Counter()
    suspects = Suspects()
    suspect, inside = -1, 0
    tag = ""
    ends: dict[tuple[str, int], int | None] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, linked, suspect, regions if inside else 0, tag))
            parts.clear()
        linked = 0

    def leave() -> str:
        nonlocal suspect, inside
        name, own, region = stack.pop()
        opened[name] -= 1
        if own >= 0:
            suspect = suspects.parents[own]
        inside -= region
        return name

    at, n = 0, len(page)
    markup = Markup(page)
    while at < n:
        m = markup.next(at)
        chunk = page[at : m[0] if m else n]
        if chunk:
            parts.append(chunk)
            if not chunk.isspace():
                breaks = 0
                linked += links and len(chunk.strip())
        if not m:
            break
        at, piece = m[1], page[m[0] : m[1]]
        found = _NAME.match(piece)
        if not found:
            continue
        name, closing = found[1].lower(), piece[1] == "/"
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in _RAW_END and not closing:
            if name in BLOCK_TAGS or name == "head":
                flush()
            if name == "head" or name in RAW_TEXT:
                end = _RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                elif name == "head":
                    body = re.search(r"<body\b", page[at:], re.I)
                    at += body.start() if body else 0
                else:
                    at = n
            elif not (name in SELF_CLOSED and piece.endswith("/>")):
                end_at = ends[name, at] if (name, at) in ends else skipped(markup, name, at, opened, ends)
                at = at if end_at is None else end_at
            continue
        if name not in BLOCK_TAGS:
            continue
        flush()
        links = breaks = 0
        if closing:
            while opened[name]:  # closes what is open inside, too
                last = leave()
                if last == name:
                    break
            tag = stack[-1][0] if stack else ""
            continue
        tag = name
        if name in _VOID or piece.endswith("/>"):
            continue
        if name in _SAME_CLOSES and stack and stack[-1][0] == name:
            leave()
        region = name in REGION_TAGS
        has = attributes(piece) if len(piece) > len(name) + 2 else {}
        names = " ".join(has[x] for x in ("class", "id", "role") if x in has)
        sure = True
        if unshown(has):
            kind = "hidden"
        elif name == "form":
            kind = "form"
        elif name in BOILER_TAGS and not (name == "header" and inside):
            kind = "tag"
        else:
            kind, sure = named(names, bool(inside)) if names and name not in ("body", "html") else ("", True)
            if name == "article" and opened["article"] and kind != "comments":
                kind, sure = "nested", True
        if region and not inside:
            regions += 1
            suspects.hold(suspect)
        own = suspects.add(kind, sure, suspect, region) if kind else -1
        suspect = own if kind else suspect
        stack.append((name, own, region))
        opened[name] += 1
        inside += region
    flush()
    bad = suspects.boilerplate(blocks)
    return [(text, size, at >= 0 and bad[at], region, tag) for text, size, at, region, tag in blocks]


_WIDE = re.compile("[\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff]")
_SENTENCE = re.compile("[.!?\u0964\u3002\uff01\uff1f\u061f\u06d4]")


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def has_list(blocks: list) -> bool:
    """Whether the page's long blocks have stop words enough to be in a language with a list (or there are none)."""
    long = [b[0] for b in blocks if not b[2] and len(b[0]) >= LENGTH_LOW and b[1] / len(b[0]) <= LINK_DENSITY]
    return not long or stop_share(" ".join(long)) >= LISTED


def first_pass(text: str, linked: int, boiler: bool, region: int, tag: str, listed: bool = True) -> str:
    """good, bad, near (long enough, few stop words), short, links (of an article), or out (in a boilerplate container).

    Wide characters count two and a half.  Unless the language is ``listed``, a long
    block is content if it has a sentence's end.
    """
    if boiler:
        return "out"
    size = len(text)
    if linked / size > LINK_DENSITY and (tag not in ("p", "pre", "blockquote") or not region or linked / size > 0.9):
        return "bad" if not region or tag in ("p", "pre", "blockquote") else "links" if linked > 0.7 * size else "short"
    if not text.isascii():
        size += 3 * len(_WIDE.findall(text)) // 2
    if region:
        return "good" if size >= LENGTH_LOW else "short"
    if size < LENGTH_LOW:
        return "bad" if linked else "short"
    if not listed:
        return "near" if size <= LENGTH_HIGH or not _SENTENCE.search(text) else "good"
    density = stop_share(text)
    if density >= STOP_HIGH:
        return "good" if size > LENGTH_HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(kinds: list[str], regions: list[int]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbours in their region.

    Where both neighbours exist and differ, the nearer one counts; at equal
    distance a ``near`` block is content and a ``short`` one is not.  In an
    article a block is content unless both neighbours are boilerplate, and one of
    links if both are content; outside, a block without decided neighbours is
    not.  Blocks ruled out by their container are no neighbours.
    """
    n = len(kinds)
    before: list = [None] * n
    after: list = [None] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen: dict[int, int] = {}
        for i in order:
            found[i] = seen.get(regions[i])
            if kinds[i] in ("good", "bad"):
                seen[regions[i]] = i
    out = []
    for i, (kind, region, left, right) in enumerate(zip(kinds, regions, before, after)):
        if kind in ("good", "bad", "out"):
            out.append(kind == "good")
        elif kind == "links":
            out.append(left is not None and right is not None and kinds[left] == kinds[right] == "good")
        elif region:
            out.append(left is None or right is None or "good" in (kinds[left], kinds[right]))
        elif left is None and right is None:
            out.append(False)
        elif left is None or right is None:
            out.append(kinds[right if left is None else left] == "good")
        elif kinds[left] == kinds[right] or i - left != right - i:
            out.append(kinds[left if kinds[left] == kinds[right] or i - left < right - i else right] == "good")
        else:
            out.append(kind == "near")
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def settle_regions(blocks: list) -> list:
    """Blocks with their final region: what lies outside the page's article is out, but for its title.

    Articles that hold less than half as much prose as what lies outside are not
    the page's: each counts as part of the page, or is out if it has less than a
    tenth of that prose (a teaser).
    """
    inside: Counter[int] = Counter()  # prose by region
    for b in blocks:
        if b[3] and not b[2]:
            inside[b[3]] += (len(b[0]) - b[1]) * (first_pass(*b) == "good")
    if not inside:
        return blocks
    around = [b for b in blocks if not b[3] and not b[2]]
    if sum(len(b[0]) - b[1] for b in around) > 2 * sum(inside.values()):
        listed = has_list(blocks)
        prose = sum(len(b[0]) - b[1] for b in around if first_pass(*b, listed) in ("good", "near"))
        if prose > 2 * sum(inside.values()):
            return [b if not b[3] else (b[0], b[1], b[2] or 10 * inside[b[3]] < prose, 0, b[4]) for b in blocks]
    first = next(i for i, b in enumerate(blocks) if b[3] and not b[2])
    title = next((i for i in range(first - 1, -1, -1) if not blocks[i][2]), -1)
    if title >= 0 and (blocks[title][4] not in ("h1", "h2") or blocks[title][1] or blocks[first][4] in _HEADINGS or any(b[4] == "h1" for b in blocks[first:] if b[3] and not b[2])):
        title = -1
    return [b if b[3] else (b[0], b[1], False, blocks[first][3], b[4]) if i == title else (b[0], b[1], True, 0, b[4]) for i, b in enumerate(blocks)]


def lists_of_links(blocks: list, kinds: list[str]) -> list[str]:
    """Links of an article that follow a heading of theirs (which doesn't tell of other pages), in one list, are as ambiguous as short blocks."""
    out = list(kinds)
    for i, kind in enumerate(kinds):
        if kind != "links" or not i or blocks[i - 1][3] != blocks[i][3]:
            continue
        text, tag = blocks[i - 1][0], blocks[i - 1][4]
        if tag in _HEADINGS and kinds[i - 1] != "out" and not ELSEWHERE.intersection(_WORD.findall(text.lower())) or tag == blocks[i][4] and blocks[i - 1][1] and out[i - 1] == "short":
            out[i] = "short"
    return out


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by a newline; empty for null or no content."""
    blocks = settle_regions(parse_blocks(page or ""))
    listed = has_list(blocks)
    kinds = lists_of_links(blocks, [first_pass(*b, listed) for b in blocks])
    keep = second_pass(kinds, [b[3] for b in blocks])
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    Null html gives the empty text; null ids and urls and repeated rows stay as
    they are; other columns are left out.  Whole pages are read, whatever their length.
    """
    small_batches(pages.sparkSession)

    def work(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    return pages.select(*cols).mapInArrow(released(work), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
