"""Operator 8: main text of html pages by line-block distribution.

Markup is stripped to lines, one per text block.  A line's length is that of
its text outside links (a top heading counts whole).  The lengths of a sliding
window of ``WINDOW`` lines are summed: main text is where a sum surges to
``SURGE`` characters.  The surge and dive points lie where the divisions of the
page that hold these lines begin and end (``_outlined``), and between them every
line is kept, however short it is.  A page whose sums surge nowhere keeps all
that is not links alone.

An article or main element that lies in no other one is a stretch as a whole,
with all that is nested in it.  Beside those that surge (or all of them, if
none does) a stretch outside is kept only if it outweighs each of them.

Chrome is stripped with the markup: by tag, by the hidden attributes, and by
role, class, id or form where the line blocks of the element's own text bear
it out (``_chrome``).  So an advert inside an article leaves no hole in it.

Each page is read once, whole, in a task of its own partition; no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that a window holds, and the characters outside links at which its sum surges.
WINDOW, SURGE = 3, 120

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup: it ends at their closing tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a line of text.
BLOCK = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul video audio canvas").split())
#: Of these, the ones that part a text into paragraphs, lists and tables; the others divide the page.
TEXT = frozenset((
    "address blockquote br caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li ol option p pre summary "
    "table tbody td tfoot th thead tr ul").split())
#: Elements that part the page's text.
ARTICLE = frozenset(("article", "main"))
#: Chrome by tag.
CHROME = frozenset((
    "nav footer aside script style noscript template iframe button select textarea svg head title menu object embed "
    "dialog canvas audio video map noembed noframes xmp input datalist").split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Chrome by a word of class or id.
CHROME_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer disqus footer form gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "popup promo promoted related respond replies share sharing sidebar sidebars social sponsor sponsored subscribe subscription "
    "toolbar widget widgets skip topbar").split())
#: Of these, the readers' own words: they may well be most of a page.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
#: With nothing but these beside it, a word of chrome is the name's whole meaning.
PLACE_WORDS = frozenset((
    "left right top bottom upper lower primary secondary main site page global box container wrapper wrap block area section list inner "
    "outer holder slot unit item bar panel region zone group content first last small large").split())
#: After these, the name says what a page has, not what the element is.
HAVING = frozenset("has have having no not non with without".split())
#: These keep their text whatever a class says; an article only if it is not one of these.
CORE = frozenset("html body main".split())
OTHER_ARTICLES = frozenset("comment comments reply replies related promo sponsored ad advert".split())

#: Open elements that a tag ends without their closing tag, and those it does not look beyond.
_CELL = frozenset("td th caption button object table".split())
_LIST = frozenset("ul ol menu dl".split()) | _CELL | ARTICLE | {"section", "blockquote", "form", "body", "html"}
_TABLE = frozenset(("table",))
_ENDS = {t: (frozenset(("p",)), _CELL) for t in (
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre section summary table ul").split()}
_ENDS_OWN = {"li": (frozenset(("li",)), _LIST), "dd": (frozenset(("dd", "dt")), _LIST), "dt": (frozenset(("dd", "dt")), _LIST),
             "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
             "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE), "tr": (frozenset(("tr",)), _TABLE),
             **{t: (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), _TABLE) for t in ("tbody", "thead", "tfoot")}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    """Name by name, so that no value is taken for a name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _named(value: str) -> str:
    """What a class or id says: "comment", "chrome", "maybe" (a word of chrome among others) or ""."""
    says = ""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        found = [i for i, w in enumerate(words) if w in CHROME_WORDS]
        if not found or not HAVING.isdisjoint(words[:found[-1]]):
            continue
        if any(words[i] in COMMENT_WORDS for i in found):
            return "comment"
        if all(w in CHROME_WORDS or w in PLACE_WORDS for w in words):
            says = "chrome"
        says = says or "maybe"
    return says


def _suspicion(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element may be chrome: "tag" and "hidden" say it is, what
    ``_named`` gives and "maybe" for a form are for ``_chrome`` to decide."""
    if tag in CHROME or tag == "header" and not in_article:  # an article's own header holds its title
        return "tag"
    says = "maybe" if tag == "form" else ""
    if not attributes or tag in CORE or tag == "header":
        return says
    has = _attributes(attributes)
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true":
        return "hidden"
    role = has.get("role", "").lower()
    if role in CHROME_ROLES:
        return "maybe" if role == "form" else "chrome"
    if tag == "article":
        return "" if OTHER_ARTICLES.isdisjoint(has.get("class", "").lower().split()) else "comment"
    for value in (has.get("class", ""), has.get("id", "")):
        named = _named(value) if value else ""
        if named and not (in_article and "header" in value.lower() and tag != "div"):
            says = named if says in ("", "maybe") else says
    return says


@dataclass
class Span:
    """An open element that matters: where it begins and ends in the stream."""

    why: str
    first: int
    outer: int  # the suspect around it, or -1
    region: int  # the article around it, or -1
    last: int = 0


@dataclass
class Page:
    """A page's text in order, and its suspects and outermost articles."""

    parts: list[str | None] = field(default_factory=list)  # None: a line ends
    suspect: list[int] = field(default_factory=list)  # the innermost of each part, or -1
    region: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # the innermost block of each part, or -1
    tags: list[str] = field(default_factory=list)  # of each block, in the order they open
    around: list[int] = field(default_factory=list)  # the block around it, or -1
    until: list[int] = field(default_factory=list)  # the last block in it
    suspects: list[Span] = field(default_factory=list)
    regions: list[Span] = field(default_factory=list)


def parse(html: str) -> Page:
    """The page without markup.  Unclosed and stray tags are taken as browsers
    do, roughly: a closing tag closes what it names and all inside, and the
    tags of ``_ENDS`` close what cannot hold them."""
    page = Page()
    stack: list[tuple[str, bool, int, int, int]] = []  # open elements: tag, whether chrome by tag, their suspect, region and block
    chrome = links = titles = at = 0
    suspect = region = block = -1

    def put(text: str | None) -> None:
        page.parts.append(text)
        page.suspect.append(suspect)
        page.region.append(region)
        page.linked.append(links > 0 and not titles)
        page.block.append(block)

    def pop() -> None:
        nonlocal chrome, links, titles, suspect, region, block
        tag, by_tag, mine, article, box = stack.pop()
        chrome -= by_tag
        links -= tag == "a"
        titles -= tag in ("h1", "h2")
        if mine >= 0:
            page.suspects[mine].last = len(page.parts)
            suspect = page.suspects[mine].outer
        if article >= 0:
            page.regions[article].last = len(page.parts)
            region = -1
        if box >= 0:
            page.until[box] = len(page.tags) - 1
            block = page.around[box]

    def end(tags: frozenset[str], beyond: frozenset[str]) -> bool:
        """Closes the innermost of ``tags`` and all inside, if it is open on this side of ``beyond``."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return True
            if stack[i][0] in beyond:
                break
        return False

    while True:
        m = _TOKEN.search(html, at)
        if not chrome and at < (m.start() if m else len(html)):
            put(html[at:m.start() if m else len(html)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not chrome:
                put(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1]:
            visible = not chrome
            if tag != "body" and tag != "html":  # what follows those still belongs to the page
                own = _ENDS["p"] if tag == "p" else _ENDS_OWN.get(tag)
                end(frozenset((tag,)), own[1] if own else frozenset())
            if tag in BLOCK and (visible or not chrome):
                put(None)
            continue
        for rule in (_ENDS.get(tag), _ENDS_OWN.get(tag)):
            if rule:
                end(*rule)
        why = _suspicion(tag, m[3], region >= 0)
        if tag in BLOCK and not chrome:
            put(None)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if not (why or chrome):
                put(html[at:close.start() if close else len(html)])
            at = close.end() if close else len(html)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        mine = article = box = -1
        if why and why != "tag" and not chrome:
            mine = len(page.suspects)
            page.suspects.append(Span(why, len(page.parts), suspect, region))
            suspect = mine
        if tag in ARTICLE and region < 0 and not why and not chrome:
            article = region = len(page.regions)
            page.regions.append(Span("", len(page.parts), suspect, -1))
        if tag in BLOCK and why != "tag" and not chrome:
            box = len(page.tags)
            page.tags.append(tag)
            page.around.append(block)
            page.until.append(box)
            block = box
        stack.append((tag, why == "tag", mine, article, box))
        chrome += why == "tag"
        links += tag == "a"
        titles += tag in ("h1", "h2")
    while stack:
        pop()
    return page


def _sums(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def _chrome(page: Page) -> list[bool]:
    """Whether each suspect's text goes.  Hidden elements go, and all in an
    element that goes.  One that holds the page's article, or an article that
    surges, stays.  Of the others, readers' comments go, however long they and
    the text are.  A name that says chrome in full goes unless the element holds
    most of its article's text without comments (the page's, if there is no
    article) and surges.  A name that only mentions chrome, and a form, go if
    they do not surge."""
    size = [0 if t is None or link else len("".join(t.split())) for t, link in zip(page.parts, page.linked, strict=True)]
    total = _sums(size)
    in_region = _sums([n if r >= 0 else 0 for n, r in zip(size, page.region, strict=True)])
    line, full = [0], False  # of each part; lines without text are none
    for t in page.parts:
        full = full or t is not None and not t.isspace()
        line.append(line[-1] + (t is None and full))
        full = full and t is not None
    lengths = [0] * (line[-1] + 1)
    for i, n in enumerate(size):
        lengths[line[i]] += n
    window = _sums([int(sum(lengths[i:i + WINDOW]) >= SURGE) for i in range(len(lengths))])

    def surges(first: int, last: int) -> bool:
        if total[last] - total[first] < SURGE:
            return False
        a, b = line[first], line[last] + 1
        return b - a <= WINDOW or window[max(b - WINDOW + 1, a)] > window[a]

    starts = [r.first for r in page.regions]
    dense = _sums([int(surges(r.first, r.last)) for r in page.regions])
    comments = [0] * (len(page.regions) + 1)  # characters of comments per article, the last one's outside
    for s in page.suspects:
        if s.why == "comment" and (s.outer < 0 or page.suspects[s.outer].why != "comment"):
            comments[s.region] += total[s.last] - total[s.first]
    out: list[bool] = []
    for s in page.suspects:
        own = total[s.last] - total[s.first]
        a, b = bisect_left(starts, s.first), bisect_left(starts, s.last)
        if s.outer >= 0 and out[s.outer] or s.why == "hidden":
            out.append(True)
        elif s.region < 0 and a < b and (dense[b] > dense[a] or 2 * (in_region[s.last] - in_region[s.first]) > in_region[-1]):
            out.append(False)
        elif s.why == "maybe":
            out.append(not surges(s.first, s.last))
        elif s.why == "comment":
            out.append(True)
        elif s.region < 0 and page.regions:
            out.append(True)
        else:
            first, last = (0, len(page.parts)) if s.region < 0 else (page.regions[s.region].first, page.regions[s.region].last)
            whole = total[last] - total[first] - comments[s.region]
            out.append(not (2 * own > whole and surges(s.first, s.last)))
    return out


def _unseen(page: Page) -> list[bool]:
    """The suspects that go whatever the page would be without them: hidden ones and readers' comments."""
    out: list[bool] = []
    for s in page.suspects:
        out.append(s.why in ("hidden", "comment") or s.outer >= 0 and out[s.outer])
    return out


def lines(page: Page, gone: list[bool]) -> tuple[list[str], list[int], list[int], list[int]]:
    """The page's lines, cleaned and not empty, without the suspects that are
    ``gone``: their text, length outside links, article or -1, and block or -1."""
    texts: list[str] = []
    sizes: list[int] = []
    regions: list[int] = []
    blocks: list[int] = []
    part: list[str] = []
    plain: list[str] = []
    at = box = -1

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(part))).strip()
        if text:
            texts.append(text)
            sizes.append(len(_SPACE.sub(" ", unescape("".join(plain))).strip()))
            regions.append(at)
            blocks.append(box)
        part.clear()
        plain.clear()

    said = False  # whether the line has text yet
    for text, suspect, region, link, block in zip(page.parts, page.suspect, page.region, page.linked, page.block, strict=True):
        if suspect >= 0 and gone[suspect]:
            continue
        if text is None or region != at:
            flush()
            at, said = region, False
        if text is not None:
            if not said and not text.isspace():
                box, said = block, True
            part.append(text)
            if not link:
                plain.append(text)
    flush()
    return texts, sizes, regions, blocks


def _stretches(sizes: list[int], first: int, last: int) -> Iterator[tuple[int, int]]:
    """From where the window sums rise from nothing to where they dive back to it."""
    start = end = None
    for i in range(first, last):
        if sizes[i]:
            if start is not None and i - end >= WINDOW:  # a whole window of nothing lies between
                yield start, end
                start = None
            start, end = i if start is None else start, i + 1
    if start is not None:
        yield start, end


def _surges(sizes: list[int], first: int, last: int) -> bool:
    return any(sum(sizes[i:min(i + WINDOW, last)]) >= SURGE for i in range(first, last))


def _surging(sizes: list[int], divisions: list[int]) -> list[int]:
    """The lines that carry a window that surges: of its sum, they hold their
    share or more.  A window ends with its division, so that a note of one line
    is not taken for text because it lies beside some."""
    total = _sums(sizes)
    last = -1  # the last line of the windows that surge so far
    end = 0  # of the lines of one division
    out = []
    for i, n in enumerate(sizes):
        while end <= i or end < len(sizes) and divisions[end] == divisions[i]:
            end += 1
        if total[min(i + WINDOW, end)] - total[i] >= SURGE:
            last = min(i + WINDOW, end) - 1
        if i <= last and n * WINDOW >= SURGE:
            out.append(i)
    return out


def _outlined(page: Page, sizes: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """The lines between the surge and dive points of a page without articles;
    none if no window surges.

    The innermost division with all lines that surge is kept whole, but for a
    window or more of links at its ends.  If it is the body, the points are where
    its first and last division or paragraph with such a line begins and ends, and
    divisions between them that hold links alone, a window or more, are menus.
    Outwards from there paragraphs, lists and tables go on with the text, at
    each level up to the next division."""
    tags, around, until = page.tags, page.around, page.until
    division: list[int] = []  # of each block, the innermost
    for b, tag in enumerate(tags):
        division.append(b if tag not in TEXT else division[around[b]] if around[b] >= 0 else -1)
    surging = _surging(sizes, [division[b] if b >= 0 else -1 for b in blocks])
    if not surging:
        return []
    held = [blocks[i] for i in surging]
    top, most = min(held), max(held)  # blocks are numbered as they open, so what holds these two holds all between
    while top >= 0 and (tags[top] in TEXT or until[top] < most):
        top = around[top]
    children = [[] for _ in range(len(tags) + 1)]  # the last list has those in no block
    for b, outer in enumerate(around):
        children[outer].append(b)

    def within(b: int, outer: int) -> bool:
        return outer < 0 or outer <= b <= until[outer]

    def unit(i: int, outer: int) -> int:
        """The block in ``outer`` that holds line i, or -1: its own text."""
        return -1 if blocks[i] == outer else children[outer][bisect_left(children[outer], blocks[i] + 1) - 1]

    def divides(b: int) -> bool:
        return b >= 0 and tags[b] not in TEXT

    def onwards(i: int, step: int, outer: int) -> int:
        """The last line from i on that belongs to the text; links alone do not."""
        end, i = i, i + step
        while 0 <= i < len(sizes) and within(blocks[i], outer) and not divides(unit(i, outer)):
            end = i if sizes[i] else end
            i += step
        return end

    kept = [True] * len(sizes)
    if top < 0 or tags[top] in ("html", "body"):
        first, last = surging[0], surging[-1]
        a, b = unit(first, top), unit(last, top)
        while a >= 0 and first and within(blocks[first - 1], a):
            first -= 1
        while b >= 0 and last + 1 < len(sizes) and within(blocks[last + 1], b):
            last += 1
        i = first
        while i <= last:
            box, end = unit(i, top), i + 1
            while box >= 0 and end <= last and within(blocks[end], box):
                end += 1
            if divides(box) and end - i >= WINDOW and not any(sizes[i:end]):
                kept[i:end] = [False] * (end - i)
            i = end
        first, last = onwards(first, -1, top), onwards(last, 1, top)
    else:
        inside = [i for i, b in enumerate(blocks) if within(b, top)]
        first, last = inside[0], inside[-1]
        links = next(i for i in inside if sizes[i]) - first
        first += links if links >= WINDOW else 0
        links = last - next(i for i in reversed(inside) if sizes[i])
        last -= links if links >= WINDOW else 0
    while top >= 0:
        top = around[top]
        first, last = onwards(first, -1, top), onwards(last, 1, top)
    return [(i, i + 1) for i in range(first, last + 1) if kept[i]]


def main_text(html: str) -> str:
    """The lines of the stretches that surge, in order."""
    page = parse(html)
    texts, sizes, regions, blocks = lines(page, _chrome(page))
    if not texts:  # a wrapper's name may speak of a part it holds
        texts, sizes, regions, blocks = lines(page, _unseen(page))
    edges = [i for i in range(len(texts) + 1) if i in (0, len(texts)) or regions[i] != regions[i - 1]]
    inside: list[tuple[int, int]] = []
    outside: list[tuple[int, int]] = []
    for first, last in zip(edges, edges[1:]):
        if regions[first] >= 0:
            inside.append((first, last))
        else:
            outside.extend(_stretches(sizes, first, last))
    high = [x for x in outside if _surges(sizes, *x)]
    if inside:
        kept = [x for x in inside if _surges(sizes, *x)] or inside
        most = max(sum(sizes[a:b]) for a, b in inside)
        kept = sorted(kept + [(a, b) for a, b in high if sum(sizes[a:b]) > most])
    else:
        kept = _outlined(page, sizes, blocks) or outside or [(0, len(texts))]
    return "\n".join(t for a, b in kept for t in texts[a:b])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url,
    html).  Null or empty html, and pages of chrome or of readers' comments alone,
    have an empty text.
    Repeated rows come out alike; no row is dropped and no text cut; other
    columns are not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))
