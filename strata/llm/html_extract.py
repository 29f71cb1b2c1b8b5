"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks, each with its open elements.  A linear
classifier over the elements' names and roles, links and wording turns every
block into two costs: of calling it content and of calling it boilerplate.
These are the capacities from the source and to the sink; blocks that follow
each other and blocks of one container are joined by smoothness edges that are
stronger the closer the blocks are in the tree.  The minimum cut labels all
blocks of the page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements (fixed values of the markup language).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math canvas object".split())
# An opening tag ends an open element of these kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
# Elements that a head can hold; anything else ends it.
HEAD_TAGS = VOID & {"base", "link", "meta"} | frozenset("html head title style script template noscript noframes basefont bgsound".split())
SCOPES = frozenset("article aside body div dl fieldset footer form header html li main nav ol section table td th ul blockquote".split())

# Elements and roles that never hold content, and names that tell of it.
AWAY_TAGS = frozenset("nav aside footer menu".split())
AWAY_ROLES = frozenset("navigation banner complementary contentinfo search alert menu menubar toolbar".split())
# Form controls, and elements and roles around them, whose text is judged by itself.
CONTROLS = frozenset("select button label legend option optgroup".split())
FORMS = frozenset("form fieldset".split())
DIALOGS = frozenset("dialog alertdialog".split())
AWAY_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertise(?:ments?)?|advertising|advertorial|adsbygoogle|"
    r"ad(?:box|slot|unit|space|banner|container|wrap|wrapper)|sponsor(?:s|ed)?|promo(?:s|box|tions?)?|"
    r"nav|navs|navi|navbar|navbox|navmenu|navlinks|navigation|topnav|subnav|sidenav|menus?|menubar|submenu|breadcrumbs?|"
    r"skip|toc|side|sidebars?|rail|widgets?|footers?|foot|copyright|legal|colophon|cookies?|cookie(?:bar|banner|notice|consent)|"
    r"consent|gdpr|notices?|alert|warning|announcement|popup|modal|overlay|toast|paywall|banner|newsletter|"
    r"subscribe|subscribers?|subscriptions?|sign(?:up|in)|login|register|search|search(?:bar|box|form)|share|sharing|"
    r"socials?|socialmedia|follow|related|recommend(?:ed|ations?)?|trending|popular|more|tags|taglist|pagination|pager|pages|"
    r"toolbar|hidden)(?![a-z])"
)
COMMENT_NAMES = re.compile(
    r"(?<![a-z])(?:comments?|comment(?:er|ers|ing|list|form|box|area|body|text|section)|usercomments?|disqus(?:thread)?|discussion|"
    r"replies|reply|respond|responses?|reactions?|guestbook)(?![a-z])"
)
FORM_NAMES = re.compile(r"(?<![a-z])form(?![a-z])")
HEADER_NAMES = re.compile(r"(?<![a-z])(?:header|masthead|topbar|siteheader|hero|logo|branding)(?![a-z])")
CONTENT_NAMES = re.compile(
    r"(?<![a-z])(?:article\w*|content|post|entry|story|main|maintext|text|body|articlebody|blogpost|prose)(?![a-z])"
)
# What a name says after these words is said of the layout, not of the element.
LAYOUT_NAMES = re.compile(r"(?<![a-z])(?:has|have|no|non|not|with|without|show|hide|overflow)(?![a-z]).*")
AWAY_WORDS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bsubscribe\b|\blog ?in\b|\bsign up\b", re.I)

_MARK = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)|<!--|<[!?/]")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")

# Weights of the classifier: log odds of content.
BIAS = -0.4
INSIDE = {"content": 3.0, "maybe": 1.5, "none": 0.0, "header": -1.5, "away": -6.0, "comments": -9.0}
LENGTH, SENTENCE, HEADING, LINKS, WORDING, HEADER_HEADING = 2.6, 0.5, 0.4, -3.5, -1.5, 2.0
# A box with a boilerplate name, one that has a content name too, and what words beyond 20 (up to 100) say in a box.
NAMED, MIXED, LONG = -5.0, -3.0, 3.0
# A form, and what words short of 20 say in it.
FORM, SHORT = -1.0, -5.0
# A box with a share of the page's words above these bounds is more and more, then wholly, taken for a wrapper of
# the page, whose names say nothing.  Words of marked content outside boxes count as several, those of other boxes as half.
WRAPPER, MARKED = (0.4, 0.6), 10
# Capacities of edges between blocks of one parent, of near and of far elements, and within a container.
SAME, NEAR, DISTANT, CONTAINER = 0.6, 0.3, 0.1, 0.2


@dataclass
class Box:
    """A form, a dialog or an element whose names tell of boilerplate, with all below it but articles."""

    cost: float
    form: bool
    outside: str  # the place around the box
    above: Box | None
    words: float = 0.0
    trust: float = 0.0  # how far the box is taken for a wrapper of the page
    around: float = 0.0  # what the place around the box says


@dataclass
class Element:
    tag: str
    depth: int
    place: str  # what the element's ancestors and names say within its box: a key of INSIDE
    parent: Element | None
    box: Box | None = None


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _place(tag: str, attributes: str, parent: Element | None) -> tuple[str, Box | None]:
    above, box = (parent.place, parent.box) if parent else ("none", None)
    if above in ("comments",) or tag in ("html", "body"):
        return above, box
    names: list[str] = []
    role = ""
    if attributes:
        values = {}
        for name, double, single, plain, hidden in _ATTRIBUTE.findall(attributes):
            values[(name or hidden).lower()] = (double or single or plain or "").lower()
        words = f"{values.get('class', '')} {values.get('id', '')} {values.get('itemprop', '')}".split()
        names = [LAYOUT_NAMES.sub("", word.replace("_", " ").replace("-", " ")) for word in words]
        role = values.get("role", "")
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
            return "away", box
    named = any(AWAY_NAMES.search(name) for name in names)
    told = [name for name in names if not AWAY_NAMES.search(name) and not COMMENT_NAMES.search(name)]
    content = any(CONTENT_NAMES.search(name) for name in told)
    article = tag in ("article", "main") or role in ("main", "article")
    if any(COMMENT_NAMES.search(name) for name in names) and not (article and (content or tag == "main" or role == "main")):
        return "comments", box
    if article:
        # An article in a box that only a name calls boilerplate is still an article.
        sticky = parent
        while sticky is not None:
            if sticky.tag in AWAY_TAGS:
                return above, box
            sticky = sticky.parent
        return "maybe" if named and not content and tag != "main" and role != "main" else "content", None
    if tag in AWAY_TAGS or role in AWAY_ROLES or tag in CONTROLS:
        return "away", box
    if above == "away":
        return above, box
    if tag in FORMS or role == "form" or any(FORM_NAMES.search(name) for name in names):
        box = Box(FORM, True, above, box)
        above = "none"
    if named or tag in DIALOGS or role in DIALOGS:
        # "text" beside a boilerplate name is mostly a matter of looks, as in text-center.
        content = content and any(found != "text" for name in told for found in CONTENT_NAMES.findall(name))
        box = Box(MIXED if content else NAMED, False, above, box)
        above = "none"
    if tag == "header" or any(HEADER_NAMES.search(name) for name in names):
        return "header", box
    if above in ("none", "maybe") and content:
        return "maybe", box
    return above, box


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, with white space runs as one space."""
    done: list[Block] = []
    stack: list[Element] = []
    current: Block | None = None
    boxes: list[Box] = []
    # Places in the stack by tag, and of the containers, so that no search goes through all open elements.
    places: dict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []
    links = 0
    head = 0

    def finish():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                done.append(current)
        current = None

    def add(raw: str):
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            if head:
                end_head()
            current = Block(stack[-1] if stack else Element("body", 0, "none", None))
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def close(place: int):
        nonlocal links, head
        for element in stack[place:]:
            links -= element.tag == "a"
            head -= element.tag == "head"
            places[element.tag].pop()
            if element.tag in SCOPES:
                scopes.pop()
        del stack[place:]

    def end_head():
        close(places["head"][0])

    at, end = 0, len(page)
    open_quotes: set[int] = set()
    while at < end:
        found = _MARK.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        whole = found.group()
        if whole == "<!--":
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if whole in ("<!", "<?", "</"):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        stop = _tag_end(page, at, open_quotes)
        if stop < 0:  # a tag that the page's end cuts off
            break
        closing, tag, attributes = found[1], found[2].lower(), page[at:stop]
        at = stop + 1
        if tag in BLOCKS:
            finish()
        elif tag == "br":
            add(" ")
        if closing:
            # A block's end closes what is open in it, another element's end stays within its container.
            innermost = places[tag][-1] if places[tag] else -1
            if innermost >= 0 and (tag in BLOCKS or not scopes or innermost >= scopes[-1]):
                close(innermost)
            continue
        if head and tag not in HEAD_TAGS:
            end_head()
        if tag in RAW:
            if attributes.endswith("/"):
                continue
            stop = _raw_end(tag).search(page, at)
            at = end if stop is None else stop.end()
            continue
        if tag in VOID or (tag == "head" and head):
            continue
        if tag in BLOCKS and tag not in ("html", "body"):
            _imply(places, scopes, close, {"p"})
        if tag in ENDS:
            _imply(places, scopes, close, set(ENDS[tag]))
        parent = stack[-1] if stack else None
        place, box = _place(tag, attributes, parent)
        if box is not None and (parent is None or box is not parent.box):
            if box.above is not None and (parent is None or box.above is not parent.box):
                boxes.append(box.above)  # a form with a boilerplate name
            boxes.append(box)
        places[tag].append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(Element(tag, len(stack), place, parent, box))
        links += tag == "a"
        head += tag == "head"
    finish()
    _weigh(done, boxes)
    return done


def _weigh(found: list[Block], boxes: list[Box]) -> None:
    """Tell boxes from wrappers of the page by their share of its words; outer boxes come first in ``boxes``."""
    free = boxed = 0.0
    for block in found:
        element = block.element
        if element.place in ("away", "comments"):
            continue
        words = (block.text.count(" ") + 1) * (1.0 - min(1.0, block.linked / len(block.text)))
        if element.box is None:
            free += words * (MARKED if element.place in ("content", "maybe") else 1)
        else:
            boxed += words
            element.box.words += words
    for box in reversed(boxes):
        if box.above is not None:
            box.above.words += box.words
    least, most = WRAPPER
    for box in boxes:
        others = free + (boxed - box.words) / 2
        share = box.words / (box.words + others) if box.words else 0.0
        box.trust = min(1.0, max(0.0, (share - least) / (most - least)))
        box.around = _inside(box.outside, box.above)


def _inside(place: str, box: Box | None) -> float:
    """What a place within a box says."""
    inner = INSIDE[place]
    if box is None or place in ("away", "comments"):
        return inner
    free = box.around if place == "none" else min(box.around, inner) if inner < 0 else max(box.around, inner)
    return box.trust * free + (1.0 - box.trust) * (min(box.around, box.cost) + inner)


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _RAW_ENDS:
        _RAW_ENDS[tag] = re.compile(rf"</{tag}\b[^>]*>?", re.I)
    return _RAW_ENDS[tag]


def _tag_end(page: str, at: int, open_quotes: set[int]) -> int:
    """The place of the ``>`` that ends a tag, reading on after its name at ``at``.

    Quoted values may hold a ``>``.  If a quote is never closed, the next ``>``
    ends the tag; -1 if there is none.  ``open_quotes`` keeps the quotes from
    which reading on has failed, so that no part of a page is read again and
    again.
    """
    first, passed = at, []
    while True:
        found = _STOP.search(page, at)
        if found is None or found.start() in open_quotes:
            break
        if found.group() == ">":
            return found.start()
        passed.append(found.start())
        closed = page.find(found.group(), found.end())
        if closed < 0:
            break
        at = closed + 1
    open_quotes.update(passed)
    return page.find(">", first)


def _imply(places: dict[str, list[int]], scopes: list[int], close, ended: set[str]) -> None:
    """Close the innermost open element of a kind in ``ended``, unless a container lies between."""
    place = max((places[tag][-1] for tag in ended if places.get(tag)), default=-1)
    if place >= 0 and (not scopes or place >= scopes[-1]):
        close(place)


def log_odds(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    words = block.text.count(" ") + 1
    element = block.element
    total = BIAS + _inside(element.place, element.box)
    total += LENGTH * min(words, 20) / 20
    if element.box is not None and element.place not in ("away", "comments"):
        weight = LONG * min(max(words - 20, 0), 80) / 80
        if element.box.form:
            weight = SHORT * (1 - min(words, 20) / 20)
        total += (1.0 - element.box.trust) * weight
    total += SENTENCE * block.text.endswith((".", "!", "?", ":", "”", '"'))
    total += LINKS * min(1.0, block.linked / len(block.text))
    heading = element.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    total += HEADING * heading
    if heading and element.place == "header" and any(e.place == "content" for e in _ancestors(element)):
        total += HEADER_HEADING
    if words < 30 and element.place != "content" and AWAY_WORDS.search(block.text):
        total += WORDING
    return total


def _ancestors(element: Element):
    while element.parent is not None:
        element = element.parent
        yield element


def _container(element: Element) -> Element:
    """The element that holds the block's own element."""
    return element.parent or element


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, counted up to five."""
    steps = 0
    while a is not b and steps < 5:
        if a is None or b is None:
            return steps + 2
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and from each block to the next one of its container."""
    made = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            steps = _distance(found[i - 1].element, block.element)
            made.append((i - 1, i, SAME if steps <= 2 else NEAR if steps <= 4 else DISTANT))
        key = id(_container(block.element))
        if key in last and last[key] < i - 1:
            made.append((last[key], i, CONTAINER))
        last[key] = i
    return made


def minimum_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    ``source`` and ``sink`` are the capacities of every node's terminal edges;
    ``links`` are undirected.  Blocking flows along shortest paths.
    """
    n = len(source)
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        # What passes straight through a node is cut in any case.
        straight = min(source[i], sink[i])
        if source[i] > straight:
            link(n, i, source[i] - straight, 0.0)
        elif sink[i] > straight:
            link(i, n + 1, sink[i] - straight, 0.0)
    for a, b, capacity in links:
        link(a, b, capacity, capacity)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[n] = 0
        queue = deque([n])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[n + 1] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = n
        while True:
            if a == n + 1:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                stop = next(k for k, e in enumerate(path) if room[e] <= least)
                del path[stop:]
                a = to[path[-1]] if path else n
                continue
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == n:
                    break
                level[a] = -1
                path.pop()
                a = to[path[-1]] if path else n
                continue
            path.append(e)
            a = to[e]


def label(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    odds = [log_odds(block) for block in found]
    # -log(1 - p) is paid for calling content boilerplate, -log(p) for the reverse.
    away = [math.log1p(math.exp(o)) if o < 30 else o for o in odds]
    keep = [math.log1p(math.exp(-o)) if o > -30 else -o for o in odds]
    return minimum_cut(away, keep, edges(found))


def main_text(page: str | None) -> str:
    """The main text of a page: content blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(block.text for block, content in zip(found, label(found)) if content)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Returns page_id, url, text, n_chars (code points).  A null or empty page, and
    one without content, has an empty text.  Repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """

    def extracted(batches):
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
