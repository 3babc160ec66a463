"""Main text of web pages by minimum cut.

A page becomes blocks of text in page order, each at its place in the element tree. Marks come from element names,
roles and the words of class and id: content (article, main), furniture (nav, footer, comments, adverts, ...) or
none. One element that holds most of the page's prose may be the primary one; marks on the elements around it then
say nothing, since they name the layout, and blocks outside weigh less. Marks and text (length, share of links) give
each block a classifier cost, which becomes a terminal capacity: positive ones tie it to "content", negative ones to
"boilerplate". Smoothness edges join blocks that follow each other, and blocks that follow each other under one
parent, the stronger the nearer they are in the tree. Maximum flow finds the cheapest cut. Blocks whose terminal
outweighs all their edges keep its side in every minimum cut, so they are settled before the flow runs.

White space inside a block becomes one space, blocks are joined by an empty line; nothing is capped. Elements point
to their parents, and open elements are kept by name, so deep or unclosed markup costs linear time and memory.

Edge cases: null and empty html give an empty text; broken markup is read as far as it goes: open elements end with
their parents, an open comment runs to the end; a page without content blocks gives an empty text; rows that repeat
are treated one by one; no rows give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements of HTML, roles, and the words of class and id names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
_SKIPPED = frozenset("head template object svg canvas audio video select option datalist button annotation annotation-xml".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
_LISTS, _TABLE, _BOUNDS = ("ul", "ol", "dl", "menu", "dir", "table"), ("table", "template"), ("table", "td", "th", "caption", "button", "object", "template")
_PLAIN = frozenset("p li dt dd td th pre blockquote figcaption caption summary html body".split()) | _HEADINGS
_STATE = frozenset("has have with without no not is show hide off on enabled disabled layout template theme category cat tag type status format".split())
_GENERIC = frozenset("wrap wrapper container inner outer box block area section list item items group row col column panel region holder module form link links button buttons btn icon icons title text label bar top bottom left right main primary secondary".split())
_HEADER = frozenset("header masthead topbar".split())
_SIDE = frozenset("sidebar sidebars rail nav navigation navbar footer".split())
_FURNITURE = _SIDE | frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsors sponsored promo promos promotion promotions menu menus breadcrumb breadcrumbs aside widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay comment comments commentlist disqus replies respond share sharing sharebar social subscribe subscription newsletter signup login signin related recommended recommendations recirculation teaser teasers pagination pager toolbar copyright search searchform paywall outbrain taboola".split())
_LEADS = _FURNITURE - frozenset("aside search related recommended alert notice share social widget modal overlay promotion subscription".split()) | {"skip"}
_RELATED = frozenset("related recommended popular trending more latest".split())
_ELSEWHERE = frozenset("posts articles stories content news reading videos products topics reads".split())
_CONTENT = frozenset("article articles content entry post story body maincontent articlebody articlecontent postcontent".split())
_ROLES = {"navigation": "hard", "contentinfo": "hard", "complementary": "hard", "search": "hard", "dialog": "hard", "alertdialog": "hard", "alert": "hard", "menu": "hard", "menubar": "hard", "toolbar": "hard", "banner": "header", "main": "main", "article": "article", "form": "form"}
_NAMES = {"nav": "hard", "footer": "hard", "aside": "hard", "dialog": "hard", "menu": "hard", "search": "hard", "form": "form", "header": "header", "article": "article", "main": "main"}
#: Costs by mark, as log-odds of content: furniture, and content by what holds the block.
BAD, GOOD = {"hard": 9.0, "form": 7.0, "side": 7.0, "soft": 7.0, "header": 4.0}, {"article": 5.0, "main": 4.0, "content": 2.0}
#: By text: a word (up to LONG words' worth), an empty block, a share of links of one (in short blocks), a heading, a
#: short list item; and what a block outside the primary element loses, by that element's mark.
WORD, LONG, NONE, LINKED, HEADING, SHORT_ITEM = 0.15, 2.0, -0.5, -4.0, 0.5, -1.0
OUTSIDE = {"article": -2.5, "main": -2.5, "content": -1.0}
#: A section inside the primary element whose name only begins like furniture ("navigation-basics"), or whose id alone
#: says so ("menus", an id made from its heading), is about that topic if it holds so many words that are no links.
#: Comments of readers stay what they are.
TOPIC_WORDS = 40
_READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: The share of unmarked prose that a primary element holds at least, and the smoothness of two parts of one element.
PRIMARY, SMOOTH, EPSILON = 0.5, 1.6, 1e-9
_SPACE = " "


def _named(value: str) -> tuple[str | None, bool]:
    """What a class or id value says: a mark, or None, and whether only the beginning of a name says so. Names are read
    by their last word that isn't generic."""
    found = None
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or _STATE & set(words):
            continue
        core = list(words)
        while len(core) > 1 and core[-1] in _GENERIC:
            core.pop()
        last = core[-1]
        if last in _FURNITURE or (words[0] in _LEADS and not last.endswith("layout")) or (words[0] in _RELATED and words[-1] in _ELSEWHERE):
            return ("side" if last in _SIDE else "soft"), last not in _FURNITURE and words[0] not in _READERS
        if last in _HEADER:
            found = "header"
        elif found is None and last in _CONTENT:
            found = "content"
    return found, False


def _mark(name: str, attributes: str) -> tuple[str | None, bool, bool]:
    """(mark, whether the element isn't shown, whether the mark may be the topic of a section)."""
    mark, hidden, topic = _NAMES.get(name), False, False
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (values[0] or values[1] or values[2])
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = value.lower() != "until-found"
            elif key == "aria-hidden" and value.lower() == "true" and name in _BLOCK:
                hidden = True
            elif name not in _BLOCK or name in ("html", "body"):
                continue
            elif key == "role":
                mark = _ROLES.get(value.strip().lower(), mark)
            elif key == "itemprop" and value.lower() == "articlebody":
                mark = "article"
            elif key == "class" or (key == "id" and name not in _PLAIN):
                if key == "class" and re.search(r"(?:^|\s)(?:hidden|visually-hidden|sr-only|screen-reader-text)(?:\s|$)", value) and not re.search(r":(?:block|flex|grid|inline)", value):
                    hidden = True
                said, begins = _named(value)
                about = begins or (key == "id" and said in ("soft", "side") and not _READERS & {w.lower() for w in _WORD.findall(value)})
                if said is not None and (mark is None or (mark in ("article", "main", "content") and said in ("soft", "side"))):
                    mark, topic = said, about
                elif said in ("soft", "side") and not about:
                    topic = False  # a second name says the same for sure
    return mark, hidden, topic


class Page:
    """The element tree and the blocks of a page. Element 0 is the page itself; parents come before their children."""

    def __init__(self, html: str):
        self.parents, self.tags, self.marks, self.shown, self.topics = [0], [""], [None], [True], [False]
        #: text, words, share of links, element, nearest block element, the one around that, depth, and the depth that
        #: the block shares with the one before it (both in block elements)
        self.blocks: list[tuple[str, int, float, int, int, int, int, int]] = []
        self._names, self._numbers, self._skips = [""], [0], [False]  # of the open elements, outermost first
        self._places: dict[str, list[int]] = defaultdict(list)  # where open elements of a name are among them
        self._holders = [0]  # where the block elements are
        self._text: list[str] = []
        self._linked = self._links = self._shared = 0
        self._read(html)

    def _top(self, *names: str) -> int:
        return max((self._places[n][-1] for n in names if self._places[n]), default=-1)

    def _flush(self) -> None:
        joined = _SPACE.join("".join(self._text).split())
        if joined:
            number, depth = self._numbers, len(self._holders)
            around = number[self._holders[-2]] if depth > 1 else -1
            linked = min(1.0, self._linked / len(joined))
            self.blocks.append((joined, joined.count(_SPACE) + 1, linked, number[-1], number[self._holders[-1]], around, depth, self._shared))
            self._shared = depth
        self._text.clear()
        self._linked = 0

    def _close(self, at: int) -> None:
        """The open element at this place ends, with those inside it."""
        if self._holders[-1] >= at:
            self._flush()
        while len(self._names) > at:
            name = self._names.pop()
            self._numbers.pop()
            self._skips.pop()
            if name:
                self._places[name].pop()
            if name == "a":
                self._links -= 1
            if self._holders[-1] == len(self._names):
                self._holders.pop()
        self._shared = min(self._shared, len(self._holders))

    def _end(self, name: str) -> None:
        at = self._top(*_HEADINGS) if name in _HEADINGS else self._top(name)
        if name in _BLOCK:
            bounds = _TABLE if name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption") else (*_BOUNDS, "ul", "ol") if name == "li" else _BOUNDS
            if at > self._top(*(b for b in bounds if b != name)):
                self._close(at)
            elif name == "p":
                self._flush()
        elif at > self._holders[-1]:
            self._close(at)
        elif name == "a" and at > 0:  # block elements inside it are open: they stay, and no longer link
            self._places["a"].pop()
            self._names[at] = ""
            self._links -= 1

    def _start(self, name: str, attributes: str) -> None:
        block = name in _BLOCK
        if block:
            if name in ("html", "body") and self._places[name]:
                return
            if name != "html" and self._places["head"]:
                self._close(self._top("head"))
            if self._top("svg") > self._holders[-1]:
                self._close(self._top("svg"))
            p = self._top("p")
            if p > self._top(*_BOUNDS):
                self._close(p)
            if name in _ENDS:
                at = self._top(*_ENDS[name])
                if at > self._top(*(_LISTS if name in ("li", "dt", "dd") else ("table",))):
                    self._close(at)
            self._flush()
        elif name in ("a", "button") and self._places[name]:
            self._end(name)
        elif attributes.endswith("/") and (self._places["svg"] or self._places["math"]):
            return
        mark, hidden, topic = _mark(name, attributes)
        number = len(self.parents)
        self.parents.append(self._numbers[-1])
        self.tags.append(name)
        self.marks.append(mark)
        self.topics.append(topic)
        self.shown.append(not hidden or name in ("html", "body"))
        self._places[name].append(len(self._names))
        if block:
            self._holders.append(len(self._names))
        self._links += name == "a"
        self._names.append(name)
        self._numbers.append(number)
        self._skips.append(self._skips[-1] or name in _SKIPPED or (hidden and not block))

    def _read(self, html: str) -> None:
        at, raw = 0, ""
        while at < len(html):
            if raw:  # raw text runs to its own end tag
                end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at, raw = (end.end() if end else len(html)), ""
                continue
            m = _PART.match(html, at)
            if m is None:  # an unfinished tag with an open quote: read it as far as the next sign
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
                continue
            at = m.end()
            if m[4] is not None:
                if not self._skips[-1]:
                    piece = unescape(m[4])
                    self._text.append(piece)
                    self._linked += len(piece) if self._links else 0
                continue
            name = (m[2] or "").lower()
            if m[1]:
                self._end(name)
            elif name == "br":
                self._text.append(_SPACE)
            elif name == "hr":
                self._start(name, "")
                self._close(len(self._names) - 1)
            elif name in _RAW:
                raw = name
            elif name and name not in _VOID:
                self._start(name, m[3])
        self._flush()

    def _primary(self, free: list[int], furniture: list[bool]) -> int:
        """The element that holds most of the prose that no furniture holds, or 0: an article, else main, else the
        outermost that is named like content."""
        for kind in ("article", "main", "content"):
            found = [e for e, m in enumerate(self.marks) if m == kind]
            best = max(found, key=lambda e: (free[e], -e), default=0)
            if best and free[best] > 0 and free[best] >= PRIMARY * (free[0] + (free[best] if furniture[best] else 0)):
                return best
        return 0

    def costs(self, none: float = NONE) -> list[float]:
        """Of each block, above zero for content; none is what an empty block would cost."""
        n = len(self.parents)
        weighs = [BAD.get(m, 0.0) if s else BAD["hard"] for m, s in zip(self.marks, self.shown)]
        furniture = [w >= BAD["soft"] for w in weighs]
        free = [0] * n  # words of prose in an element, outside the furniture in it
        for _, words, linked, element, *_ in self.blocks:
            if linked < 0.5:
                free[element] += words
        prose = list(free)
        for e in range(n - 1, 0, -1):
            prose[self.parents[e]] += prose[e]
        for e in range(n - 1, 0, -1):
            if not furniture[e]:
                free[self.parents[e]] += free[e]
        for e in range(1, n):
            furniture[e] = furniture[e] or furniture[self.parents[e]]
        primary = e = self._primary(free, furniture)
        while e:  # what is around it is layout, whatever its name
            weighs[e], e = 0.0, self.parents[e]
        if not primary:  # so is a form, or what is named like a column, around nearly all of the page
            for e in range(1, n):
                if self.marks[e] in ("form", "side") and self.shown[e] and not furniture[self.parents[e]] and free[e] > 9 * free[0]:
                    weighs[e] = 0.0
        good, inside, sure, main, heading, item = [0.0] * n, [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            above, mark, tag = self.parents[e], self.marks[e], self.tags[e]
            inside[e] = inside[above] or e == primary
            if inside[e] and self.topics[e] and self.shown[e] and prose[e] >= TOPIC_WORDS:
                weighs[e] = 0.0
            sure[e] = sure[above] or mark in ("article", "main")
            main[e] = main[above] or mark == "main"
            heading[e], item[e] = heading[above] or tag in _HEADINGS, item[above] or tag == "li"
            weighs[e] = max(weighs[above], 0.0 if mark == "header" and sure[above] else weighs[e])
            good[e] = max(good[above], GOOD.get(mark, 0.0) if inside[e] or not primary else 0.0)
        outside = OUTSIDE.get(self.marks[primary], 0.0)
        out = []
        for _, words, linked, e, *_ in self.blocks:
            cost = -weighs[e] if weighs[e] else good[e] if inside[e] or main[e] else good[e] + outside
            cost += min(LONG, WORD * words) + none + (LINKED * linked if words < 40 else 0.0)
            out.append(cost + (HEADING if heading[e] else SHORT_ITEM if item[e] and words < 4 else 0.0))
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness edges: page neighbours, and neighbours under one parent; nearer in the tree is stronger."""
        found = []
        last: dict[int, int] = {}
        for i, (_, _, _, _, own, around, depth, shared) in enumerate(self.blocks):
            if i:
                found.append((i - 1, i, SMOOTH / (1 + depth + self.blocks[i - 1][6] - 2 * shared)))
            j = last.get(around)
            if j is not None and j < i - 1:
                found.append((j, i, SMOOTH / (1 if self.blocks[j][4] == own else 3)))
            last[around] = i
        return found


def min_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut (ties: content only if reached)."""
    weight: list[dict[int, float]] = [{} for _ in costs]
    for i, j, w in links:
        weight[i][j] = weight[i].get(j, 0.0) + w
        weight[j][i] = weight[j].get(i, 0.0) + w
    cost, side = list(costs), [None] * len(costs)
    todo = deque(range(len(costs)))
    while todo:  # settle what its terminal alone decides; its edges then weigh on the neighbours' terminals
        i = todo.popleft()
        if side[i] is None and abs(cost[i]) > sum(weight[i].values()):
            side[i] = cost[i] > 0
            for j, w in weight[i].items():
                cost[j] += w if side[i] else -w
                del weight[j][i]
                todo.append(j)
            weight[i] = {}
    _flow(cost, weight, side)
    return [bool(s) for s in side]


def _flow(cost: list[float], left: list[dict[int, float]], side: list[bool | None]) -> None:
    """Settle the nodes whose side is open by a maximum flow in rounds of shortest paths: cost holds what is left of the
    terminals' capacities, left what each edge can still carry."""
    free = [i for i, s in enumerate(side) if s is None]
    sources = [i for i in free if cost[i] > EPSILON]
    while True:
        level = {i: 0 for i in sources if cost[i] > EPSILON}
        queue, reached = deque(level), False
        while queue:
            x = queue.popleft()
            reached = reached or cost[x] < -EPSILON
            for y, c in left[x].items():
                if c > EPSILON and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if not reached:
            break
        arcs, at = {x: list(left[x]) for x in level}, dict.fromkeys(level, 0)
        for source in sources:
            path = [source]
            while path and cost[source] > EPSILON:
                x = path[-1]
                if cost[x] < -EPSILON:
                    steps = list(zip(path, path[1:]))
                    flow = min(cost[source], -cost[x], *(left[a][b] for a, b in steps))
                    cost[source] -= flow
                    cost[x] += flow
                    for a, b in steps:
                        left[a][b] -= flow
                        left[b][a] = left[b].get(a, 0.0) + flow
                    path = [source]
                elif at[x] == len(arcs[x]):
                    path.pop()
                    if path:
                        at[path[-1]] += 1
                elif level.get(y := arcs[x][at[x]]) == level[x] + 1 and left[x][y] > EPSILON:
                    path.append(y)
                else:
                    at[x] += 1
    for i in free:
        side[i] = i in level


def main_text(html: str | None) -> str:
    page = Page(html or "")
    keep = min_cut(page.costs(), page.edges())
    if not any(keep):  # a page of short blocks alone: they have nothing longer to be less likely than
        keep = min_cut(page.costs(none=0.0), page.edges())
    return "\n\n".join(b[0] for b, k in zip(page.blocks, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows (*keep, text) for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([main_text(x) for x in batch.column(0).to_pylist()], pa.string())], [*keep, "text"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(html_col).cast("string").alias("__html"), *keep).mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["text string"]))
