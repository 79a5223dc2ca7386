"""Main text of web pages, by container paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, join_counted, lean

# Names of HTML elements and attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
#: Elements that are no part of an article, whatever their class.
APART = frozenset("aside audio button canvas dialog footer form head iframe menu nav noscript object script select style svg template textarea title video".split())
#: What is set apart by no name inside an article, and outside of one only by a class or role that says nothing else.
FIXED = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li p pre summary table tbody td tfoot th thead tr".split())
#: Words in a class, id or role that often mark what isn't the article.
APART_WORDS = frozenset(
    "ad adbox ads adsbygoogle adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promoted recommended related search share sharing sidebar sidebars sidenav signup social sponsor sponsored subscribe subscription toolbar topbar topnav widget".split()
)
#: Those for what readers, sponsors or lawyers wrote, which isn't the article however long it is and however it varies, if the name says nothing else.
OTHERS_WORDS = frozenset(
    "ad adbox ads adsbygoogle adslot advert advertisement advertising adverts comment commentarea commentbox commenter commenters commentform commentlist comments commentsection commentthread consent cookie cookies disqus gdpr promo promoted replies reply respond sponsor sponsored".split()
)
#: Those for what readers wrote, in whatever name of a class.
READERS_WORDS = frozenset("comment commentarea commentbox commenter commenters commentform commentlist comments commentsection commentthread disqus replies reply respond".split())
MARKED = APART_WORDS | OTHERS_WORDS
#: Words that add nothing to a name: with them alone, a marked word still says all.
FILLERS = frozenset(
    "area bar block bottom box button buttons center col column container content cta desktop entry feed fixed global group holder inner item items js left level link links list lists main mini mobile module outer page panel placeholder post posts primary right row secondary section site slot slots sticky sub thread top unit units view wrap wrapper zone".split()
)
#: With one of these, a name tells of a page's state or layout (has-sidebar, comments-open) or of what was found (search-results), not of a part.
STATES = frozenset("closed disabled enabled has hide no off on open result results show with without".split())
#: With one of these, a header is an article's own.
OWN_HEADER = frozenset("article content entry page post story".split())
#: What a head holds; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An open one of these ends where another of its row starts.
ENDED_BY = {x: group for group in ({"li"}, {"dd", "dt"}, {"td", "th"}, {"tr"}, {"option"}) for x in group} | {"tr": {"td", "th", "tr"}}
WHOLE = frozenset("article main".split())
TITLE = frozenset(["h1"])
LIST = frozenset("ol ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends a sentence, and what may follow.
ENDS, CLOSING = frozenset(".!?…:;。！？؟।"), "\"'”’»)]」 "

#: The rest of a tag: quotes count only after an equals sign, and the first > elsewhere ends it.
_REST = r"""(?:[^>=]|=(?:\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment
    rf"|<(?P<raw>script|style|textarea|iframe)\b{_REST}>.*?(?:</(?P=raw)\s*>|\Z)"  # not markup inside
    r"|<[!?][^>]*>"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_REST})>"
    r"|</?[a-zA-Z][^>]*\Z",  # cut off
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: The slash of a tag that closes itself, which isn't a value's last character.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    #: The number of its path: that of the nearest container, itself included.
    path: int
    #: No part of an article: 0 if it may be one, 1 by its name alone (a doubt), 2 for good.
    apart: int
    #: The nearest of it and those around it that is an article or main element, a list, a title, a heading, a container; 0 if none is.
    whole: int
    list: int
    title: int
    heading: int
    container: int


@dataclass
class Page:
    """The elements that were opened, the paths of their containers, and the text blocks.

    A path is known by its number; it holds the number of the path around it and a step,
    so that deep nesting costs no more than its length. blocks: (node, text, characters
    in links). named: elements that may be set apart by their names alone, with their kind; vague: those
    of them whose names say other things, too.
    """

    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, 0, 0, 0, 0, 0, 0, 0)])
    above: list[int] = field(default_factory=lambda: [-1])
    steps: list[str] = field(default_factory=lambda: [""])
    tags: list[str] = field(default_factory=lambda: [""])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    named: dict[int, str] = field(default_factory=dict)
    vague: set[int] = field(default_factory=set)

    def step(self, above: int, tag: str, step: str) -> int:
        """The number of the path one step below another."""
        found = self.numbers.setdefault((above, step), len(self.steps))
        if found == len(self.steps):
            self.above.append(above)
            self.steps.append(step)
            self.tags.append(tag)
        return found

    def spelled(self, path: int) -> str:
        steps = []
        while path >= 0:
            steps.append(self.steps[path])
            path = self.above[path]
        return "/".join(reversed(steps))

    def number(self, spelled: str | None) -> int | None:
        """The number of a path that is written out; None if the page doesn't have it."""
        if spelled is None:
            return None
        path: int | None = 0
        for step in spelled.split("/")[1:]:
            if (path := self.numbers.get((path, step))) is None:
                return None
        return path

    def under(self, path: int | None) -> list[bool]:
        """Of each path, whether it is the given one or below it; None is above all."""
        found: list[bool] = []
        for k, above in enumerate(self.above):
            found.append(path is None or k == path or above >= 0 and found[above])
        return found


@dataclass
class Tag:
    """What the attributes of a tag say: its generalised classes and id, the whole names of class and role, all words, those of each name that tells of no state (with whether it is an id), and whether it is hidden."""

    classes: list[str] = field(default_factory=list)
    id: str = ""
    names: set[str] = field(default_factory=set)
    words: set[str] = field(default_factory=set)
    parts: list[tuple[frozenset[str], bool]] = field(default_factory=list)
    hidden: bool = False


def _general(name: str) -> str:
    """A class or id with its numbers folded, fit to be written in a path."""
    return re.sub(r"\d+", "#", name.lower()).replace("/", "|")


def _described(rest: str) -> Tag:
    found = Tag()
    if "=" in rest or "hidden" in rest.lower():
        for m in _ATTRIBUTE.finditer(rest):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("class", "id", "role"):
                if kind != "id":
                    found.names.update(value.lower().split())
                for name in value.split():
                    words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
                    found.words.update(words)
                    if STATES.isdisjoint(words) and not MARKED.isdisjoint(words):
                        found.parts.append((words, kind == "id"))
                if kind == "class":
                    found.classes = sorted(set(map(_general, value.split())))
                elif kind == "id":
                    found.id = _general(value)
            found.hidden |= kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and bool(_UNSEEN.search(value))
    return found


def _apart(tag: str, said: Tag, inside: bool) -> tuple[int, bool]:
    """Whether an element is no part of an article, as Node has it, and whether its names say other things, too; inside: it is in an article or main element.

    Only names that say nothing but what a reader, sponsor or lawyer wrote decide (an id only of readers'); other marked
    names make a doubt, which the page or its host resolves. In an article, ids that say
    other things are made from headings, and headings, paragraphs, parts of tables and lists and what stands
    within a sentence have names of any kind.
    """
    if said.hidden or tag in APART:
        return 2, False
    if tag in ("html", "body", "main"):
        return 0, False
    if tag == "article":  # a comment or teaser may be an article, but words like comments-open don't make one
        return 2 * (not MARKED.isdisjoint(said.names & said.words)), False
    if not inside and (tag == "header" or "header" in said.words) and said.words.isdisjoint(OWN_HEADER):
        return 2, False
    fixed, doubt, vague = tag in FIXED or tag not in BLOCK, 0, True
    for words, is_id in said.parts:
        plain = words <= MARKED | FILLERS
        if fixed and (inside or is_id or not plain) or is_id and inside and not plain:
            continue
        if not is_id and not READERS_WORDS.isdisjoint(words) or plain and not (READERS_WORDS if is_id else OTHERS_WORDS).isdisjoint(words):
            return 2, False
        doubt, vague = int(tag in BLOCK), vague and not plain
    return doubt, vague


class _Open:
    """The elements that are open, with the places of each tag's and of the block elements among them."""

    def __init__(self):
        self.nodes, self.tags, self.places, self.blocks = [0], [""], {}, []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def place(self, tag: str) -> int:
        """Where the innermost open element of a tag is; 0 if none is."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def parse(text: str) -> Page:
    """The blocks of a page and the elements around them, however badly it is closed.

    A block ends wherever a block element starts or ends. Paragraphs end at the next
    block element, list items and table cells at the next of their kind, and a closing
    tag ends all that was opened since its opening one; without one it is ignored. Time
    grows with the page's length, however deep its elements are.
    """
    page, open_, parts, links, last = Page(), _Open(), [], 0, 0
    nodes = page.nodes

    def flush() -> None:
        nonlocal links
        if parts and (joined := " ".join("".join(parts).split())) and nodes[open_.nodes[-1]].apart < 2:
            page.blocks.append((open_.nodes[-1], joined, links))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            shown = entities.unescape(raw) if "&" in raw else raw
            parts.append(shown)
            if "a" in open_.tags[-3:]:
                links += len(shown)

    for m in _TOKEN.finditer(text):
        add(text[last : m.start()])
        last = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        block = tag in BLOCK
        if m["close"]:
            at, outer = open_.place(tag), open_.blocks[-1] if open_.blocks else 0
            if at and (block or at > outer):
                if outer >= at or nodes[open_.nodes[-1]].apart != nodes[open_.nodes[at - 1]].apart:
                    flush()
                open_.cut(at)
            elif block:  # a stray end still parts what stands on its two sides
                flush()
            continue
        if tag not in IN_HEAD and "head" in open_.tags[1:3]:  # a head need not be closed
            flush()
            open_.cut(open_.tags.index("head", 1, 3))
        said = _described(m["rest"])
        above = nodes[open_.nodes[-1]]
        own_apart, vague = _apart(tag, said, above.whole > 0)
        if block or max(above.apart, own_apart) != above.apart:
            flush()
        if block:
            for at in reversed(open_.blocks):
                own = open_.tags[at]
                if own == "p" or tag in ENDED_BY.get(own, ()):
                    open_.cut(at)
                    break
                if own not in ENDED_BY:
                    break
            above = nodes[open_.nodes[-1]]
        if tag in VOID or not block and _CLOSED.search(m["rest"]):
            continue
        k, box = len(nodes), tag in CONTAINER
        path = page.step(above.path, tag, ".".join([tag, *said.classes])) if box or tag == "html" else above.path
        within = (k if tag in WHOLE else above.whole, k if tag in LIST else above.list, k if tag in TITLE else above.title, k if tag in HEADING else above.heading, k if box else above.container)
        nodes.append(Node(tag, open_.nodes[-1], path, max(above.apart, own_apart), *within))
        open_.push(k, tag)
        if own_apart == 1 and above.apart < 2:
            page.named[k] = ".".join([tag, *said.classes]) + f"#{said.id}" * bool(said.id)
            if vague:
                page.vague.add(k)
    add(text[last:])
    flush()
    _drop_menus(page)
    return page


def _drop_menus(page: Page) -> None:
    """Take out lists of nothing but links, unless they are in an article or main element."""
    linked: dict[int, list[bool]] = {}
    for node, text, links in page.blocks:
        if (at := page.nodes[node].list) and not page.nodes[at].whole:
            linked.setdefault(at, []).append(links >= len(text))
    menus = {at for at, found in linked.items() if len(found) > 1 and all(found)}
    if menus:
        page.blocks = [x for x in page.blocks if page.nodes[x[0]].list not in menus]


def _value(text: str, links: int) -> int:
    """How much running text a block has; words in links count against it."""
    return max(0, len(text) - 3 * links)


def _running(page: Page, block: tuple[int, str, int]) -> bool:
    """Whether a block is running text: no heading, few links, and a sentence's end or some length."""
    node, text, links = block
    return 3 * links < len(text) and not page.nodes[node].heading and (len(text) >= 80 or len(text) >= 20 and text.rstrip(CLOSING)[-1:] in ENDS)


def _held(page: Page, amounts: list[int]) -> list[int]:
    """Of each node, the sum of the amounts (one for each block) in it."""
    held = [0] * len(page.nodes)
    for (node, _, _), n in zip(page.blocks, amounts):
        held[node] += n
    for k in range(len(held) - 1, 0, -1):
        held[page.nodes[k].parent] += held[k]
    return held


def _without(page: Page, gone: set[int]) -> list[tuple[int, str, int]]:
    """The blocks that are in none of these elements."""
    if not gone:
        return page.blocks
    out = [False]
    for k, n in enumerate(page.nodes[1:], 1):
        out.append(k in gone or out[n.parent])
    return [x for x in page.blocks if not out[x[0]]]


def set_apart(page: Page) -> set[int]:
    """The elements that their names set apart: all named ones but those that hold most of the running text, and all that is in article or main elements."""
    if not page.named:
        return set()
    held = _held(page, [_value(text, links) for _, text, links in page.blocks])
    in_whole = [int(page.nodes[n].whole > 0) for n, _, _ in page.blocks]
    count = _held(page, in_whole)
    return {k for k in page.named if 2 * held[k] <= held[0] or count[k] < sum(in_whole)}


class Sums:
    """Of each path: its score, and how much text, how many blocks, running ones and headings its elements hold.

    In a score, the nearest container has all of a block, those further out ever less; but
    an article or main element has all that is inside, and a plain section's text is
    all the container's that it is a section of.
    """

    def __init__(self, page: Page, blocks: list[tuple[int, str, int]]):
        n, self.depth = len(page.steps), [0]
        for above in page.above[1:]:
            self.depth.append(self.depth[above] + 1)
        self.text, self.blocks, self.running, self.headings, self.score = ([0] * n for _ in range(5))
        share = [0.0] * n
        for block in blocks:
            node = page.nodes[block[0]]
            value = _value(block[1], block[2])
            self.text[node.path] += value
            share[node.path] += value
            self.blocks[node.path] += 1
            self.running[node.path] += _running(page, block)
            self.headings[node.path] += node.heading > 0
        for k in range(n - 1, 0, -1):
            above = page.above[k]
            for sums in (self.text, self.blocks, self.running, self.headings):
                sums[above] += sums[k]
            if page.tags[k] in CONTAINER:
                self.score[k] = 1.2 * self.text[k] if page.tags[k] in WHOLE else share[k]
                share[above] += share[k] if page.steps[k] == "section" and page.tags[above] != "body" else share[k] / 2

    def best(self) -> int | None:
        """The path of the highest score above 0; of equal ones the innermost, which comes last, of one depth the first."""
        top = max(self.score, default=0)
        return None if top <= 0 else self._first([k for k, x in enumerate(self.score) if x == top])

    def _first(self, equal: list[int]) -> int:
        return equal[0] if len(equal) == 1 else min(equal, key=lambda k: (-self.depth[k], k))


def widened(page: Page, sums: Sums, path: int | None) -> int | None:
    """The path of the outermost container around a path that adds running text, short of the body.

    It goes on through containers that add nothing, and ends at one that adds other things alone,
    as it does at an article or main element.
    """
    at = path
    while at and page.tags[at] not in WHOLE:
        at = page.above[at]
        if at <= 0 or page.tags[at] == "body":
            break
        if page.tags[at] not in CONTAINER:
            continue
        if sums.running[at] > sums.running[path]:
            path = at
        elif sums.blocks[at] - sums.blocks[path] > sums.headings[at] - sums.headings[path]:
            break
    return path


def text_under(page: Page, blocks: list[tuple[int, str, int]], path: int | None) -> str:
    """The blocks inside the elements of a path, in page order, by line; of no path, all blocks.

    A title (h1) above the first of these elements belongs to them if it stands right in a
    container around it, other than the body.
    """
    under, around = page.under(path), set()
    k = next((k for k, n in enumerate(page.nodes) if k and n.path == path), 0)
    while k > 0:
        around.add(k)
        k = page.nodes[k].parent
    inside = [under[page.nodes[n].path] for n, _, _ in blocks]
    first = inside.index(True) if True in inside else 0

    def is_title(node: Node) -> bool:
        return bool(node.title) and node.container in around and page.nodes[node.container].tag != "body"

    return "\n".join(text for k, (n, text, _) in enumerate(blocks) if inside[k] or k < first and is_title(page.nodes[n]))


class Read:
    """A page without what its names set apart, and the path that is best by itself."""

    def __init__(self, html: str | None):
        self.page = parse(html or "")
        self.gone = set_apart(self.page)
        self.sums = Sums(self.page, _without(self.page, self.gone))
        self.best = self.sums.best()
        self.own = widened(self.page, self.sums, self.best)

    def doubtful(self, path: int | None) -> dict[int, list[tuple[int, str, int]]]:
        """The blocks of each element that is set apart by its name alone though it lies in an article or main element or under the path."""
        page, under = self.page, self.page.under(path)
        found = {k: [] for k in sorted(self.gone) if page.nodes[k].whole or path is not None and under[page.nodes[k].path]}
        if found:
            mark = [0]
            for k, n in enumerate(page.nodes[1:], 1):
                mark.append(k if k in self.gone else mark[n.parent])
            for block in page.blocks:
                if mark[block[0]] in found:
                    found[mark[block[0]]].append(block)
        return found

    def fits(self, element: int, blocks: list[tuple[int, str, int]]) -> bool:
        """Whether what a doubtful element holds may be an article's: running text for the most part; of one whose names say other things, too, all but links."""
        if element in self.page.vague:
            return 3 * sum(x[2] for x in blocks) < sum(len(x[1]) for x in blocks)
        running = sum(len(x[1]) for x in blocks if _running(self.page, x))
        return running > 0 and 2 * running >= sum(len(x[1]) for x in blocks)


def vote(html: str | None) -> tuple[str | None, float, list[tuple[str, int, bool]]]:
    """The page's path and its score; and of each kind of doubtful element (tag, classes and id) a hash of its text, and whether that fits."""
    read = Read(html)
    kinds: dict[str, tuple[int, list[tuple[int, str, int]]]] = {}
    for k, blocks in read.doubtful(read.own).items():
        kinds.setdefault(read.page.named[k], (k, []))[1].extend(blocks)
    told = [(kind, xxhash.xxh64_intdigest("\n".join(x[1] for x in blocks)) >> 1, read.fits(k, blocks)) for kind, (k, blocks) in kinds.items()]
    return (None if read.own is None else read.page.spelled(read.own)), (0.0 if read.own is None else float(read.sums.score[read.own])), told


def extract(html: str | None, agreed: str | None, kept=(), dropped=()) -> str:
    """The text under the host's path, if it holds at least half of what the page's own best does; else under that.

    kept: kinds of doubtful elements that belong to the text, as what they hold differs over
    the host's pages; dropped: kinds that recur. Of other kinds, those in an article or main
    element belong to it if they fit one.
    """
    read = Read(html)
    path, agreed_path, text = read.own, read.page.number(agreed), read.sums.text
    if path is not None and agreed_path is not None and 2 * text[agreed_path] >= text[path]:
        path = agreed_path
    back = set()
    for k, blocks in read.doubtful(path).items():
        kind = read.page.named[k]
        if kind in kept or kind not in dropped and read.page.nodes[k].whole and read.fits(k, blocks):
            back.add(k)
    return text_under(read.page, _without(read.page, read.gone - back), path)


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


#: The table of what hosts agree on is broadcast only if it has at most so many characters, too.
BROADCAST_CHARS = 32 << 20


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row (id, url, text, n_chars) for each row of pages.

    Each page votes for its best container's path (tags and classes, digits folded), widened
    to the containers around it that add running text;
    a host's path is the one with most votes, then with most text. Pages also tell what
    stands in those elements of their article whose names are doubtful (as
    notice-period or search-tips): a kind whose text recurs over the host's pages is no
    part of the articles, one that holds different text on most of them, running or under a name that says other things, too, is. Only
    votes are grouped, so a host of any size is no one's task. Pages without a host in
    their url follow their own best path. A null or empty html gives '', as does a page
    without text; repeated rows are all returned and vote each time; a very long or deeply
    nested page takes time and memory in proportion to its length. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    said = pa.struct({"path": pa.string(), "score": pa.float64(), "told": pa.list_(pa.struct({"kind": pa.string(), "hash": pa.int64(), "fits": pa.bool_()}))})

    @F.arrow_udf("struct<path: string, score: double, told: array<struct<kind: string, hash: bigint, fits: boolean>>>")
    @lean
    def voted(html: pa.Array) -> pa.Array:
        found = (vote(x.as_py()) for x in html)
        return pa.array([{"path": p, "score": s, "told": [dict(zip(("kind", "hash", "fits"), t)) for t in told]} for p, s, told in found], said)

    @F.arrow_udf("string")
    @lean
    def extracted(html: pa.Array, path: pa.Array, kept: pa.Array, dropped: pa.Array) -> pa.Array:
        lists = [[set(y.as_py() or ()) for y in x] for x in (kept, dropped)]
        return pa.array([extract(x.as_py(), p.as_py(), k, d) for x, p, k, d in zip(html, path, *lists)], pa.string())

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    votes = cut(rows.where("host IS NOT NULL").select("host", voted("html").alias("v")).select("host", "v.*"))
    counts = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score")).cast("bigint").alias("total"))
    paths = counts.groupBy("host").agg(F.max(F.struct("n", "total", "path")).getField("path").alias("path"))
    kinds = votes.select("host", F.explode("told").alias("t")).groupBy("host", "t.kind").agg(F.count("*").alias("n"), F.count_distinct("t.hash").alias("texts"), F.count_if("t.fits").alias("fit"))
    differs = (2 * F.col("texts") > F.col("n")) & (2 * F.col("fit") > F.col("n"))
    judged = kinds.where("n > 1").groupBy("host").agg(F.collect_list(F.when(differs, F.col("kind"))).alias("kept"), F.collect_list(F.when(~differs, F.col("kind"))).alias("dropped"))
    agreed = cut(paths.join(judged, "host", "left"))
    chars = F.octet_length("host") + F.octet_length("path") + sum(F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) for c in ("kept", "dropped"))
    size = agreed.agg(F.count("*"), F.sum(chars)).first()
    small = (size[1] or 0) <= BROADCAST_CHARS
    found = join_counted(rows, agreed, "host", rows=size[0] if small else BROADCAST_ROWS + 1).select("id", "url", extracted("html", "path", "kept", "dropped").alias("text"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
