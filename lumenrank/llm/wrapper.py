"""HTML extraction by wrapper induction over the pages of a host.

Every page is parsed once to a tree of slots: block elements, a run of neighbours of one kind being one slot. The distinct
trees of a layout (pages of a host with the same tree of content-holding elements) are merged to a template by
simple tree matching: the best order-preserving match of nodes of equal tags, in which equal classes and ids (without their digits)
weigh more but decide nothing; what has no match comes into the template beside its neighbour. Then every page is aligned to
the template, again by simple tree matching. A text that most pages with a node have there is constant, an
element of constant texts only is template, and elements that vary are content. Pages of a layout that too few share
are aligned to the template of the whole host.

A page with article or main elements has its content there. Menus, headers, footers, sidebars, forms, adverts, notices and
comments vary too: they go by tags, roles and whole names. Words within a name count only where no template has the element.

Scale: shapes are counted in each task and then summed; partial templates of some hundred shapes each are merged
eight at a time; texts are counted as 64-bit hashes at template nodes. So no task holds the pages of a host, however many
there are; a page that occurs n times counts 1/n each time. Wrappers are written as a table, so Spark broadcasts them only if
they are small and otherwise joins by host, where AQE can split a host with very many pages.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import bounded, materialize, slices

#: A slot is template if so much of the pages that have it have the same text there.
CONSTANT = 0.8
#: Pages that must have a slot before it can be template.
PAGES = 4
#: Levels of a tree that are aligned; what lies deeper is the text of its ancestor there.
DEPTH = 100
#: Products of two lists of children beyond which rows of the table are filled by numpy; the matches are the same.
WIDEST = 20_000
#: Nodes of a template, at most; those that fewest pages have go, and their elements count as not aligned.
MOST_NODES = 2_000
#: Shapes of a partial template, about; alignments and hosts that a worker remembers.
SHAPES, KEPT_SHAPES, KEPT_HOSTS = 500, 5_000, 1_000
GONE, WEAK, STAYS = 2, 1, 0
INSIDE, PROSE, DOUBTED = 1, 2, 4
#: Elements that can hold content, for layouts.
HOLDERS = frozenset("article main section div td body html".split())

# Elements and names that never hold main text.
DROP_TAGS = frozenset("script style noscript template head title nav footer aside form button select option input textarea label iframe object svg canvas audio video dialog menu".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "disqus replies respond share sharing social related recommended recommendations widget pagination pager search skip toolbar".split()
)
#: Names that hold no main text within an article either; there they count for containers only, and as whole class names or ids.
DROP_INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie-notice cookie-banner consent newsletter subscribe signup sidebar menu nav navigation "
    "breadcrumb breadcrumbs comment comments comment-list disqus replies respond share sharing social related recommended recommendations pagination".split()
)
CONTAINERS = frozenset("div section ul ol dl table aside span".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK_TAGS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th body html select article section div main".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, tag name or "", attributes, place after) of each tag, comment and declaration; "/name" ends an element.

    One pass: a quote without a partner is an ordinary character, and a tag without an end takes the rest
    of the page. The receiver may send a place to go on from.
    """
    at, end, unpaired = 0, len(page), set()
    while at < end:
        m = _OPEN.search(page, at)
        if not m:
            yield page[at:], "", "", end
            return
        text, start = page[at : m.start()], m.end()
        if page.startswith("!--", start):
            close = page.find("-->", start + 3)
            at = end if close < 0 else close + 3
            yield text, "", "", at
            continue
        name = _TAG_NAME.match(page, start)
        stop = _STOP.search(page, name.end() if name else start)
        while stop and stop.group() != ">":
            quote, after = stop.group(), stop.end()
            if name and quote not in unpaired:
                close = page.find(quote, after)
                if close < 0:
                    unpaired.add(quote)
                else:
                    after = close + 1
            stop = _STOP.search(page, after)
        at = stop.end() if stop else end
        if name and stop:
            jump = yield text, name.group().lower(), page[name.end() : stop.start()], at
        else:
            jump = yield text, "", "", at
        if jump is not None:
            at = jump
            yield "", "", "", at


def parse(page: str) -> Node:
    """A DOM tree; text children are strings, character references decoded. Unclosed and stray tags are tolerated."""
    root = Node("#", {})
    stack, open_ = [root], Counter()
    low = ""
    tokens = _tokens(page)
    for text, tag, raw, at in tokens:
        if text:
            stack[-1].children.append(html_lib.unescape(text) if "&" in text else text)
        if not tag:
            continue
        if tag[0] == "/":
            if open_[tag[1:]]:
                _cut(stack, open_, next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag[1:]))
            continue
        closes = {"p"} if tag in CLOSES_P else SAME_CLOSES.get(tag, ())
        if any(open_[x] for x in closes):
            _close(stack, open_, closes)
        attrs = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW_TAGS:
            low = low or page.lower()  # as long as the page, but for a few capitals: then the plain search is used
            close = low.find(f"</{tag}", at) if len(low) == len(page) else page.find(f"</{tag}", at)
            stop = page.find(">", close) if close >= 0 else -1
            tokens.send(len(page) if stop < 0 else stop + 1)
        elif tag not in VOID_TAGS:
            stack.append(node)
            open_[tag] += 1
    return root


def _cut(stack: list[Node], open_: Counter, i: int) -> None:
    open_.subtract(n.tag for n in stack[i:])
    del stack[i:]


def _close(stack: list[Node], open_: Counter, tags: set[str]) -> None:
    """End an open element of ``tags``, unless a scope element stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            _cut(stack, open_, i)
            return
        if stack[i].tag in SCOPES:
            return


def fate(node: Node, inside: bool = False) -> int:
    """Whether an element goes (``GONE``), goes unless its text is seen to vary (``WEAK``), or stays.

    Menus, headers, footers, sidebars, forms, scripts, styles and hidden elements go by their tags and roles, and adverts, notices and comment lists by
    whole class names or ids. Words within a name say less: they count outside articles only, and an alignment with other pages overrules them.
    """
    if node.tag in DROP_TAGS or node.tag == "header" and not inside:
        return GONE
    a = node.attrs
    if not a:
        return STAYS
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower():
        return GONE
    if (a.get("role") or "").lower() in DROP_ROLES:
        return GONE
    if node.tag in MAIN_TAGS or node.tag in ("body", "html"):
        return STAYS
    given = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
    if node.tag in CONTAINERS and not DROP_INSIDE.isdisjoint(given.split()):
        return GONE
    if inside:
        return STAYS
    names = set(_NAME.findall(given))
    return WEAK if names & DROP_NAMES or "header" in names else STAYS


class Slot:
    """A node for alignment: a block element, or a run of neighbours of one tag and mark. Inline elements are part of their block."""

    __slots__ = ("children", "mark", "n", "tag")

    def __init__(self, tag: str, mark: str = "", n: float = 0.0, children: list[Slot] | None = None):
        self.tag, self.mark, self.n, self.children = tag, mark, n, children if children is not None else []

    def plain(self, weights: bool = True) -> list:
        return [self.tag, self.mark, *([round(self.n, 6)] if weights else []), [c.plain(weights) for c in self.children]]

    @classmethod
    def of(cls, plain: list) -> Slot:
        return cls(plain[0], plain[1], plain[2] if len(plain) == 4 else 0.0, [cls.of(c) for c in plain[-1]])

    def all(self) -> list[Slot]:
        """Slots in order, parents first."""
        out, todo = [], [self]
        while todo:
            s = todo.pop()
            out.append(s)
            todo += reversed(s.children)
        return out


class Piece(NamedTuple):
    """A block's text, the slot and the element that it is in, and flags: within an article or main element (``INSIDE``), directly in an article's flow (``PROSE``), names speak against it (``DOUBTED``)."""

    slot: int
    element: int
    flags: int
    text: str


def mark(node: Node) -> str:
    """The element's first class or its id, without digits: a number is a page's own."""
    given = (node.attrs.get("class") or "").split()
    return re.sub(r"\d+", "", given[0] if given else node.attrs.get("id") or "")


def read(page: str) -> tuple[Slot, list[Piece]]:
    """The slots of a page and its texts in page order, without what goes by tags, roles and whole names."""
    root = Slot("#")
    found: list[tuple[Slot, int, int, str]] = []
    now: list[str] = []
    elements = 0

    def flush(at: tuple[Slot, int, int, int]) -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            found.append((*at[:3], text))

    tree = parse(page)
    todo: list[list] = [[tree, 0, (root, 0, 0, 0), True]]
    while todo:
        node, i, at, block = frame = todo[-1]
        if i == len(node.children):
            if block:
                flush(at)
            todo.pop()
            continue
        frame[1] = i + 1
        child = node.children[i]
        if isinstance(child, str):
            now.append(child)
            continue
        slot, _, flags, depth = at
        is_block = child.tag in BLOCK_TAGS
        if is_block:
            flush(at)
        what = fate(child, bool(flags & INSIDE))
        if what == GONE or child.tag in VOID_TAGS:
            continue
        if is_block or what == WEAK or child.tag in MAIN_TAGS:
            elements += 1
            if depth < DEPTH and is_block:
                own = mark(child)
                last = slot.children[-1] if slot.children else None
                if last is None or last.tag != child.tag or last.mark != own:
                    last = Slot(child.tag, own)
                    slot.children.append(last)
                slot = last
            flags |= INSIDE * (child.tag in MAIN_TAGS) | PROSE * (child.tag == "article") | DOUBTED * (what == WEAK)
            if child.tag in ("div", "section"):
                flags &= ~PROSE
            at = (slot, elements if is_block else at[1], flags, depth + 1)
        todo.append([child, 0, at, is_block])
    order = {id(s): k for k, s in enumerate(root.all())}
    return root, [Piece(order[id(s)], *rest) for s, *rest in found]


def layout(root: Slot) -> int:
    """A name for the tree of content-holding elements of a page."""
    paths, todo = set(), [(root, "")]
    while todo:
        slot, path = todo.pop()
        path = f"{path}/{slot.tag}.{slot.mark}"
        paths.add(path)
        todo += [(c, path) for c in slot.children if c.tag in HOLDERS]
    return _hash(*sorted(paths))


def tree_match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the weight of the best order-preserving match of nodes of equal tags, and its pairs.

    A pair weighs one, and two more where both have the same mark.
    """
    if a.tag != b.tag:
        return 0, []
    own = 3 if a.mark and a.mark == b.mark else 1
    n, m = len(a.children), len(b.children)
    if not n or not m:
        return own, [(a, b)]
    if n * m > WIDEST:
        return _wide(a, b, own)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        x, above, here = a.children[i - 1], best[i - 1], best[i]
        for j in range(1, m + 1):
            top = above[j] if above[j] >= here[j - 1] else here[j - 1]
            if x.tag == b.children[j - 1].tag:
                pairs[i, j] = tree_match(x, b.children[j - 1])
                top = max(top, above[j - 1] + pairs[i, j][0])
            here[j] = top
    out, i, j = [(a, b)], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out += pairs[i, j][1]
            i, j = i - 1, j - 1
    return best[n][m] + own, out


def _wide(a: Slot, b: Slot, own: int) -> tuple[int, list[tuple[Slot, Slot]]]:
    """What ``tree_match`` gives, for long lists of children: whole rows of its table at once, a weight for every two kinds of subtrees, and two bits kept of each cell."""
    kinds: dict[str, int] = {}
    left, right = [[kinds.setdefault(json.dumps(c.plain(False)), len(kinds)) for c in s.children] for s in (a, b)]
    repeated = {k for k, n in Counter(left).items() if n > 1}
    found, places = np.unique(right, return_inverse=True)
    samples = dict(zip(right, b.children))
    known: dict[int, np.ndarray] = {}
    above = np.zeros(len(right) + 1, np.int64)
    ups, lefts = [], []
    for kind, x in zip(left, a.children):
        weights = known.get(kind)
        if weights is None:
            weights = np.array([tree_match(x, samples[k])[0] for k in found.tolist()], np.int32)
            if kind in repeated:
                known[kind] = weights
        here = above.copy()
        np.maximum(here[1:], above[:-1] + weights[places], out=here[1:])
        np.maximum.accumulate(here, out=here)
        ups.append(np.packbits(here[1:] == above[1:]))
        lefts.append(np.packbits(here[1:] == here[:-1]))
        above = here
    out, i, j = [(a, b)], len(left), len(right)
    while i and j:
        byte, bit = j - 1 >> 3, 7 - (j - 1 & 7)
        if ups[i - 1][byte] >> bit & 1:
            i -= 1
        elif lefts[i - 1][byte] >> bit & 1:
            j -= 1
        else:
            out += tree_match(a.children[i - 1], b.children[j - 1])[1]
            i, j = i - 1, j - 1
    return int(above[-1]) + own, out


def _greedy(a: Slot, b: Slot, own: int) -> tuple[int, list[tuple[Slot, Slot]]]:
    """A match in one pass from left to right: no better than ``tree_match``, which tests compare with it."""
    places: dict[tuple[str, str], list[int]] = {}
    for j, y in enumerate(b.children):
        places.setdefault((y.tag, y.mark), []).append(j)
    weight, out, low = own, [(a, b)], 0
    for x in a.children:
        held = places.get((x.tag, x.mark), [])
        k = bisect_left(held, low)
        if k < len(held):
            w, pairs = tree_match(x, b.children[held[k]])
            weight, low, out = weight + w, held[k] + 1, out + pairs
    return weight, out


def merge(template: Slot, other: Slot) -> Slot:
    """Align two trees and put the second into the first: matched nodes add their pages up, the others come in after the neighbour on their left."""
    matched = {id(y): x for x, y in tree_match(template, other)[1]}
    todo = [(template, other)]
    while todo:
        x, y = todo.pop()
        x.n += y.n
        place = {id(c): k for k, c in enumerate(x.children)}
        after: dict[int, list[Slot]] = {}
        left = -1
        for c in y.children:
            if id(c) in matched:
                left = place[id(matched[id(c)])]
                todo.append((matched[id(c)], c))
            else:
                after.setdefault(left, []).append(c)
        if after:
            x.children = after.get(-1, []) + [s for k, c in enumerate(x.children) for s in (c, *after.get(k, []))]
    return template


def pruned(template: Slot, most: int) -> Slot:
    """At most so many nodes: those that fewest pages have go, with what is below them."""
    nodes = template.all()
    if len(nodes) > most:
        least = sorted((s.n for s in nodes), reverse=True)[most]
        for s in nodes:
            s.children = [c for c in s.children if c.n > least]
    return template


def fold(shapes: list[tuple[str, float]]) -> Slot:
    """The template of shapes and the number of pages that have each; the most frequent comes first."""
    template = None
    for shape, n in sorted(shapes, key=lambda s: (-s[1], s[0])):
        tree = Slot.of(json.loads(shape))
        for s in tree.all():
            s.n = n
        template = tree if template is None else pruned(merge(template, tree), MOST_NODES)
    return template


def align(template: Slot, root: Slot) -> list[int]:
    """For each slot of a page its node in the template, or -1."""
    number = {id(s): k for k, s in enumerate(template.all())}
    place = {id(s): k for k, s in enumerate(root.all())}
    out = [-1] * len(place)
    for x, y in tree_match(template, root)[1]:
        out[place[id(y)]] = number[id(x)]
    return out


class Aligner:
    """Alignments of shapes to the templates of one host, each made once."""

    def __init__(self, templates: dict[str, list]):
        self.templates = {k: Slot.of(t) for k, t in templates.items()}
        self.known: dict[tuple[str, str], list[int]] = {}

    def __call__(self, layout: str, shape: str) -> list[int]:
        got = self.known.get((layout, shape))
        if got is None:
            if len(self.known) >= KEPT_SHAPES:
                self.known.clear()
            got = self.known[layout, shape] = align(self.templates[layout], Slot.of(json.loads(shape)))
        return got


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shape_of(root: Slot) -> str:
    return json.dumps(root.plain(False), separators=(",", ":"))


def seen(aligner: Aligner, layout: str, shape: str, slots: list[int], texts: list[str]) -> set[tuple[str, int, int]]:
    """(layout, node, value) of a page: hashes of the texts at aligned nodes, and value 0 for the node itself; for its layout and, as layout "0", for its host."""
    out = set()
    for key in (layout, "0"):
        if key in aligner.templates:
            nodes = aligner(key, shape)
            for slot, text in zip(slots, texts):
                if nodes[slot] >= 0:
                    out |= {(key, nodes[slot], _hash(text) or 1), (key, nodes[slot], 0)}
    return out


def constants(counts: dict[tuple[str, int, int], float]) -> tuple[dict[str, list[int]], dict[str, list[list[int]]]]:
    """From counts of ``seen``: by layout the nodes that enough pages have, and (node, value) of the texts that are the same on most of them."""
    total = {(k, node): n for (k, node, value), n in counts.items() if value == 0 and n > PAGES - 1e-3}
    nodes: dict[str, list[int]] = {}
    fixed: dict[str, list[list[int]]] = {}
    for k, node in sorted(total):
        nodes.setdefault(k, []).append(node)
    for (k, node, value), n in sorted(counts.items()):
        if value and (k, node) in total and n >= CONSTANT * total[k, node] - 1e-3:
            fixed.setdefault(k, []).append([node, value])
    return nodes, fixed


class Wrapper:
    """What is known of a host: a template for each layout that enough pages have and, as "0", for all of them."""

    def __init__(self, known: dict):
        self.align = Aligner(known.get("templates", {}))
        self.nodes = {k: set(v) for k, v in known.get("nodes", {}).items()}
        self.fixed = {k: {tuple(x) for x in v} for k, v in known.get("fixed", {}).items()}
        self.texts = {k: {x[1] for x in v} for k, v in self.fixed.items()}

    def text(self, layout: str, shape: str, pieces: list[Piece]) -> str:
        """The main text: elements that vary, of the article and main elements if the page has any.

        An element whose texts are all constant is template, but for paragraphs, headings and lists directly in an article, which are its text on whatever pages
        they are. An article or main element of which nothing varies keeps its text, as copies of one article do; a page without one is then
        empty. Names count for elements that no template has.
        """
        key = layout if layout in self.align.templates else "0"
        nodes = self.align(key, shape) if key in self.align.templates else None
        fixed, known, moved = self.fixed.get(key, set()), self.nodes.get(key, set()), self.texts.get(key, set())
        own = [p for p in pieces if p.flags & INSIDE]
        chosen = own or pieces
        if nodes is not None:
            values = [_hash(p.text) or 1 for p in chosen]
            # What too few pages have in this place is template if it is constant in another: neighbours may change places.
            same = [not p.flags & PROSE and ((nodes[p.slot], v) in fixed or nodes[p.slot] not in known and v in moved) for p, v in zip(chosen, values)]
            varying = {p.element for p, s in zip(chosen, same) if not s}
            kept = [p for p in chosen if p.element in varying]
            chosen = kept if kept or not own else chosen
            chosen = [p for p in chosen if not p.flags & DOUBTED or nodes[p.slot] in known]
        else:
            chosen = [p for p in chosen if not p.flags & DOUBTED]
        return "\n".join(p.text for p in chosen)


def induce(pages: list[str]) -> dict:
    """The wrapper of a host from its distinct pages, as ``Wrapper`` takes it."""
    parsed = [read(p) for p in dict.fromkeys(pages)]
    shapes: dict[str, Counter] = {"0": Counter()}
    for root, _ in parsed:
        shapes["0"][shape_of(root)] += 1
        shapes.setdefault(str(layout(root)), Counter())[shape_of(root)] += 1
    templates = {k: fold(list(c.items())).plain() for k, c in shapes.items() if c.total() >= PAGES}
    aligner = Aligner(templates)
    counts = Counter(x for root, pieces in parsed for x in seen(aligner, str(layout(root)), shape_of(root), [p.slot for p in pieces], [p.text for p in pieces]))
    nodes, fixed = constants(counts)
    return {"templates": templates, "nodes": nodes, "fixed": fixed}


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of one page: blocks joined by line feeds, empty if there are none."""
    if not page:
        return ""
    root, pieces = read(page)
    return Wrapper(wrapper or {}).text(str(layout(root)), shape_of(root), pieces)


def host_of(url):
    """Lower-case host of a url column; null or odd urls have the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _parsed(rows: DataFrame) -> DataFrame:
    """(page_id, url, host, h, layout, shape, slots, elements, flags, texts) of pages, in the shared folder: every page is parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8_000_000):
            layouts, shapes, columns = [], [], ([], [], [], [])
            for page in batch.column("html").to_pylist():
                root, pieces = read(page or "")
                layouts.append(str(layout(root)))
                shapes.append(shape_of(root))
                for column, values in zip(columns, zip(*pieces) if pieces else ((), (), (), ())):
                    column.append(values)
            kinds = (pa.int32(), pa.int32(), pa.int8(), pa.string())
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]
            held = [batch.column(c) for c in ("page_id", "url", "host", "h")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(layouts), pa.array(shapes), *arrays], ["page_id", "url", "host", "h", "layout", "shape", "slots", "elements", "flags", "texts"])

    keys = rows.select("page_id", "url", "host", "h").schema.fields
    more = T.StructType.fromDDL("layout string, shape string, slots array<int>, elements array<int>, flags array<tinyint>, texts array<string>").fields
    return materialize(rows.select("page_id", "url", "host", "h", "html").mapInArrow(run, T.StructType([*keys, *more])), "parsed-pages")


def _templates(teaching: DataFrame) -> DataFrame:
    """(host, layout, template) where at least ``PAGES`` pages share a layout, and as layout "0" for the host: partial templates of some shapes each, merged in rounds."""
    counted = teaching.groupBy("host", "layout", "shape").agg(F.round(F.sum("w"), 6).alias("n"))
    shapes = materialize(counted, "shapes")
    both = shapes.unionByName(shapes.withColumn("layout", F.lit("0"))).groupBy("host", "layout", "shape").agg(F.sum("n").alias("n"))
    sizes = both.groupBy("host", "layout").agg(F.round(F.sum("n"), 3).alias("pages"), F.count(F.lit(1)).alias("k")).where(F.col("pages") >= PAGES)
    rows = both.join(sizes, ["host", "layout"])
    part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("k") / SHAPES)).alias("part")
    first = rows.select("host", "layout", part, F.struct(F.col("shape").alias("tree"), "n").alias("s"))

    def folded(key: tuple, table: pa.Table) -> pa.Table:
        shapes = [(x["tree"], x["n"]) for x in table.column("s").to_pylist()]
        return _row(key, fold(shapes))

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        trees = sorted((Slot.of(json.loads(t)) for t in table.column("template").to_pylist()), key=lambda t: (-t.n, json.dumps(t.plain())))
        return _row(key, functools.reduce(lambda a, b: pruned(merge(a, b), MOST_NODES), trees))

    def _row(key: tuple, template: Slot) -> pa.Table:
        host, layout, part = (k.as_py() for k in key)
        return pa.table({"host": pa.array([host], pa.string()), "layout": pa.array([layout], pa.string()), "part": pa.array([part], pa.int64()), "template": pa.array([json.dumps(template.plain(), separators=(",", ":"))], pa.string())})

    kind = "host string, layout string, part long, template string"
    out = materialize(first.groupBy("host", "layout", "part").applyInArrow(folded, kind), "templates")
    while True:
        again = materialize(out.groupBy("host", "layout").agg(F.max("part").alias("most")).where("most > 0"), "unmerged")
        if again.isEmpty():
            return out.select("host", "layout", "template")
        # A round merges eight partial templates at once; finished ones go along.
        rows = out.join(again, ["host", "layout"], "left").select("host", "layout", F.floor(F.col("part") / 8).cast("long").alias("part"), "template")
        out = materialize(rows.groupBy("host", "layout", "part").applyInArrow(merged, kind), "templates")


def _packed(rows: DataFrame, *columns: str) -> DataFrame:
    """(host, wrapper): for each host one compressed JSON of {column: {layout: value}}."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        known: dict[str, dict] = {c: {} for c in columns}
        for row in table.to_pylist():
            for c in columns:
                if row[c] is not None:
                    known[c][row["layout"]] = json.loads(row[c]) if isinstance(row[c], str) else row[c]
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([zlib.compress(json.dumps(known).encode())], pa.binary())})

    return materialize(rows.groupBy("host").applyInArrow(pack, "host string, wrapper binary"), "wrappers")


def _unpacked(held: bytes | None) -> dict:
    return json.loads(zlib.decompress(held)) if held else {}


def _wrappers(teaching: DataFrame) -> DataFrame:
    """(host, wrapper) from all distinct pages: ``induce`` with alignments and counts in Spark."""
    templates = _templates(teaching)
    named = templates.withColumnRenamed("template", "templates")
    with_templates = teaching.join(_packed(named, "templates"), "host").select("host", "layout", "shape", "slots", "texts", "w", "wrapper")

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Aligner] = {}
        for batch in batches:
            total: Counter[tuple[str, str, int, int]] = Counter()
            for row in batch.to_pylist():
                held = row["wrapper"]
                if held not in known:
                    if len(known) >= KEPT_HOSTS:
                        known.clear()
                    known[held] = Aligner(_unpacked(held)["templates"])
                for x in seen(known[held], row["layout"], row["shape"], row["slots"], row["texts"]):
                    total[row["host"], *x] += row["w"]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            columns = [pa.array([k[i] for k in total], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.float64())], ["host", "layout", "node", "value", "n"])

    counts = with_templates.mapInArrow(see, "host string, layout string, node int, value long, n double")
    counts = materialize(counts.groupBy("host", "layout", "node", "value").agg(F.round(F.sum("n"), 6).alias("n")), "text-counts")
    total = materialize(counts.where("value = 0").where(F.col("n") > PAGES - 1e-3).select("host", "layout", "node", F.col("n").alias("total")), "node-totals")
    fixed = counts.where("value <> 0").join(total, ["host", "layout", "node"]).where(F.col("n") >= CONSTANT * F.col("total") - 1e-3)
    fixed = fixed.groupBy("host", "layout").agg(F.collect_list(F.array(F.col("node").cast("long"), "value")).alias("fixed"))
    nodes = total.groupBy("host", "layout").agg(F.collect_list("node").alias("nodes"))
    return _packed(named.join(nodes, ["host", "layout"], "left").join(fixed, ["host", "layout"], "left"), "templates", "nodes", "fixed")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html gives the empty text; null urls share one host; repeated pages are
    each extracted and teach once. A page of a host with fewer than ``PAGES`` is read by its own tree. An
    empty table gives no rows; other columns are not read.
    """
    rows = bounded(pages).select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("h"))
    parsed = _parsed(rows)
    copies = materialize(parsed.groupBy("host", "h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    weighted = parsed.where(F.size("texts") > 0).join(copies, ["host", "h"], "left").withColumn("w", 1 / F.coalesce("copies", F.lit(1)))
    wrappers = _wrappers(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes | None, Wrapper] = {}
        for batch in batches:
            texts = []
            for row in batch.select(["layout", "shape", "slots", "elements", "flags", "texts", "wrapper"]).to_pylist():
                held = row["wrapper"]
                if held not in known:
                    if len(known) >= KEPT_HOSTS:
                        known.clear()
                    known[held] = Wrapper(_unpacked(held))
                pieces = [Piece(*x) for x in zip(row["slots"], row["elements"], row["flags"], row["texts"])]
                texts.append(known[held].text(row["layout"], row["shape"], pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = parsed.join(wrappers, "host", "left").select("page_id", "url", "layout", "shape", "slots", "elements", "flags", "texts", "wrapper")
    schema = joined.select("page_id", "url").schema
    return joined.mapInArrow(run, T.StructType([*schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
