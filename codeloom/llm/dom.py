"""A small HTML tree: tolerant parsing, text blocks, and simple tree matching."""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

from xxhash import xxh64_intdigest

#: Fixed values of HTML: elements without an end, with raw text, and that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of these ends where one of the others begins.
ENDS = {
    "p": BLOCK - {"li", "td", "th", "tr", "dd", "dt", "option", "body", "html", "tbody", "thead", "tfoot", "caption"} | {"p"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: Elements beyond which a start tag ends nothing.
FENCE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "select", "td", "th", "li", "blockquote"}
MAX_DEPTH = 150
#: Cells of the tables of one tree match; beyond them children are aligned by ``_anchored``.
CELLS = 250_000
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}


class Node:
    """An element; ``label`` is its tag and classes, ``key`` a 64-bit hash of the labels from the root to it."""

    __slots__ = ("tag", "attrs", "parent", "children", "depth", "label", "key")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.label = tag
        if attrs and (names := attrs.get("class")):
            words = sorted(w for w in names.lower().split() if not any(c.isdigit() for c in w))
            self.label = ".".join([tag, *words])
        if len(self.label) > 100:
            self.label = f"{tag[:20]}#{xxh64_intdigest(self.label):x}"
        self.key = xxh64_intdigest(self.label, parent.key if parent else 0)

    def path(self) -> list[str]:
        """Labels from the root to this node."""
        out, node = [], self
        while node:
            out.append(node.label)
            node = node.parent
        return out[::-1]

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements()))


def parse(html: str | None) -> Node:
    """The tree of a page under a node ``#``, in time linear in its length.

    Elements nested deeper than ``MAX_DEPTH`` become children of the last level. After a tag whose quotes never close, which
    would take the rest of the page, tags end at the next ``>`` whatever their quotes.
    """
    root = top = Node("#", {}, None)
    html = html or ""
    at = begin = 0
    n, last, quoted = len(html), html.rfind(">"), True
    while (lt := html.find("<", at)) >= 0:
        m = None
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) + 3
            end = end if end > 2 else n
        elif lt > last:  # nothing is a tag from here on
            at = html.find("<!--", lt)
            if at < 0:
                break
            continue
        elif html[lt + 1] in "!?":
            end = html.index(">", lt) + 1
        else:
            m = _NAME.match(html, lt)
            if not m:
                at = lt + 1
                continue
            rest = _REST.match(html, m.end()) if quoted else None
            if rest:
                raw, end = rest[1], rest.end()
            else:
                quoted, end = False, html.index(">", m.end()) + 1
                raw = html[m.end() : end - 1]
        if lt > begin:
            text = html[begin:lt]
            top.children.append(unescape(text) if "&" in text else text)
        at = begin = end
        if not m:
            continue
        tag = m[2]
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not _open(top, "p"):
                top.children.append(Node(tag, {}, top))
                continue
            node = top
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                top = node.parent
            continue
        ends, node = [t for t, by in ENDS.items() if tag in by], top
        while ends and node.parent:
            if node.tag in ends:
                top = node.parent
                ends = [t for t, by in ENDS.items() if tag in by]
            elif node.tag in FENCE:
                break
            node = node.parent
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            at = begin = close.end() if close else n
        elif tag not in VOID and not (raw.endswith("/") and tag not in BLOCK) and node.depth < MAX_DEPTH:
            top = node
    if begin < n:
        top.children.append(unescape(html[begin:]))
    return root


def _open(node: Node, tag: str) -> bool:
    while node.parent:
        if node.tag == tag:
            return True
        if node.tag in FENCE:
            return False
        node = node.parent
    return False


def blocks(nodes: list[Node], skip) -> list[str]:
    """Text blocks below ``nodes`` in page order, white space made one space; ``skip(node)`` leaves a subtree out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for node in nodes:
        todo: list = [node]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br":
                held.append(" ")
            elif x is node or not skip(x):
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return out


def content_hash(node: Node, known: dict[int, int] | None = None) -> int:
    """A hash of a whole subtree, its texts included; the same in every process. ``known`` takes those of the nodes below."""
    known = {} if known is None else known
    for x in reversed(list(node.walk())):
        parts = [x.label, x.own_text(), *(f"{known[id(c)]:x}" for c in x.elements())]
        known[id(x)] = xxh64_intdigest("\0".join(parts))
    return known[id(node)]


def _anchored(xs: list[Node], ys: list[Node], same: dict[int, int]) -> list[tuple[Node, Node]]:
    """An order-keeping match of long lists of children in about linear time: equal subtrees that occur once in each list,
    as many as keep their order, and between them the next child of the same label."""
    once: dict[int, int | None] = {}
    for j, y in enumerate(ys):
        once[same[id(y)]] = None if same[id(y)] in once else j
    seen: dict[int, int] = {}
    for x in xs:
        seen[same[id(x)]] = seen.get(same[id(x)], 0) + 1
    hits = [(i, once[same[id(x)]]) for i, x in enumerate(xs) if seen[same[id(x)]] == 1 and once.get(same[id(x)]) is not None]
    tops, ends, back = [], [], []  # the longest rising run of places in ys
    for k, (_, j) in enumerate(hits):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(hits[k])
        k = back[k]
    out, i, j = [], 0, 0
    for to_i, to_j in [*reversed(chain), (len(xs), len(ys))]:
        places: dict[str, list[int]] = {}
        for b in range(j, to_j):
            places.setdefault(ys[b].label, []).append(b)
        for a in range(i, to_i):
            own = places.get(xs[a].label, ())
            at = bisect_left(own, j)
            if at < len(own):
                out.append((xs[a], ys[own[at]]))
                j = own[at] + 1
        if to_i < len(xs):
            out.append((xs[to_i], ys[to_j]))
        i, j = to_i + 1, to_j + 1
    return out


def tree_match(a: Node, b: Node, cells: int = CELLS) -> list[tuple[Node, Node]]:
    """Simple tree matching: the order-keeping match of equal labels of largest weight, as pairs of nodes.

    A pair weighs 1, and 1 more if its own texts are equal, so of matches of the same size the one that keeps what is
    constant is taken. Equal subtrees at either end of two lists of children belong to some largest match and need no
    table. Exact while the tables have at most ``cells`` cells in all; lists beyond that are aligned by ``_anchored``.
    """
    same: dict[int, int] = {}
    text: dict[int, str] = {}
    size: dict[int, int] = {}
    for root in (a, b):
        for x in reversed(list(root.walk())):
            text[id(x)] = x.own_text()
            kids = x.elements()
            same[id(x)] = hash((x.label, text[id(x)], *(same[id(c)] for c in kids)))
            size[id(x)] = 1 + bool(text[id(x)]) + sum(size[id(c)] for c in kids)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Node, y: Node) -> int:
        nonlocal cells
        if x.label != y.label:
            return 0
        if same[id(x)] == same[id(y)]:
            return size[id(x)]
        key = (id(x), id(y))
        if key in memo:
            return memo[key][0]
        xs, ys = x.elements(), y.elements()
        lo, hi, end = 0, 0, min(len(xs), len(ys))
        while lo < end and same[id(xs[lo])] == same[id(ys[lo])]:
            lo += 1
        while hi < end - lo and same[id(xs[-1 - hi])] == same[id(ys[-1 - hi])]:
            hi += 1
        chosen = list(zip(xs[:lo], ys[:lo], strict=True)) + list(zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True))
        xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
        if len(xs) * len(ys) > cells:
            chosen += _anchored(xs, ys, same)
        elif xs and ys:
            cells -= len(xs) * len(ys)
            score = [[0] * (len(ys) + 1)]
            for p in xs:
                above, row = score[-1], [0]
                for j, q in enumerate(ys):
                    best = above[j + 1] if above[j + 1] > row[j] else row[j]
                    if p.label == q.label and (both := above[j] + match(p, q)) > best:
                        best = both
                    row.append(best)
                score.append(row)
            i, j = len(xs), len(ys)
            while i and j:
                if score[i][j] == score[i - 1][j]:
                    i -= 1
                elif score[i][j] == score[i][j - 1]:
                    j -= 1
                else:
                    chosen.append((xs[i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
        own = 1 + (bool(text[id(x)]) and text[id(x)] == text[id(y)])
        memo[key] = (own + sum(match(p, q) for p, q in chosen), chosen)
        return memo[key][0]

    if not match(a, b):
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if same[id(x)] == same[id(y)]:
            todo.extend(zip(x.elements(), y.elements(), strict=True))
        else:
            todo.extend(memo[id(x), id(y)][1])
    return out
