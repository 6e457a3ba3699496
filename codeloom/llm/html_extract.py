"""Operator 10: main text of pages by wrapper induction.

A few pages of each host, of different main texts, are aligned as trees by simple tree matching. Subtrees that are the same
in all of them, texts included, are the host's template, whatever their elements and classes say; the others are slots that
vary. The wrapper is where the slots' text is: the deepest path of labels (tag and classes) that holds at least three fifths
of it, widened to the article or main element around it; where there is none, the deepest container that holds all of it in
headings and paragraphs, and 19 of 20 parts of the rest; with the template's blocks below that. A page's text is what its
nodes at that path hold, but for blocks of the template and those varying parts (adverts, comments, lists of links) that are not
an article's text by their element or class. A page without such a path is aligned with a reference page of its
host by tree matching; if that fails too, and for hosts with a single text, its largest article, main element or body is
taken. Of pages that are near copies, which have more text in constant headings and paragraphs than varies (``COPIES`` times
as much, if they are over two), no wrapper is learned; and no block is dropped as constant where there are but two pages, or
where the constant text at the wrapper's path is more than what varies there.

Reference pages are the ``REFERENCES`` of smallest hash of each host, of pages of up to ``REFERENCE_CHARS`` characters. Each
task keeps that many a host, and so does a second round that deals a host to ``SALTS`` tasks, so a host that has a third of all
pages is gathered nowhere. The wrappers are broadcast if they have at most ``BROADCAST_BYTES`` in all, which is checked;
beyond that they are joined by host, where Spark splits a skewed host. Parsing and matching are linear in a page's length
but for the tables of tree matching, which have a bounded number of cells; see ``dom``.

Edge cases: null or empty html has the empty text; a null url is a host of its own; repeated pages are pages like others,
and references of equal text count once; an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, n_partitions, text_batches
from codeloom.llm.dom import BLOCK, Node, blocks, content_hash, parse, tree_match

REFERENCES, REFERENCE_CHARS, SALTS, BROADCAST_BYTES, HELD_CHARS = 5, 1 << 20, 64, 64 << 20, 32 << 20
COPIES = 4
#: Cells of the tables in which a page without the wrapper's path is aligned.
PAGE_CELLS = 50_000
#: Elements that hold no article text, and words of classes, ids and roles that say so.
OTHER = set("head nav footer aside form script style noscript button select option textarea input label iframe svg canvas object template dialog menu title audio video".split())
WORDS = set(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager skip toolbar masthead copyright complementary contentinfo search outbrain taboola".split()
)
#: Other words of classes beside those; ids, which slugs of an article's headings may be, have only ``PLACE``.
PLACE = set("left right top bottom site main primary secondary inner outer wrap wrapper container box bar block area section list".split())
KIND = PLACE | set("post posts article articles entry page link links button buttons slot unit title heading header text form item items icons media".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | {"p"}
HEADS = {"header"}
CONTAINERS = set("article main section div td body # form center blockquote".split())
WHOLE = {"#", "html", "body", "main", "table", "tbody", "tr"}
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def is_other(node: Node) -> bool:
    """Whether a node is a menu, header, footer, sidebar, notice, advert, form, script or reader comments."""
    if node.tag in OTHER:
        return True
    if node.tag in HEADS:
        up = node.parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    a = node.attrs
    if not a or node.tag in WHOLE:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    wanted = {"comment", "comments", "reply", "replies"} if node.tag == "article" else WORDS
    names = [(c, KIND) for c in f"{a.get('class', '')} {a.get('role', '')}".lower().split()]
    if node.tag != "p" and node.tag not in HEADINGS:
        names.append((a.get("id", "").lower(), PLACE))
    for name, beside in names:
        words = {w for w in _WORD.findall(name) if len(w) > 1}
        if words == {"header"} or words & wanted and words <= wanted | beside:
            return True
    return False


def largest_article(page: Node) -> list[Node]:
    """Where there is no wrapper: the article, else main element, else body of the most text."""
    kept = []
    todo = [page]
    while todo:
        node = todo.pop()
        if node is page or not is_other(node):
            kept.append(node)
            todo.extend(node.elements())
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attrs.get("role") == "main", lambda n: n.tag == "body"):
        if own := [n for n in kept if test(n)]:
            return [max(own, key=lambda n: (sum(map(len, blocks([n], is_other))), -n.depth))]
    return [page]


def _text_nodes(page: Node, template: set[int]) -> Iterator[tuple[Node, str]]:
    """Nodes with text of their own, but for the template's and for parts that are no article's."""
    todo = [page]
    while todo:
        node = todo.pop()
        if id(node) not in template and (node is page or not is_other(node)):
            if text := node.own_text():
                yield node, text
            todo.extend(node.elements())


def induce(htmls: list[str]) -> dict | None:
    """The wrapper of a host from reference pages, or None where nothing varies: ``path``, the labels down to the content;
    ``constant``, (key, content hash) of the template's blocks at or below it; and ``skeleton`` of a reference page."""
    pages, seen = [], set()
    for html in sorted(set(htmls)):
        page = parse(html)
        main = "\n".join(blocks(largest_article(page), is_other))
        if main and main not in seen:
            seen.add(main)
            pages.append(page)
    if len(pages) < 2:
        return None
    base = pages[0]
    # What is the same in the base and in every other page, and the nodes that it is aligned with.
    same = {id(n): h for n, h in _hashes(base)}
    template: list[set[int]] = []
    for page in pages[1:]:
        other = {id(n): h for n, h in _hashes(page)}
        aligned = {id(x): id(y) for x, y in tree_match(base, page) if id(x) in same and same[id(x)] == other.get(id(y))}
        same = {k: h for k, h in same.items() if k in aligned}
        template.append(aligned)
    weight: Counter = Counter()
    prose: Counter = Counter()
    at: dict[int, Node] = {}
    total = 0
    for page, of in zip(pages, [set(same), *({a[k] for k in same} for a in template)], strict=True):
        for node, text in _text_nodes(page, of):
            if not _in_link(node):
                total += len(text)
                own = len(text) if node.tag == "p" or node.tag in HEADINGS else 0
                while node:
                    weight[node.key] += len(text)
                    prose[node.key] += own
                    at.setdefault(node.key, node)
                    node = node.parent
    shared = sum(len(n.own_text()) for n in base.walk() if id(n) in same and n.tag in PROSE and not _in_link(n))
    if not total or len(pages) * shared > (1 if len(pages) == 2 else COPIES) * total:
        return None
    deepest = lambda keys: max((at[k] for k in keys), key=lambda n: n.depth)
    node = deepest(k for k, w in weight.items() if 5 * w >= 3 * total)
    up = lambda n, tags: next((x for x in _line(n) if x.tag in tags), None)
    if not up(node, ("article", "main")):
        node = deepest(k for k, w in weight.items() if 20 * w >= 19 * total and prose[k] == prose[base.key])
    while node.parent and node.tag not in CONTAINERS:
        node = node.parent
    node = up(node, ("article",)) or up(node, ("main",)) or node
    kept = []
    if len(pages) > 2:
        below = [n for r in _at(base, node.path()) for n in r.walk()]
        tops = [n for n in below if id(n) in same and not (n.parent and id(n.parent) in same)]
        if len(pages) * sum(len(n.own_text()) + sum(len(c.own_text()) for c in n.walk() if c is not n) for n in tops) <= weight[node.key]:
            kept = [[k, h] for k, h in {(n.key, same[id(n)]) for n in below if id(n) in same and n.tag in BLOCK}]
    path = node.path()
    return {"path": path, "constant": sorted(kept), "skeleton": _skeleton(base, path) if _at(base, path) else None}


def _hashes(page: Node) -> list[tuple[Node, int]]:
    """(node, content hash) of every node with text at or below it."""
    known: dict[int, int] = {}
    content_hash(page, known)
    out, texts = [], set()
    for n in reversed(list(page.walk())):
        if n.own_text() or any(id(c) in texts for c in n.elements()):
            texts.add(id(n))
            out.append((n, known[id(n)]))
    return out


def _line(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _in_link(node: Node) -> bool:
    return any(n.tag == "a" for n in _line(node))


def _at(page: Node, path: list[str]) -> list[Node]:
    """The page's nodes at a path of labels, in page order."""
    found = [page] if page.label == path[0] else []
    for label in path[1:]:
        found = [c for n in found for c in n.elements() if c.label == label]
    return found


def _skeleton(node: Node, path: list[str]) -> list:
    """Labels of a reference page down to the content."""
    return [node.label, [] if node.depth + 1 == len(path) and node.path() == path else [_skeleton(c, path) for c in node.elements()]]


def _tree(skeleton: list, parent: Node | None = None) -> Node:
    node = Node(skeleton[0].split(".")[0], {}, parent)
    node.label = skeleton[0]
    node.children = [_tree(c, node) for c in skeleton[1]]
    return node


class Wrapper:
    def __init__(self, spec: dict):
        self.path = spec["path"]
        self.constant: dict[int, set[int]] = {}
        for key, h in spec["constant"]:
            self.constant.setdefault(key, set()).add(h)
        self.reference = _tree(spec["skeleton"]) if spec["skeleton"] else None

    def roots(self, page: Node) -> list[Node]:
        """The page's nodes at the wrapper's path, or those aligned with it."""
        found = _at(page, self.path)
        if not found and self.reference:
            aligned = {id(b) for a, b in tree_match(self.reference, page, PAGE_CELLS) if a.depth + 1 == len(self.path) and a.path() == self.path}
            found = [n for n in page.walk() if id(n) in aligned]
        return found

    def skip(self, node: Node) -> bool:
        """Blocks of the template, and parts that are no article's; words inside a block that varies stay."""
        own = self.constant.get(node.key)
        return own is not None and content_hash(node) in own or is_other(node)


def main_text(html: str | None, wrapper: Wrapper | None) -> str:
    page = parse(html)
    text = ""
    if wrapper and (roots := wrapper.roots(page)):
        text = "\n\n".join(blocks(roots, wrapper.skip))
    return text or "\n\n".join(blocks(largest_article(page), is_other))


def _few(batches: Iterator[pa.RecordBatch], by_url: bool) -> Iterator[pa.RecordBatch]:
    """The pages of smallest hash of each host: rows (host, html). Holds ``HELD_CHARS`` at most, then hands on what there is."""
    best: dict[str, list[tuple[int, str]]] = {}
    held = 0
    for b in text_batches(batches):
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if page and len(page) <= REFERENCE_CHARS:
                own, item = best.setdefault(host(url) if by_url else url, []), (-zlib.crc32(page.encode()), page)
                if item not in own:
                    held += len(page)
                    if len(own) < REFERENCES:
                        heapq.heappush(own, item)
                    else:
                        held -= len(heapq.heappushpop(own, item)[1])
                if held > HELD_CHARS:
                    yield _rows(best)
                    best, held = {}, 0
    if best:
        yield _rows(best)


def _rows(best: dict) -> pa.RecordBatch:
    rows = [(h, p) for h, own in best.items() for _, p in own]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["host", "html"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON; hosts without one are absent."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(name: str, own: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            if spec := induce([p for _, p in own]):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([json.dumps(spec)], pa.string())], names=["host", "wrapper"])

        name, own = None, []
        for b in text_batches(batches):  # sorted by host
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != name:
                    yield from done(name, own) if own else ()
                    name, own = h, []
                item = (-zlib.crc32(page.encode()), page)
                if item not in own:
                    (heapq.heappush if len(own) < REFERENCES else heapq.heappushpop)(own, item)
        yield from done(name, own) if own else ()

    n = n_partitions(pages.sparkSession)
    few = pages.select("url", "html").mapInArrow(lambda b: _few(b, True), "host string, html string")
    few = few.repartition(n, "host", F.pmod(F.crc32("html"), F.lit(SALTS))).mapInArrow(lambda b: _few(b, False), "host string, html string")
    return few.repartition(n, "host").sortWithinPartitions("host").mapInArrow(build, "host string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = Scratch(spark, "wrappers").save(wrappers(pages), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 100)).first()[0] or 0
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in found.collect()})
        spec = lambda h, row: shared.value.get(h)
    else:
        at = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")), F.lit("")))
        pages = pages.withColumn("host_", at).join(found, F.col("host_") == F.col("host"), "left").select("page_id", "url", "html", "wrapper")
        spec = lambda h, row: row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, Wrapper | None] = {}
        for b in text_batches(batches):
            urls, htmls = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = b.column(3).to_pylist() if b.num_columns > 3 else [None] * len(urls)
            texts = []
            for url, html, row in zip(urls, htmls, rows, strict=True):
                h = host(url)
                if h not in memo:
                    if len(memo) > 5000:
                        memo.clear()
                    found = spec(h, row)
                    memo[h] = Wrapper(json.loads(found)) if found else None
                texts.append(main_text(html, memo[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
