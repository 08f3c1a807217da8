"""Main text of web pages: wrapper induction over the pages of a host.

Each page is parsed to a tree. The block structure of a host's reference page (its smallest page_id) and of every
other page are aligned by simple tree matching, runs of siblings of one structure being one node. For each text of the reference, the share of
the host's pages that hold it at the aligned node is counted over all pages: texts of CONSTANT of the pages or more, of LEAST_PAGES pages at least,
are template, the varying slots content; where all that a host's pages hold is mostly one text, they are versions of one article and nothing is template.
Of the content, all top-level article elements (or main ones, or those named as content, or else the page) are the article, less what elements,
roles and names mark as menus, headers, footers, sidebars, notices, adverts, forms and comments: a name counts if all its words are such words or words of layout.
Trees are walked with explicit stacks, so the depth of a page is not limited.

References and counts are broadcast while they stay below MAX_BROADCAST bytes; beyond it they are joined by host.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, small

CONSTANT, LEAST_PAGES, MAX_BROADCAST = 0.8, 3, 32_000_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption dd dt li".split())
DROP = frozenset("script style noscript template head title nav footer aside form button input select option textarea iframe object embed svg canvas audio video dialog menu map noframes noembed fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words in class and id names that mark what is not the article, anywhere; outside articles only; and words that may stand beside them.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus feedback"
    " footer gdpr menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion"
    " recommended recommendations related replies respond responses share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription tagcloud teaser toolbar widget widgets".split()
)
OUTSIDE = frozenset("banner copyright dialog header legal login masthead rail reply search".split())
BESIDE = frozenset(
    "alt area article articles bar block body bottom box btn button buttons center col column container content entry fixed form global group icons inline inner item items left link links list main media"
    " mobile page panel post posts primary row secondary section sections site sticky stories story text thread title to top unit user wrap wrapper right".split()
)
CONTENT = frozenset("article articlebody body content entry main page post story".split())
#: Elements of which a name tells nothing: they hold an article's own text.
OWN = frozenset("html body main h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in RAW}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "ref")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent, self.ref = tag, attrs, [], parent, None

    def names(self) -> list[set[str]]:
        """The words of each class and of the id."""
        given = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".split()
        return [{w for w in _SPLIT.split(_CAMEL.sub(" ", a).lower()) if w} for a in given]


def parse(source: str) -> Node:
    """The page's tree; elements left open are closed where HTML closes them, or at the end. A quote left open ends with its tag."""
    root = top = Node("#root", {}, None)
    opened: Counter = Counter()  # elements around the place, by name
    at = 0

    def leave(node: Node) -> None:
        nonlocal top
        while top is not node.parent:
            opened[top.tag] -= 1
            top = top.parent

    def innermost(names) -> Node:
        node = top
        while node is not root and node.tag not in names:
            node = node.parent
        return node

    while at < len(source):
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if not m:  # a tag that the end cuts off is no text
            text = re.sub(r"<[/a-zA-Z!?][^<]*\Z", "", text)
        if text:
            top.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        closing, name, inner = m[1] or m[4], m[2] or m[5], m[3] or m[6]
        if not name:
            if m[0].startswith("<![CDATA["):
                top.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if closing:
            if opened[tag]:
                leave(innermost((tag,)))
            elif tag in ("p", "br"):
                top.children.append(Node(tag, {}, top))
            continue
        if tag in CLOSES_P and opened["p"]:
            node = innermost(("p", "td", "th", "li", "table", "button"))
            if node.tag == "p":
                leave(node)
        peers = _PEERS.get(tag, (tag,))
        if tag in _SCOPE and any(opened[x] for x in peers):
            node = innermost({*peers, *_SCOPE[tag]})
            if node.tag in peers:
                leave(node)
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(inner)} if inner else {}
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in RAW:
            e = _END[tag].search(source, at)
            held = source[at : e.start() if e else len(source)]
            if held and tag == "textarea":
                node.children.append(html.unescape(held))
            close = source.find(">", e.start()) if e else -1
            at = close + 1 if close >= 0 else len(source)
        elif tag not in VOID and not (inner or "").rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            top = node
            opened[tag] += 1
    return root


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether element, role or names mark it as no article; inside: within an article."""
    if node.tag in DROP or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or node.attrs.get("role", "").lower() in ROLES or _HIDDEN.search(node.attrs.get("style", "")):
        return True
    if node.tag == "header":
        return not inside
    if node.tag in OWN:
        return False
    for words in node.names():
        marks = words & MARKS if inside else words & (MARKS | OUTSIDE)
        if marks and all(w in MARKS or w in OUTSIDE or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def descendants(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in n.children if not isinstance(c, str))


def blocks(root: Node, articles: frozenset[int] = frozenset()) -> list[tuple[str, Node]]:
    """(text, block element) in page order, boilerplate left out; articles: identities of the elements taken as articles."""
    out: list[tuple[str, Node]] = []
    held: list[str] = []

    def close(owner: Node) -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, owner))
        held.clear()

    open_nodes = [(iter(root.children), root, False, True)]
    while open_nodes:
        rest, owner, inside, is_block = open_nodes[-1]
        c = next(rest, None)
        if c is None:
            open_nodes.pop()
            if is_block:
                close(owner)
        elif isinstance(c, str):
            held.append(c)
        elif c.tag == "br":
            held.append(" ")
        else:
            block = c.tag in BLOCK
            if block:
                close(owner)
            if not boilerplate(c, inside):
                open_nodes.append((iter(c.children), c if block else owner, inside or c.tag in ("article", "main") or id(c) in articles, block))
    return out


def _find(root: Node, wanted) -> list[Node]:
    """The top-level elements that are wanted, in page order, outside boilerplate."""
    out, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is not root:
            if boilerplate(node, inside):
                continue
            if wanted(node):
                out.append(node)
                continue
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str))
    return out


def _is_main(n: Node) -> bool:
    return n.tag == "main" or n.attrs.get("role") == "main"


_KINDS = (
    lambda n: n.tag == "article" or n.attrs.get("itemprop") == "articleBody",
    _is_main,
    lambda n: n.tag in ("div", "section", "td") and any(w & CONTENT and not w & {"wrapper", "container", "page"} for w in n.names()),
)


def _teasers(found: list[Node]) -> list[Node]:
    """Those of several article elements, but for the longest, of which links hold at least half the characters: they lead to articles."""
    if len(found) < 2:
        return []
    size = {id(n): [0, 0] for n in found}
    for f in found:
        stack = [(f, False)]
        while stack:
            n, link = stack.pop()
            for c in n.children:
                if not isinstance(c, str):
                    stack.append((c, link or c.tag == "a"))
                elif not boilerplate(n, True):
                    size[id(f)][link] += len("".join(c.split()))
    longest = max(found, key=lambda n: size[id(n)][0])
    return [n for n in found if n is not longest and size[id(n)][1] >= size[id(n)][0]]


def article(root: Node) -> list[tuple[str, Node]]:
    """The blocks of the article: of all top-level elements of the first kind that has text, teasers left out, and of first-level headings of a main element around them, in page order."""
    for wanted in _KINDS:
        found = _find(root, wanted)
        if found:
            gone = set(map(id, _teasers(found)))
            found = [n for n in found if id(n) not in gone]
            inner = {id(n) for f in found for n in descendants(f)}
            got = blocks(root, frozenset(map(id, found)))
            if any(id(n) in inner for _, n in got):
                heads = {id(n) for m in _find(root, _is_main) for n in descendants(m) if n.tag == "h1"}
                return [b for b in got if id(b[1]) in inner or id(b[1]) in heads]
    return blocks(root)


class Shape:
    """A block element and its block children; runs of siblings of one structure are one shape with several nodes."""

    __slots__ = ("label", "kids", "nodes", "sig", "size")

    def __init__(self, node: Node, kids: list[Shape]):
        self.label, self.kids, self.nodes = (node.tag, node.attrs.get("class", "")), [], [node]
        for k in kids:
            if self.kids and self.kids[-1].sig == k.sig:
                _join(self.kids[-1], k)
            else:
                self.kids.append(k)
        self.size = 1 + sum(k.size for k in self.kids)
        self.sig = xxhash.xxh3_128_intdigest(repr((self.label, [k.sig for k in self.kids])))


def _join(a: Shape, b: Shape) -> None:
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        x.nodes += y.nodes
        pairs.extend(zip(x.kids, y.kids, strict=True))


def shape(root: Node) -> Shape:
    found, inner = [root], [[]]  # block elements, parents first, and the places of each one's block children
    stack = [(c, 0) for c in reversed(root.children)]
    while stack:
        c, owner = stack.pop()
        if isinstance(c, str) or c.tag in RAW or c.tag == "head":
            continue
        if c.tag in BLOCK:
            inner[owner].append(len(found))
            owner = len(found)
            found.append(c)
            inner.append([])
        stack.extend((x, owner) for x in reversed(c.children))
    made: list[Shape | None] = [None] * len(found)
    for k in range(len(found) - 1, -1, -1):
        made[k] = Shape(found[k], [made[j] for j in inner[k]])
        for j in inner[k]:
            made[j] = None
    return made[0]


def matching(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Simple tree matching: the most pairs of shapes in an order-keeping mapping of equal labels.

    Equal subtrees at the start and the end of two lists of children always belong to a best mapping, so only what lies between them is tabled.
    """
    if a.label != b.label:
        return []
    order, tables, stack = [], {}, [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.sig == y.sig:
            continue
        most, p, s = min(len(x.kids), len(y.kids)), 0, 0
        while p < most and x.kids[p].sig == y.kids[p].sig:
            p += 1
        while s < most - p and x.kids[-1 - s].sig == y.kids[-1 - s].sig:
            s += 1
        xs, ys = x.kids[p : len(x.kids) - s], y.kids[p : len(y.kids) - s]
        order.append((x, y, p, s, xs, ys))
        stack.extend((u, v) for u in xs for v in ys if u.label == v.label and u.sig != v.sig)

    def weight(u: Shape, v: Shape) -> int:
        return u.size if u.sig == v.sig else tables[id(u), id(v)][0] if u.label == v.label else 0

    for x, y, p, s, xs, ys in reversed(order):
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, u in enumerate(xs):
            row, above = m[i + 1], m[i]
            for j, v in enumerate(ys):
                row[j + 1] = max(row[j], above[j + 1], above[j] + weight(u, v))
        same = sum(k.size for k in x.kids[:p]) + sum(k.size for k in x.kids[len(x.kids) - s :])
        tables[id(x), id(y)] = (1 + same + m[-1][-1], m, p, s, xs, ys)
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        if x.sig == y.sig:
            stack.extend(zip(x.kids, y.kids, strict=True))
            continue
        _, m, p, s, xs, ys = tables[id(x), id(y)]
        stack.extend(zip(x.kids[:p], y.kids[:p], strict=True))
        stack.extend(zip(x.kids[len(x.kids) - s :], y.kids[len(y.kids) - s :], strict=True))
        i, j = len(xs), len(ys)
        while i and j:
            w = weight(xs[i - 1], ys[j - 1])
            if w and m[i][j] == m[i - 1][j - 1] + w:
                stack.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


class Reference:
    """A host's reference page: its shapes numbered, with the hashes of their texts."""

    def __init__(self, source: str):
        root = parse(source)
        self.shape, self.number, self.texts = shape(root), {}, {}
        stack = [self.shape]
        while stack:
            s = stack.pop()
            self.number[id(s)] = len(self.number)
            stack.extend(reversed(s.kids))
        owners = {id(n): s for s in self.shapes() for n in s.nodes}
        for text, node in blocks(root):
            if id(node) in owners:
                self.texts.setdefault(self.number[id(owners[id(node)])], set()).add(_hash(text))

    def shapes(self):
        stack = [self.shape]
        while stack:
            s = stack.pop()
            yield s
            stack.extend(s.kids)

    def align(self, root: Node) -> dict[int, int]:
        """Number of the aligned shape for each node of a page, by the node's identity."""
        return {id(n): self.number[id(b)] for a, b in matching(shape(root), self.shape) for n in a.nodes}


def held_texts(root: Node, ref: Reference) -> set[tuple[int, int]]:
    """(shape, text hash) of the reference's texts that a page holds at the aligned place."""
    at = ref.align(root)
    return {(k, h) for t, n in blocks(root) if (k := at.get(id(n))) is not None and (h := _hash(t)) in ref.texts.get(k, ())}


def extract(source: str | None, ref: Reference | None, constant: frozenset[tuple[int, int]]) -> str:
    if not source:
        return ""
    root = parse(source)
    found = article(root)
    if constant and ref:
        at = ref.align(root)
        kept = [b for b in found if (at.get(id(b[1])), _hash(b[0])) not in constant]
        if 2 * sum(len(b[0]) for b in kept) >= sum(len(b[0]) for b in found):  # else the host's pages are versions of one article: what they share is no template
            found = kept
    return "\n".join(b[0] for b in found)


def _lookup(held: dict[str, Reference], host, source) -> Reference | None:
    if source is None:
        return None
    if host not in held:
        if len(held) > 256:
            held.clear()
        held[host] = Reference(source)
    return held[host]


def _sources(batch, refs):
    if refs is not None:
        return [refs.value.get(h, (None, frozenset())) for h in batch.column("host").to_pylist()]
    return list(zip(batch.column("ref_html").to_pylist(), (frozenset((c["node"], c["text"]) for c in x or ()) for x in batch.column("constant").to_pylist()), strict=True))


def _survey(refs):
    def run(batches):
        held: dict[str, Reference] = {}
        for batch in small(batches):
            seen: dict[tuple, int] = {}
            for host, source, (ref_html, _) in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), _sources(batch, refs), strict=True):
                ref = _lookup(held, host, ref_html)
                if source and ref:
                    seen[host, -1, 0] = seen.get((host, -1, 0), 0) + 1
                    for x in held_texts(parse(source), ref):
                        seen[host, *x] = seen.get((host, *x), 0) + 1
            cols = [pa.array([k[i] for k in seen], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(seen.values()), pa.int64())], ["host", "node", "text", "n"])

    return run


def _extract(refs):
    def run(batches):
        held: dict[str, Reference] = {}
        for batch in small(batches):
            texts = [extract(s, _lookup(held, h, r) if c else None, c) for h, s, (r, c) in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), _sources(batch, refs), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html: empty text. Pages without url or host, and hosts of fewer than LEAST_PAGES pages, have no template. Of pages with equal
    page_id the first by html is the reference. White space in a block is one space; blocks are joined by one line feed.
    """
    spark = pages.sparkSession
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    refs = materialize(rows.where("host is not null and html <> '' and page_id is not null").groupBy("host").agg(F.min(F.struct("page_id", "html")).alias("r")).select("host", F.col("r.html").alias("ref_html")), "html-refs")
    size = refs.agg(F.sum(F.length("ref_html") + F.length("host"))).first()[0] or 0
    if size <= max_broadcast:
        shared = spark.sparkContext.broadcast({r.host: (r.ref_html, frozenset()) for r in refs.collect()})
        surveyed = rows.select("host", "html").mapInArrow(_survey(shared), "host string, node long, text long, n long")
    else:
        none = F.array().cast("array<struct<node:long,text:long>>")
        surveyed = rows.select("host", "html").join(refs, "host").withColumn("constant", none).mapInArrow(_survey(None), "host string, node long, text long, n long")
    counts = surveyed.groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "html-counts")
    pages_of = counts.where("node = -1").select("host", F.col("n").alias("pages"))
    fixed = counts.where("node >= 0").join(pages_of, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("pages")))
    wrappers = refs.join(fixed.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("constant")), "host")
    if size <= max_broadcast:
        known = {r.host: (r.ref_html, frozenset((c.node, c.text) for c in r.constant)) for r in wrappers.collect()}
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(spark.sparkContext.broadcast(known)), "page_id long, url string, text string, n_chars long")
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "ref_html", "constant").mapInArrow(_extract(None), "page_id long, url string, text string, n_chars long")
