"""Main text of web pages by a site style tree (operator 9).

The pages of a host, articles included, are merged into one tree whose nodes are paths of tags and classes;
inline elements belong to their block. A node with text of its own has the content importance
1 - mean(log k) / log(m + SMOOTH) over its texts, k of its m pages having the text; its presentation importance
is the entropy of its sequences of children over log(m + SMOOTH). SMOOTH makes few pages weak evidence instead of
none: by LEAST, what three pages share goes, what two share stays, and on a million pages a text may recur eight
times. A branch's importance combines its presentation with its content's and its children's mean, GAMMA to one.
A branch is noise, and removed, if it and all branches below have less than LEAST; so is a node's own text by its
content alone. Article and main elements, and what holds them, stay. What an article says is main text however often its
host repeats it: inside, headings, paragraphs and other blocks of text aren't judged by themselves, only whole
wrappers, lists and tables only if they are mostly links; and if that were more than MOST_GONE of the page's articles, none
of it goes. If nothing would be left of a page, the tree doesn't count for it.

Adverts, footers and notices with other words on each page have the entropy of an article, so tags, roles and
the words of classes and ids are a prior: what they name as no main text has importance 0.

Defined results. Null html: no text. Null or odd url: the host is empty. Pages without an article or main
element: all of body that remains. Rows that repeat a page_id: each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, stored, table

GAMMA = 0.9
LEAST = 0.85
SMOOTH = 100
#: Share of the text of a page's articles that the tree may remove.
MOST_GONE = 2 / 3
#: Tree nodes of all hosts up to which they are broadcast; more go to the pages by host and salt.
MOST_BROADCAST = 100_000
#: Pages of a host that share a salt.
PAGES_PER_SALT = 1024

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Never main text, whatever the tree says.
DROP_TAGS = frozenset("head nav footer aside form script style noscript template title button select input textarea label iframe object embed svg canvas menu dialog audio video datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments respond disqus replies reply related recommended share sharing social widget widgets toolbar pagination pager login signup search form".split())
#: Never main text outside an article.
DROP_OUTSIDE = frozenset("header footer masthead topbar bottombar copyright".split())
MAIN = frozenset({"article", "main"})
#: What the tree may remove of an article: wrappers, and lists if they are mostly links.
WRAPPERS = frozenset("address aside center details dialog div fieldset figure footer form header hgroup menu nav section".split())
LISTS = frozenset("dir dl ol table ul".split())
#: A start tag ends an open element of these, looked for up to one of the second.
ENDS = {**{t: ({"p"}, frozenset("td th li article section div body button".split())) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}, "li": ({"li"}, frozenset({"ul", "ol", "menu"})), "dt": ({"dt", "dd"}, frozenset({"dl"})), "dd": ({"dt", "dd"}, frozenset({"dl"})), "tr": ({"tr"}, frozenset({"table"})), "td": ({"td", "th"}, frozenset({"table"})), "th": ({"td", "th"}, frozenset({"table"})), "option": ({"option"}, frozenset({"select"}))}
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PIECES = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "path", "parent", "children", "drop", "main")

    def __init__(self, tag: str, path: int, parent: Node | None, drop: bool, main: bool) -> None:
        self.tag, self.path, self.parent, self.children, self.drop, self.main = tag, path, parent, [], drop, main


@lru_cache(100_000)
def _step(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent} {label}") - (1 << 63)


@lru_cache(20_000)
def _style(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """The label in the tree, with runs of three digits or more as one, and whether the element goes."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = found.get("class", "") + " " + found.get("id", "")
    pieces = {x.lower() for x in _PIECES.split(names)}
    drop = tag in DROP_TAGS or (tag == "header" and not in_main) or found.get("role", "").lower() in DROP_ROLES or bool(pieces & DROP_NAMES) or (not in_main and bool(pieces & DROP_OUTSIDE)) or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    return f"{tag}.{re.sub(r'[0-9]{3,}', '0', found.get('class', ''))}", drop and tag not in ("html", "body")


def _keep_mains(mains: list[Node]) -> None:
    """Outermost article and main elements keep what holds them; if all of them would go by their names, none goes."""
    if all(x.drop for x in mains):
        for x in mains:
            x.drop = False
    for x in mains:
        y = None if x.drop else x.parent
        while y is not None:
            y.drop, y = False, y.parent


def parse(html: str) -> Node:
    """The page's tree: children are Nodes and strings. Copes with unclosed and stray tags."""
    root = now = Node("", 0, None, False, False)
    at, low = 0, None
    mains: list[Node] = []
    while True:
        m = _MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            now.children.append(unescape(text))
        if not m:
            _keep_mains(mains)
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            x = now
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                now = x.parent
            continue
        if tag in ENDS:
            closed, bounds = ENDS[tag]
            x = now
            while x is not root and x.tag not in closed and x.tag not in bounds:
                x = x.parent
            if x.tag in closed:
                now = x.parent
        label, drop = _style(tag, m[3] or "", now.main)
        node = Node(tag, _step(now.path, label), now, drop, now.main or tag in MAIN)
        now.children.append(node)
        if tag in MAIN and not now.main:
            mains.append(node)
        if tag in RAW:
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            if end < 0 or len(low) != len(html):
                found = re.compile(f"</{tag}", re.I).search(html, at)
                end = found.start() if found else len(html)
            node.children.append(html[at:end])
            at = html.find(">", end) + 1 or len(html)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            now = node


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in x.children if isinstance(c, Node) and not c.drop]


def _judged(x: Node) -> bool:
    """Inline elements are part of their block."""
    return x.tag in BLOCK


def _below(x: Node) -> tuple[str, list[Node]]:
    """A block's own text, with that of its inline elements, and the nearest blocks below, through inline elements."""
    parts: list[str] = []
    out: list[Node] = []
    stack = x.children[::-1]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.drop:
            if _judged(c):
                out.append(c)
            else:
                stack += c.children[::-1]
    return _clean(parts), out


_NODE = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int8()), ("what", pa.int64())])
#: Kinds of rows: one a page and path; a text's hash; the hash of the sequence of children.
PAGE, TEXT, STYLE = 0, 1, 2


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: set[tuple] = set()
        rows: list[tuple] = []
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            out.clear()
            for x in nodes(parse(html.as_py() or "")):
                if x.parent is None or not _judged(x):
                    continue
                out.add((host, x.path, PAGE, 0))
                text, below = _below(x)
                if text:
                    out.add((host, x.path, TEXT, xxhash.xxh3_64_intdigest(text) - (1 << 63)))
                style = " ".join(str(c.path) for c in below)
                out.add((host, x.path, STYLE, xxhash.xxh3_64_intdigest(style) - (1 << 63)))
            rows += out
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, _NODE, strict=True)], schema=_NODE)


def site_trees(pages: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """host, path, content (null without text) and style of the nodes that several pages have. All sums are partial before they are shuffled."""
    seen = in_arrow(pages.select("host", "html"), _observe, "host string, path long, kind byte, what long").groupBy("host", "path", "kind", "what").agg(F.count(F.lit(1)).alias("k"))
    one = lambda kind, x: F.when(F.col("kind") == kind, x)
    k = F.col("k").cast("double")
    sums = seen.groupBy("host", "path").agg(
        F.max(one(PAGE, F.col("k"))).alias("m"), F.avg(one(TEXT, F.log(k))).alias("log_text"),
        F.sum(one(STYLE, k * F.log(k))).alias("k_log_k"))
    m = F.col("m").cast("double")
    whole = F.log(m + smooth)
    content, style = 1 - F.col("log_text") / whole, 1 - F.col("k_log_k") / m / whole
    return sums.where("m > 1").select("host", "path", content.alias("content"), style.alias("style"))


def _noise(order: list[Node], tree: dict[int, tuple[float | None, float]], gamma: float, least: float) -> tuple[set[int], set[int]]:
    """Ids of the blocks that are noise, and of those whose own text is. order: parents before their children."""
    kept: set[int] = set()
    for x in order:
        if x.tag in MAIN:
            y = x
            while y is not None and id(y) not in kept:
                kept.add(id(y))
                y = y.parent
    worth: dict[int, float | None] = {}
    noise: set[int] = set()
    mute: set[int] = set()
    for x in reversed(order):
        if not _judged(x):
            continue
        text, below = _below(x)
        content, style = tree.get(x.path, (1.0, 1.0))
        parts = [w for c in below if (w := worth[id(c)]) is not None]
        if text:
            parts.append(1.0 if content is None else content)
        # a branch without text has no say
        worth[id(x)] = w = None if not parts else parts[0] if not below else (1 - gamma) * style + gamma * sum(parts) / len(parts)
        if id(x) in kept:
            continue
        if text and content is not None and content < least:
            mute.add(id(x))
        if w is not None and w < least and all(id(c) in noise or worth[id(c)] is None for c in below):
            noise.add(id(x))
    return noise, mute


def _length(x: Node, linked: bool) -> int:
    """Characters of a branch's text, all or those within links."""
    n, stack = 0, [(x, False)]
    while stack:
        x, link = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                n += len("".join(c.split())) if link or not linked else 0
            elif not c.drop:
                stack.append((c, link or c.tag == "a"))
    return n


def _spared(order: list[Node], noise: set[int], mute: set[int]) -> None:
    """Takes back what would go of articles but isn't a wrapper, or a list of links, or if it were too much of them."""
    for x in order:
        if x.main:
            mute.discard(id(x))
            if id(x) in noise and not (x.tag in WRAPPERS or x.tag in LISTS and 2 * _length(x, True) >= _length(x, False)):
                noise.discard(id(x))
    inside = [x for x in order if x.main and id(x) in noise]
    # branches within others that go don't count twice
    tops = [x for x in inside if not any(id(y) in noise for y in _above(x))]
    if tops and sum(_length(x, False) for x in tops) > MOST_GONE * sum(_length(x, False) for x in order if x.main and not x.parent.main):
        noise.difference_update(map(id, inside))


def _above(x: Node) -> Iterator[Node]:
    while (x := x.parent) is not None:
        yield x


def main_text(root: Node, tree: dict[int, tuple[float | None, float]], gamma: float = GAMMA, least: float = LEAST) -> str:
    """The page's blocks without what goes. tree: path -> content and presentation importance."""
    order = list(nodes(root))
    noise, mute = _noise(order, tree, gamma, least) if tree else (set(), set())
    if noise or mute:
        _spared(order, noise, mute)
    has_main = any(x.tag in MAIN for x in order)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := _clean(line):
            blocks.append(text)
        line.clear()

    stack: list[tuple] = [(root, False)]
    while stack:
        x, silent = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not silent:
                line.append(x)
        elif x.tag == "br":
            line.append("\n")
        elif not x.drop and id(x) not in noise:
            if _judged(x):
                flush()
                stack.append((None, False))
                silent = id(x) in mute
            stack += [(c, silent) for c in reversed(x.children) if isinstance(c, Node) or x.main or not has_main]
    flush()
    if not blocks and tree:
        return main_text(root, {}, gamma, least)
    return "\n\n".join(blocks)


_IN = "kind byte, page_id long, url string, html string, host string, path long, content double, style double"


def _texts(b: pa.RecordBatch, tree) -> pa.RecordBatch:
    """tree: from a host to its nodes."""
    texts = [main_text(parse(html.as_py() or ""), tree(host)) for html, host in zip(b.column("html"), b.column("host").to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by host; a host's nodes come before its pages."""
    now, own = None, {}
    for b in batches:
        is_page = pa.array([k == 1 for k in b.column("kind").to_pylist()], pa.bool_())
        at = 0
        for i, (page, host) in enumerate(zip(is_page.to_pylist(), b.column("host").to_pylist(), strict=True)):
            if host != now:
                if at < i:
                    yield _texts(b.slice(at, i - at).filter(is_page.slice(at, i - at)), lambda _, own=own: own)
                now, own, at = host, {}, i
            if not page:
                own[b.column("path")[i].as_py()] = (b.column("content")[i].as_py(), b.column("style")[i].as_py())
        yield _texts(b.slice(at).filter(is_page.slice(at)), lambda _, own=own: own)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    trees = stored(site_trees(rows), "trees")
    result = "page_id long, url string, text string, n_chars long"
    if trees.count() <= MOST_BROADCAST:
        found: dict[str, dict] = {}
        for h, path, content, style in zip(*(c.to_pylist() for c in trees.select("host", "path", "content", "style").toArrow().columns), strict=True):
            found.setdefault(h, {})[path] = (content, style)
        held = pages.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _texts(b, lambda h: held.value.get(h, {}))

        return in_arrow(rows, run, result)
    sizes = stored(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PAGES_PER_SALT).cast("int").alias("salts")), "salts")
    nodes = trees.join(sizes, "host").select(F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "path", "content", "style", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = rows.join(sizes, "host").select(F.lit(1).cast("byte").alias("kind"), "page_id", "url", "html", "host", F.lit(None).cast("long").alias("path"), F.lit(None).cast("double").alias("content"), F.lit(None).cast("double").alias("style"), F.pmod(F.xxhash64("page_id", "url", "html"), F.col("salts")).cast("int").alias("salt"))
    both = nodes.unionByName(dealt).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind")
    # two salts of a host in one task read its nodes twice
    return in_arrow(both.select(*(c.split()[0] for c in _IN.split(", "))), _by_host, result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
