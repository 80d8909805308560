"""Main text of HTML pages by wrapper induction.

Pages of one host are aligned.  A page becomes a small tree of its block
elements (tag and class; runs of like siblings are one node) whose nodes hold
the hashes of their text blocks.  Simple tree matching aligns two trees: equal
roots, and the best order-preserving matching of their children.  Aligned
pages merge into the host's wrapper, which counts at every node how many pages
hold which text.  A text that (nearly) all pages of the host hold at an
aligned node is template; the varying slots are content.  Content inside
elements that serve as menu, header, footer, sidebar, notice, advert, form or
reader comments is left out, and so are scripts, styles and markup.  A left-out inline
element (button, marked span or link) does not break the block around it.

Wrappers are built from many small groups of pages, dealt by host and salt, and
merged in rounds of bounded fan-in, so a host with a third of all pages is
spread over many tasks.  Trees are walked by loops and packed flat, so elements
may nest to any depth.  Only trees of hashes are shuffled.  Nodes that cannot become template
any more are pruned, which bounds a wrapper.  Pages meet their host's wrapper
by a join that the planner broadcasts when the written wrappers are small.

Defined results: NULL or empty html has the text ''; a page without a host
belongs to the host ''; a host with fewer than ``MIN_PAGES`` different pages
has no template; copies of a page count once in its wrapper, and every copy
gets its text; an empty table gives an empty table; other columns are carried
through.
"""

from __future__ import annotations

import html as _html
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, stored, table
from .line_dedup import host_of

# --- fixed values -----------------------------------------------------------
MIN_PAGES = 8                 # different pages before a host has a template
MIN_SHARE = 0.9               # pages that hold a template text at its node
PRUNE_SHARE = 0.3             # a text on fewer pages of a group is no template
SALT_PAGES = 200              # pages aligned in one task step, about
FAN_IN = 16                   # wrappers merged in one task step
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video".split())
LEFT_OUT = RAW | frozenset(
    "head title nav aside footer form button select option textarea label menu dialog fieldset"
    .split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split())
# words of class, id and role that mark an element as no part of the article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments respond "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended widget pagination pager contentinfo "
    "complementary search dialog toolbar skip masthead topbar disqus".split())
ATOMIC = frozenset("button select option".split())     # boxes: words do not join across them
CLOSES_P = BLOCK - {"body", "html"}
# ---------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW | {"title", "textarea"}}


class Node:
    """A node of a page or wrapper: signature, pages, texts, children."""
    __slots__ = ("kids", "n", "shape", "sig", "size", "texts")

    def __init__(self, sig: str, n: int = 1, texts: dict | None = None):
        self.sig, self.n, self.texts, self.kids = sig, n, {} if texts is None else texts, []
        self.size = self.shape = None


def preorder(a: Node) -> list[Node]:
    """The nodes of a tree, each before its children, in order."""
    out, todo = [], [a]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def pack(a: Node) -> bytes:
    """A tree of any depth as one flat list."""
    return pickle.dumps([(x.sig, x.n, x.texts, len(x.kids)) for x in preorder(a)], 5)


def unpack(raw: bytes) -> Node:
    root = Node("")
    open_ = [(root, 1)]
    for sig, n, texts, kids in pickle.loads(raw):
        while not open_[-1][1]:
            open_.pop()
        up, left = open_.pop()
        x = Node(sig, n, texts)
        up.kids.append(x)
        open_ += [(up, left - 1), (x, kids)]
    return root.kids[0]


def measure(a: Node) -> Node:
    """Sets the size of every subtree and a digest of its shape."""
    if a.shape is None:
        for x in reversed(preorder(a)):
            if x.shape is None:
                x.size = 1 + sum(k.size for k in x.kids)
                x.shape = xxhash.xxh3_128_digest(
                    b"".join((x.sig.encode("utf-8", "replace"), b"\0", *(k.shape for k in x.kids))))
    return a


def _marked(tag: str, attrs: str, in_article: bool) -> tuple[bool, str]:
    """Is the element no part of the article, and its class for the tree."""
    out, cls = tag in LEFT_OUT or (tag == "header" and not in_article), ""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        value = a or b or c
        if name.lower() == "class":
            cls = value
        if not out and tag not in ("body", "html", "article", "main"):
            parts = [p.lower() for p in _PART.findall(value)]
            # side-bar and sideBar are spellings of sidebar
            out = not MARKS.isdisjoint(parts) or not MARKS.isdisjoint(map("".join, zip(parts, parts[1:])))
    return out, cls


def parse(page: str) -> tuple[Node, list[tuple[str, Node, bool, bool]]]:
    """The tree of a page and its text blocks in order: text, node, left out
    by its element, inside an article."""
    root = Node("#")
    blocks: list[tuple[str, Node, bool, bool]] = []
    # open elements: tag, node, left out, inside article; a left-out inline
    # element also holds the text of its parent, which goes on after it
    stack: list[tuple] = [("#", root, False, False, None)]
    where: dict[str, list[int]] = defaultdict(list)       # places of open tags
    buf: list[str] = []

    def flush():
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                _, node, out, art, _ = stack[-1]
                node.texts[xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))] = 1
                blocks.append((text, node, out, art))

    def close(k: int):
        nonlocal buf
        while len(stack) > k:
            tag, *_, held = stack[-1]
            if tag in BLOCK or held is not None:
                flush()
            stack.pop()
            where[tag].pop()
            if held is not None:
                buf = held

    def last_open(tags) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    def close_open(tags, until):
        k = last_open(tags)
        if k > last_open(until):
            close(k)

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            buf.append(page[pos:])
            break
        if m.start() > pos:
            buf.append(page[pos:m.start()])
        pos = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag, end = tag.lower(), m.group(1) or m.group(4)
        attrs = m.group(3) if m.group(2) else m.group(6)
        if end:
            if where[tag]:
                close(where[tag][-1])
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW or tag in ("title", "textarea"):
            if not attrs.rstrip().endswith("/"):
                end = _END[tag].search(page, pos)
                pos = end.end() if end else n
                at = page.find(">", pos)
                pos = n if at < 0 else at + 1
            continue
        if tag in CLOSES_P:
            close_open(("p",), ("table", "td", "th", "button"))
        if tag == "li":
            close_open(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close_open(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            close_open(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            close_open(("tr",), ("table",))
        elif tag == "body":
            close_open(("head",), ())
        _, node, out, art, _ = stack[-1]
        no, cls = _marked(tag, attrs, art)
        art = art or tag in ("article", "main")
        held = None
        if tag in BLOCK:
            flush()
        elif no:
            if tag in ATOMIC:
                buf.append(" ")
            held, buf = buf, []
        if tag in BLOCK or no:
            sig = f"{tag}.{cls}" if cls else tag
            kids = node.kids
            if not kids or kids[-1].sig != sig:
                kids.append(Node(sig))
            node = kids[-1]
        where[tag].append(len(stack))
        stack.append((tag, node, out or no, art, held))
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            close(len(stack) - 1)
    close(1)
    flush()
    return root, blocks


def _matched_kids(a: Node, b: Node, memo: dict) -> list[tuple[int, int]]:
    """Best order-preserving matching of the children of two nodes, from the
    sizes of their children's matchings in ``memo``."""
    x, y = a.kids, b.kids
    lo, hi_x, hi_y = 0, len(x), len(y)
    # equal subtrees at either end match in some best matching
    while lo < min(hi_x, hi_y) and x[lo].shape == y[lo].shape:
        lo += 1
    while lo < min(hi_x, hi_y) and x[hi_x - 1].shape == y[hi_y - 1].shape:
        hi_x, hi_y = hi_x - 1, hi_y - 1
    pairs = [(i, i) for i in range(lo)]
    tail = [(i, i - hi_x + hi_y) for i in range(hi_x, len(x))]
    # only children whose signature the other side has can match
    sigs = {k.sig for k in x[lo:hi_x]} & {k.sig for k in y[lo:hi_y]}
    rows = [i for i in range(lo, hi_x) if x[i].sig in sigs]
    cols = [j for j in range(lo, hi_y) if y[j].sig in sigs]
    best = [[0] * (len(cols) + 1)]
    for i in rows:
        up, row, sig = best[-1], [0], x[i].sig
        for c, j in enumerate(cols):
            w = up[c] + memo[id(x[i]), id(y[j])] if y[j].sig == sig else 0
            row.append(max(up[c + 1], row[c], w))
        best.append(row)
    r, c, inner = len(rows), len(cols), []
    while r and c:
        i, j = rows[r - 1], cols[c - 1]
        if x[i].sig == y[j].sig and best[r][c] == best[r - 1][c - 1] + memo[id(x[i]), id(y[j])]:
            inner.append((i, j))
            r, c = r - 1, c - 1
        elif best[r][c] == best[r - 1][c]:
            r -= 1
        else:
            c -= 1
    return pairs + inner[::-1] + tail


def matching(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the best matching of two trees with
    equal roots, and the matched children.  ``memo`` holds the sizes; the walk
    is a loop, so trees may be of any depth."""
    measure(a), measure(b)
    todo, pairs = [(a, b, False)], []
    while todo:
        x, y, ready = todo.pop()
        key = id(x), id(y)
        if not ready:
            if key in memo and x is not a:
                continue
            if x.shape == y.shape:
                memo[key] = x.size
                pairs = [(i, i) for i in range(len(x.kids))]
                continue
            todo.append((x, y, True))
            by_sig = defaultdict(list)
            for k in y.kids:
                by_sig[k.sig].append(k)
            todo += [(k, m, False) for k in x.kids for m in by_sig.get(k.sig, ()) if (id(k), id(m)) not in memo]
        else:
            pairs = _matched_kids(x, y, memo)
            memo[key] = 1 + sum(memo[id(x.kids[i]), id(y.kids[j])] for i, j in pairs)
    return memo[id(a), id(b)], pairs


def merge(a: Node, b: Node, memo: dict | None = None) -> Node:
    """The wrapper of the pages of two wrappers with equal roots."""
    memo = {} if memo is None else memo
    top = Node(a.sig)
    todo = [(a, b, top)]
    while todo:
        x, y, out = todo.pop()
        _, pairs = matching(x, y, memo)
        out.n, out.texts = x.n + y.n, dict(x.texts)
        for h, c in y.texts.items():
            out.texts[h] = out.texts.get(h, 0) + c
        i = j = 0
        for p, q in [*pairs, (len(x.kids), len(y.kids))]:
            out.kids += x.kids[i:p] + y.kids[j:q]
            if p < len(x.kids):
                out.kids.append(Node(x.kids[p].sig))
                todo.append((x.kids[p], y.kids[q], out.kids[-1]))
            i, j = p + 1, q + 1
    return top


def prune(a: Node, pages: int) -> Node:
    """Drops what too few pages hold to be template of any larger set that
    these pages are a part of (only the share can fall from here on)."""
    least = PRUNE_SHARE * pages
    top = Node(a.sig, a.n)
    todo = [(a, top)]
    while todo:
        x, out = todo.pop()
        out.texts = {h: c for h, c in x.texts.items() if c >= least}
        for k in x.kids:
            if k.n >= least:
                out.kids.append(Node(k.sig, k.n))
                todo.append((k, out.kids[-1]))
    return top


def _merge_all(trees: list[Node]) -> Node:
    out = trees[0]
    for k, t in enumerate(trees[1:], 2):
        out = merge(out, t)
        if k % 16 == 0:
            out = prune(out, out.n)
    return prune(out, out.n)


def main_text(page: str | None, wrapper: Node | None) -> str:
    """Text blocks of a page that are neither template nor left out, joined
    by \\n; within an article or main element if one holds text."""
    if not page:
        return ""
    root, blocks = parse(page)
    constant: dict[int, set[int]] = {}
    if wrapper is not None and wrapper.n >= MIN_PAGES:
        memo: dict = {}
        todo = [(root, wrapper)]
        while todo:
            x, w = todo.pop()
            fixed = {h for h, c in w.texts.items() if c >= MIN_SHARE * wrapper.n}
            if fixed:
                constant[id(x)] = fixed
            todo += [(x.kids[i], w.kids[j]) for i, j in matching(x, w, memo)[1]]
    kept = [(text, art) for text, node, out, art in blocks if not out and not (
        id(node) in constant
        and xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) in constant[id(node)])]
    inside = [t for t, art in kept if art]
    return "\n".join(inside or [t for t, _ in kept])


def _trees(pages: DataFrame) -> DataFrame:
    """host, digest of the page's texts and packed tree of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, digests, trees = [], [], []
            for h, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root, blocks = parse(x.as_py() or "")
                if blocks:
                    inner = [t for t, _, out, _ in blocks if not out] or [t for t, *_ in blocks]
                    hosts.append(h)
                    digests.append(xxhash.xxh3_64_intdigest("\n".join(inner).encode("utf-8", "replace"))
                                   - (1 << 63))
                    trees.append(pack(root))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.int64()),
                 pa.array(trees, pa.binary())], names=["host", "digest", "tree"])
    return pages.mapInArrow(run, "host string, digest bigint, tree binary")


def _dealt(trees: DataFrame) -> DataFrame:
    """(host, salt, tree) of the hosts with enough pages, each salt of a host
    in a task of its own: without dealing by both keys anew, all salts of a
    host would stay together after the join."""
    sizes = trees.groupBy("host").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_PAGES)
    salts = F.ceil(F.col("m") / SALT_PAGES).cast("int")
    part = trees.join(sizes.select("host", salts.alias("salts")), "host")
    part = part.withColumn("salt", F.pmod("digest", F.col("salts")).cast("int")).drop("salts", "digest")
    return part.repartition("host", "salt")


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper (packed) of every host of ``pages(host, html)``."""
    part = _dealt(stored(_trees(pages).dropDuplicates(["host", "digest"]), "trees"))

    def align(t: pa.Table) -> pa.Table:
        w = _merge_all([unpack(x) for x in t.column("tree").to_pylist()])
        return pa.table({"host": t.column("host")[:1], "salt": t.column("salt")[:1],
                         "tree": pa.array([pack(w)], pa.binary())})

    level = stored(part.groupBy("host", "salt").applyInArrow(
        align, "host string, salt int, tree binary"), "wrappers")
    while level.agg(F.max("salt").alias("s")).first()["s"] or 0:
        up = level.withColumn("salt", (F.col("salt") / FAN_IN).cast("int"))
        level = stored(up.groupBy("host", "salt").applyInArrow(
            align, "host string, salt int, tree binary"), "wrappers")
    return level.select("host", F.col("tree").alias("wrapper"))


def extract(df: DataFrame, *, url_col: str = "url", html_col: str = "html",
            text_col: str = "text") -> DataFrame:
    """``df`` without ``html_col``, with the main text in ``text_col``."""
    k_host, k_wrap = hidden(df, "host", "wrapper")
    pages = df.withColumn(k_host, host_of(F.col(f"`{url_col}`")))
    wrappers = induce(pages.select(F.col(k_host).alias("host"), F.col(html_col).cast("string").alias("html")))
    joined = pages.join(wrappers.toDF(k_host, k_wrap), k_host, "left")

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[int, Node | None] = {}
        for page, wrap in parts:
            out = []
            for x, w in zip(page, wrap, strict=True):
                key = hash(w) if w is not None else 0
                if key not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[key] = unpack(w) if w is not None else None
                out.append(main_text(x, known[key]))
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, "string")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (html_col, text_col)]
    return joined.select(*keep, udf(F.col(f"`{html_col}`").cast("string"), F.col(k_wrap)).alias(text_col))


def op1_html_wrapper(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``pages`` table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
