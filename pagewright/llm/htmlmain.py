"""Main text of web pages by a site style tree.

The pages of a host share templates.  Their DOMs are merged into one tree: a
node of it is a path of block elements with their classes, and holds, over the
host's pages, how many pages have it, which child sequences (presentations) it
has and in how many pages each, and which text blocks and links (contents) stand
in it and in how many pages each.  With m pages, c_s pages of presentation s and
c_i pages of content i out of l,

    presentation importance = - sum_s (c_s / m) log_m (c_s / m)
    content importance      = 1 - sum_i log_m(c_i) / l
    importance              = (1 - GAMMA) * presentation + GAMMA * content

and 1 where m is 1.  A node of low importance says the same on every page.

What elements and classes say of themselves is a prior by which a block's
importance is multiplied.  Elements that are defined as no content (``nav``,
``footer``, forms, ...) weigh 0.  A class, id or role all of whose words name
something else than content, and at least one of them a menu, advert, comments
or the like, weighs ``NAMED`` for each element around the block; that is
relative to the page's best block, so a whole page inside such an element loses
nothing, and ``right-sidebar`` or ``search-results`` weigh nothing.  An article or
main element moves the bound.

Counts are partial aggregates by (host, node, content), so a host with a third
of all pages is no single task; only the low nodes of each host come back to the
pages.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagewright.llm.common import map_batches, saved
from pagewright.llm.urlfilter import split_url

GAMMA = 0.9
LOW = 0.3
#: In a page with an article or main element, the bound of importance is so many times lower inside it and higher outside.
EVIDENCE = 2.0
MIN_PAGES = 3
#: Low nodes travel with the tasks up to this many, beyond they are joined to each page's own nodes.
BROADCAST_NODES = 200_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^<>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {t: re.compile(rf"</{t}[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "select", "object", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag ends, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
NO_CONTENT = frozenset("nav footer aside form head menu dialog button search title".split())
#: Weight of a class that names no content.
NAMED = 0.2
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer header masthead topbar toolbar cookie cookies notice notification consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments disqus reply replies respond widget copyright disclaimer skip form navigation complementary contentinfo".split()
)
#: Words that may stand beside those of ``NO_CONTENT_NAMES`` in one class without saying anything else.
NEUTRAL_NAMES = frozenset("site page main global top bottom box block section area container wrapper wrap inner body list item bar buttons links text area post article".split())
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("articlebody main".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


def _hash(s: str, parent: int = 0) -> int:
    h = xxh64_intdigest(s.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def no_content_name(name: str) -> bool:
    """Whether a class, id or role names a part of a page that is no content, and nothing else."""
    words = WORD.findall(name)
    return not NO_CONTENT_NAMES.isdisjoint(words) and all(w in NO_CONTENT_NAMES or w in NEUTRAL_NAMES for w in words)


class _Open:
    """The open elements, innermost last: (tag, node, prior, main), with the places of every tag and of the blocks."""

    def __init__(self):
        self.stack: list[tuple[str, int, float, bool]] = [("", 0, 1.0, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, node: int, prior: float, main: bool, block: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, prior, main))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()


class Page:
    """One page, scanned once, in time linear in its length.

    A node is a number made of its parent's and its own step (element and
    classes).  ``blocks``: (node, text, prior, main) in page order; ``prior`` is
    the product of the weights around the block, ``main`` says that it stands in
    an article or main element.  ``shapes``: node -> child sequence.  ``links``:
    (node, href).  ``has_main``: whether there is an article or main element.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, float, bool]] = []
        self.shapes: dict[int, list[str]] = {}
        self.links: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.has_main = False
        self.open = _Open()
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self.text.append(html[at:])
                break
            if m.start() > at:
                self.text.append(html[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                self._end(tag)
            elif tag in RAW and not m.group(3).rstrip().endswith("/"):
                end = RAW[tag].search(html, at)
                at = end.end() if end else n
                self.text.append(" ")
            else:
                self._start(tag, m.group(3))
        self._flush()

    def _flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", unescape("".join(self.text))).strip()
            self.text.clear()
            if text:
                _, node, prior, main = self.open.stack[-1]
                self.blocks.append((node, text, prior, main))

    def _close(self, tags, stop) -> None:
        place = self.open.last(tags)
        if place > self.open.last(stop):
            self._flush()
            self.open.cut(place)

    def _start(self, tag: str, rest: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            self._close(("p",), ("button", "td", "th", "table", "object"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        elif tag == "br":
            self.text.append(" ")
        _, node, prior, main = self.open.stack[-1]
        names: list[str] = []
        if rest and not rest.isspace():
            got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
            if tag == "a" and "href" in got:
                self.links.append((node, got["href"]))
            names = " ".join(got[k] for k in ("class", "id", "role", "itemprop") if k in got).lower().split()
        if tag in VOID:
            return
        if block:
            # numbers in a name tell pages apart, not places of the template
            step = tag + "".join(sorted({f".{w}" for name in names for w in WORD.findall(name)}))
            self.shapes.setdefault(node, []).append(step)
            node = _hash(step, node)
            self.shapes.setdefault(node, [])
        if tag in MAIN or any(name in MAIN_NAMES for name in names):
            main = self.has_main = True
        if tag in NO_CONTENT or (tag == "header" and not main):
            prior = 0.0
        elif tag not in ("html", "body", "main") and any(map(no_content_name, names)):
            prior *= NAMED
        self.open.push(tag, node, prior, main, block)

    def _end(self, tag: str) -> None:
        place = self.open.last((tag,))
        if not place:
            if tag == "p":
                self._flush()
            return
        inside = self.open.blocks[-1]
        if tag in BLOCK or inside == place:
            self._flush()
        elif inside > place:
            return  # an inline end tag closes nothing outside its block
        self.open.cut(place)

    def facts(self):
        """(node, kind, value) for the tree, each once: 0 the node, 1 its presentation, 2 a text, 3 a link."""
        out = set()
        for node, steps in self.shapes.items():
            shape = [s for i, s in enumerate(steps) if not i or s != steps[i - 1]]
            out.add((node, 0, 0))
            out.add((node, 1, _hash(" ".join(shape))))
        for node, text, _, _ in self.blocks:
            out.add((node, 2, _hash(text)))
        for node, href in self.links:
            out.add((node, 3, _hash(href)))
        return out

    def main_text(self, importance, low: float = LOW) -> list[str]:
        """The blocks whose importance, times their prior, reaches the bound.

        ``importance`` maps a node to its importance; a node that is not in it has 1.  The prior counts relative to that of the
        page's best block, or to the best one inside where an article or main element has blocks; outside of such an element it
        counts as it is.  The bound is ``low``; an article or main element with blocks is evidence, and moves it by ``EVIDENCE``.
        Where only the tree speaks against all that a page, or its element, has, the page is a copy of others of its host, and
        the element's or else all blocks stay that the priors leave.
        """
        content = [b for b in self.blocks if b[2]]
        inside = [b for b in content if b[3]]
        best = max((b[2] for b in inside or content), default=1.0)
        scale = {True: best, False: 1.0 if self.has_main else best}
        content = [(b[0], b[1], b[2] / scale[b[3]], b[3]) for b in content]
        bound = {True: low / EVIDENCE, False: low * EVIDENCE} if inside else {False: low}
        kept = [b[1] for b in content if b[2] >= low and b[2] * importance.get(b[0], 1.0) >= bound[b[3]]]
        return kept or [b[1] for b in content if b[2] >= low and (b[3] or not inside)]


def _host(url: str | None) -> str:
    return split_url(url.encode())[0].decode() if url is not None else ""


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every node of every host's merged tree."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        host, node, kind, value = [], [], [], []
        for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h:
                name = _host(u)
                for k, t, v in Page(h).facts():
                    host.append(name), node.append(k), kind.append(t), value.append(v)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(kind, pa.int8()), pa.array(value, pa.int64())], names=["host", "node", "kind", "value"])

    facts = map_batches(pages.select("url", "html"), run, "host string, node bigint, kind tinyint, value bigint")
    counts = facts.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    when = lambda kind, x: F.sum(F.when(F.col("kind").isin(*kind), x).otherwise(F.lit(0.0)))
    c = F.col("c").cast("double")
    sums = counts.groupBy("host", "node").agg(
        when((0,), c).alias("m"), when((1,), c * F.log(c)).alias("shapes"), when((2, 3), F.log(c)).alias("contents"), when((2, 3), F.lit(1.0)).alias("l")
    )
    log_m = F.log("m")
    presentation = F.when(F.col("m") <= 1, 1.0).otherwise((log_m - F.col("shapes") / F.col("m")) / log_m)
    content = F.when((F.col("m") <= 1) | (F.col("l") == 0), 1.0).otherwise(1 - F.col("contents") / (F.col("l") * log_m))
    return sums.select("host", "node", F.col("m").cast("bigint").alias("pages"), ((1 - GAMMA) * presentation + GAMMA * content).alias("importance"))


def _low_of_pages(rows: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``low``, those of the page's own nodes that are low on its host; no group is larger than a page."""
    host = F.translate(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = rows.select("*", host.alias("__host"), F.struct(F.col(id_col), F.xxhash64("url"), F.xxhash64("html")).alias("__page"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, node = [], []
        for i, h in enumerate(batch.column(2).to_pylist()):
            if h:
                own = {b[0] for b in Page(h).blocks}
                which += [i] * len(own)
                node += own
        take = pa.array(which, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(node, pa.int64())], names=["__page", "host", "node"])

    page_kind = keyed.schema["__page"].dataType.simpleString()
    own = map_batches(keyed.select("__page", F.col("__host").alias("host"), "html"), run, f"__page {page_kind}, host string, node bigint")
    low = own.join(nodes, ["host", "node"]).groupBy("__page").agg(F.collect_list(F.struct("node", "importance")).alias("low"))
    return keyed.join(low, "__page", "left").select(id_col, "url", "html", "low")


def main_text(pages: DataFrame, id_col: str = "page_id", low: float = LOW, min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(id_col, url, text, n_chars) for every page, from its whole html.

    Null, empty and markup-only pages have an empty text.  A null URL counts as
    the empty host.  Repeated rows stay repeated; other columns are ignored; an
    empty table gives an empty result.  In a page with an article or main
    element, the bound is ``low`` / ``EVIDENCE`` inside it and ``low`` * ``EVIDENCE``
    outside, in any other page ``low``.  Named branches and nodes with importance
    under the bound, seen on ``min_pages`` pages of the host at least, are removed.
    """
    nodes = saved(style_tree(pages).filter((F.col("importance") < low * EVIDENCE) & (F.col("pages") >= min_pages)).select("host", "node", "importance"))
    source, table = pages.select(id_col, "url", "html"), None
    if nodes.limit(broadcast_nodes + 1).count() <= broadcast_nodes:
        table = {}
        for r in nodes.toLocalIterator():
            table.setdefault(r.host, {})[r.node] = r.importance
    else:
        source = _low_of_pages(source, nodes, id_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        urls, htmls = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lows = [{x["node"]: x["importance"] for x in r or ()} for r in batch.column(3).to_pylist()] if table is None else [table.get(_host(u), {}) for u in urls]
        texts = ["\n".join(Page(h).main_text(k, low)) if h else "" for h, k in zip(htmls, lows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(source, run, f"`{id_col}` {kind}, url string, text string, n_chars bigint")
