"""Main text of web pages with a site style tree.

The pages of a host merge into one tree (Yi, Liu and Li 2003): a node is the path of
element names, classes and ids from the root.  Every node counts how its presentation
(the sequence of its child elements) and its content (the text directly in it, which makes
it a leaf, with or without elements below) vary over the host's pages.  The entropy of either, over the logarithm of the number of pages, is its
importance, 0 when all pages agree and 1 when all differ.  A leaf's composite importance
weighs its content with the presentation of the node above it, and leaves of low composite
importance, and so branches of nothing else, are removed from each page.

Element names, and class or id words, say beforehand what a branch is for: menus, headers,
adverts and comments have importance 0; in an article or main element, where pages may
agree by chance, a leaf goes only below ``LOW_ARTICLE`` (its text and its place hardly ever change), others go below ``LOW``.  So the
tree decides about every leaf that names don't condemn, articles included.

Copies of a page on a host count once: pages with equal text apart from what is beside the
article and from short dates, times and counters.  Copies that differ otherwise count each.

Pages of a host meet only as counts: rows of (copy, node, content) are grouped by page and
node, then counted by content, and only the hashes of unimportant nodes go back to the
pages, so that a host with a third of all pages is no hot spot.  A page's tree is held as
links to the node above, so deep pages take memory in proportion to their length.

Defined results: null or empty html gives an empty text; a page without article or main
element gives its remaining blocks; where none remain (pages that are copies), all that are
in the article, or else all that aren't marked as beside it; a header in an article holds its title
and stays; formulas stay, drawings and media don't; broken markup is read as far as it goes, and a tag
that the page's end cuts off is dropped; equal pages of a host, and rows that repeat, give equal texts; a null url
counts as a host of its own; an empty table gives no rows; a column named text is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import map_arrow, materialize, release, table

#: Importance below which a branch is removed, from so many pages of the host on, copies once.
LOW, LOW_ARTICLE, PAGES = 0.25, 0.02, 5
#: Share of the presentation of the node above in a leaf's importance.
ABOVE = 0.1
#: Unimportant nodes (8 bytes each) that are broadcast at most; more are joined by host.
BROADCAST_NODES = 100_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
#: Elements with contents that aren't text of the page.
UNSEEN = frozenset("template svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption button label legend".split()
)
#: Elements that end an open element of the first kind when they start.
CLOSES_P = BLOCK - frozenset("body head html button label option optgroup select legend".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main aside nav form body".split())
#: Elements and words of class, id and role attributes that mark what isn't the article.
OTHER = frozenset("nav header footer aside form script style head menu dialog select button search".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget notice notices cookie cookies consent gdpr alert disclaimer comment comments reply replies disqus respond discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skip copyright complementary contentinfo dialog".split()
)
#: Words of those that also name the layout of a wrapper ("has-sidebar"): an article within is kept.
LAYOUT = frozenset("sidebar header nav navbar navigation menu widget login toolbar masthead".split())
WORD = re.compile(r"[a-z]+")
#: Words of dates, times and counters.
STAMP = frozenset(
    "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december mon monday tue tuesday wed wednesday thu thursday fri friday "
    "sat saturday sun sunday am pm utc gmt t z at on of the st nd rd th ago date time day days week weeks month months year years hour hours minute minutes min second seconds sec posted published updated "
    "last modified generated created retrieved view views viewed visit visits visitor visitors hit hits read reads count counter times".split()
)
#: Most characters of a block that may be a stamp; most of a page's text that stamps of such words, and other short blocks with a digit, may hold.
STAMP_CHARS, STAMPS, NUMBERED = 80, 0.5, 0.1
HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return (found[1].lower().removeprefix("www.") if found else "") or "-"


def _signature(name: str, attributes: str, inside: bool = False) -> tuple[str, int]:
    """The name with its classes and id as part of a path; 2 if it marks a branch beside the article, 1 if by words of layout alone, else 0."""
    words, other = [], 2 * (name in UNSEEN or name in OTHER and not (inside and name == "header"))
    if not attributes or "=" not in attributes:
        return name, other
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = " ".join(sorted(html.unescape("".join(values)).lower().split()))
        words.append(f"{kind.lower()}={value}")
        if name not in ("body", "html", "article", "main"):
            parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(values)).lower()
            if found := WORDS.intersection(WORD.findall(parts)):
                other = max(other, 1 if name in ("div", "section") and found <= LAYOUT else 2)
    return ".".join([name, *sorted(words)]), other


class Page:
    """Blocks of a page: node (hashed path), text, whether inside an article, whether beside the article; child sequences of its nodes, and the node above each."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.styles: list[tuple[int, int]] = []
        self.above: dict[int, int] = {}
        # an open element: name, hash of its path, article depth, how far beside the article, hash of its children so far, what an inline one interrupts
        self.stack: list[list] = [["", 0, 0, 0, 0, None]]
        self.open: Counter = Counter()
        self.held: list[str] = []
        self._read(source)
        self._block()
        while len(self.stack) > 1:
            self._pop()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self.held.append(html.unescape(source[at:]))
                return
            if start > at:
                self.held.append(html.unescape(source[at:start]))
            found = TOKEN.match(source, start)
            if not found:
                if start + 1 >= end:
                    return
                self.held.append("<")
                at = start + 1
                continue
            at = found.end()
            closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            if not found[0].endswith(">"):
                return
            name = name.lower()
            if closing:
                self._close(name)
            elif name in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                    at = close.end() if close else end
            elif name == "br":
                self.held.append(" ")
            else:
                self._open(name, attributes)

    def _open(self, name: str, attributes: str) -> None:
        top = self.stack[-1]
        signature, other = _signature(name, attributes, top[2] > 0)
        inline = name not in BLOCK
        if name in VOID or name in UNSEEN and attributes.endswith("/"):
            if not inline:
                self._block()
            return
        if inline and not other:
            return
        if not inline:
            self._block()
            if name in CLOSES_P:
                self._close("p", within=("button", "td", "th", "li", "div", "section", "article"))
            if name in SIBLINGS:
                self._end_sibling(SIBLINGS[name])
            top = self.stack[-1]
        path = xxhash.xxh3_64_intdigest(signature.encode("utf-8", "replace"), top[1])
        top[4] = xxhash.xxh3_64_intdigest(signature.encode("utf-8", "replace"), top[4])
        self.above[path] = top[1]
        starts = name in ("article", "main") and not other and top[3] < 2
        beside = 0 if starts else max(other, top[3])
        article = top[2] + starts
        # an inline branch beside the article lets the block around it go on after it
        self.stack.append([name, path, article, beside, 0, self.held if inline else None])
        self.open[name] += 1
        if inline:
            self.held = []

    def _end_sibling(self, names: set[str]) -> None:
        if not any(self.open[name] for name in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self._pop()
            elif self.stack[k][0] in SCOPES:
                return

    def _close(self, name: str, within: tuple[str, ...] = ()) -> None:
        if name in BLOCK and not within:
            self._block()
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                self._block()
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in within:
                return

    def _pop(self) -> None:
        self._block()
        top = self.stack.pop()
        self.open[top[0]] -= 1
        if top[5] is None:
            self.styles.append((top[1], top[4]))
        else:
            self.held = top[5]

    def _block(self) -> None:
        """End a block."""
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            top = self.stack[-1]
            self.blocks.append((top[1], text, top[2] > 0, top[3] > 0))

    def leaves(self) -> dict[int, tuple[int, bool]]:
        """Hash of the text of each leaf that isn't marked as beside the article, and whether it is inside one."""
        content: dict[int, list[str]] = {}
        inside = {}
        for node, text, article, other in self.blocks:
            if node and not other:
                content.setdefault(node, []).append(text)
                inside[node] = article
        return {n: (xxhash.xxh3_64_intdigest("\n".join(t).encode("utf-8", "replace")), inside[n]) for n, t in content.items()}

    def presentations(self, leaves: Iterable[int]) -> dict[int, int]:
        """Hash of the child sequence of the nodes above the leaves."""
        branches: set[int] = set()
        for node in leaves:
            while (node := self.above.get(node, 0)) and node not in branches:
                branches.add(node)
        return {n: s for n, s in self.styles if n in branches}

    def text(self, low: frozenset[int]) -> str:
        """The blocks that stay when the text of nodes of ``low`` importance goes; blocks of nodes below have their own."""
        own = [b for b in self.blocks if not b[3]]
        own = [b for b in own if b[2]] or own
        return "\n".join(b[1] for b in [b for b in own if b[0] not in low] or own)

    def identity(self) -> int:
        """Hash of the text not marked as beside the article, without dates, times and counters: pages of one host that agree in it are copies."""
        own = [b[1] for b in self.blocks if not b[3]]
        short = [t for t in own if len(t) <= STAMP_CHARS and any(c.isdigit() for c in t)]
        total, left = sum(map(len, own)), set()
        for stamps, share in (([t for t in short if _stamp(t)], STAMPS), (short, NUMBERED)):
            if sum(map(len, stamps)) <= share * total:
                left.update(stamps)
        return xxhash.xxh3_64_intdigest("\n".join(t for t in own if t not in left).encode("utf-8", "replace"))


def _stamp(text: str) -> bool:
    """Whether a text with digits is a date, a time or a counter: as many digits as letters, or no other words."""
    return sum(c.isdigit() for c in text) >= sum(c.isalpha() for c in text) or (text.isascii() and STAMP.issuperset(WORD.findall(text.lower())))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def importance(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node, inside (an article), pages (copies once), importance of every leaf that isn't marked as beside the article."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            seen: dict[tuple[str, int, int, int | None, bool], int] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, host = Page(source or ""), host_of(url)
                leaves = page.leaves()
                if not leaves:
                    continue
                copy = page.identity()
                rows = [((host, copy, n, page.above[n], inside), v) for n, (v, inside) in leaves.items()]
                # the presentation of inner nodes; one with text of its own is a leaf too
                rows += [((host, copy, n, None, False), v) for n, v in page.presentations(leaves).items()]
                for key, value in rows:
                    seen[key] = min(_signed(value), seen.get(key, _signed(value)))
            hosts, copies, nodes, parents, insides = zip(*seen, strict=True) if seen else ((), (), (), (), ())
            signed = [pa.array([None if x is None else _signed(x) for x in c], pa.int64()) for c in (copies, nodes, parents)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *signed, pa.array(insides, pa.bool_()), pa.array(seen.values(), pa.int64())], ["host", "copy", "node", "above", "inside", "value"])

    rows = map_arrow(pages.select(url_col, html_col), run, "host string, copy long, node long, above long, inside boolean, value long")
    # copies of a page count once, with one of their values at each node
    once = rows.groupBy("host", "copy", "node", "above", "inside").agg(F.min("value").alias("value"))
    counts = once.groupBy("host", "node", "above", "inside", "value").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("host", "node", "above", "inside").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.log("pages") - F.col("s") / F.col("pages")
    nodes = materialize(nodes.select("host", "node", "above", "inside", "pages", F.when(F.col("pages") > 1, entropy / F.log("pages")).otherwise(1.0).alias("own")), "style-tree")
    parents = nodes.filter(F.col("above").isNull()).select("host", F.col("node").alias("above"), F.col("own").alias("presentation"))
    leaves = nodes.filter(F.col("above").isNotNull()).join(parents, ["host", "above"], "left")
    composite = (1 - ABOVE) * F.col("own") + ABOVE * F.coalesce("presentation", F.lit(1.0))
    # within an article the place counts for nothing: paragraphs vary in number on every page
    return leaves.select("host", "node", "inside", "pages", F.when(F.col("inside"), F.col("own")).otherwise(composite).alias("importance"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text; a column with this name is replaced."""
    base = pages.drop("text")
    nodes = importance(base, url_col=url_col, html_col=html_col)
    nodes = nodes.filter((F.col("pages") >= PAGES) & (F.col("importance") < F.when(F.col("inside"), LOW_ARTICLE).otherwise(LOW)))
    nodes = materialize(nodes.select("host", "node"), "unimportant")
    few = nodes.count() <= BROADCAST_NODES
    names = base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "text string"])

    def reader(of_host):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                urls, sources = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (url_col, html_col))
                lows = of_host(batch, urls)
                texts = [Page(s or "").text(low) for s, low in zip(sources, lows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string())], [*names, "text"])

        return run

    if few:
        # checked above: at most BROADCAST_NODES hashes
        by_host: dict[str, set[int]] = {}
        for row in nodes.collect():
            by_host.setdefault(row["host"], set()).add(row["node"] & ((1 << 64) - 1))
        held = {h: frozenset(n) for h, n in by_host.items()}
        return map_arrow(base, reader(lambda _, urls: [held.get(host_of(u), frozenset()) for u in urls]), schema)
    lists = nodes.groupBy("host").agg(F.collect_list("node").alias("__low"))
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST.pattern.replace("^", "(?i)^", 1), 1)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    joined = base.withColumn("__host", F.when(host == "", "-").otherwise(host)).join(lists.withColumnRenamed("host", "__host"), "__host", "left")

    def lows(batch: pa.RecordBatch, _) -> list[frozenset[int]]:
        return [frozenset(np.array(x or [], np.int64).view(np.uint64).tolist()) for x in batch.column(batch.schema.get_field_index("__low")).to_pylist()]

    return map_arrow(joined.select(*names, "__low"), reader(lows), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    rows = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
