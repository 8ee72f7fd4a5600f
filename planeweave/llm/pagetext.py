"""Main text of web pages by differencing each page with its nearest neighbours by URL."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from planeweave.llm.common import stored

#: Elements that never hold text of the article.
HIDDEN = frozenset("head title script style noscript template svg math canvas iframe object select textarea button datalist".split())
FRAME = frozenset("nav header footer aside form dialog menu".split())
CONTENT = frozenset("article main".split())
#: Elements that no class, id or role marks.
WHOLE = frozenset("html body".split())
#: Elements that may stand in a head; any other, and text, ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
                    "tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole names in class, id or role that mark a region as not the article.
MARKS = frozenset(("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies disqus footer "
                   "masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related replies reply respond "
                   "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets").split())
#: Pages that have more than this part of their own text in common are copies, which tell nothing of each other.
COPY = 0.6
BODY, ARTICLE, MARKED = 0, 1, 2


class _Lines(HTMLParser):
    """Blocks of text in page order, each with the marked or content element that it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        #: Marked and content elements in page order: the one around it, its tag, what it is.
        self.nodes: list[tuple[int, str, str]] = [(-1, "", "")]
        #: Open elements with the node that they stand in and whether text is hidden in them.
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.open[-1][1]))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if self.open[-1][0] == "head" and tag not in HEAD:
            self.open.pop()
        if tag in VOID:
            return
        if tag == "p" and self.open[-1][0] == "p" or tag == "li" and self.open[-1][0] == "li":
            self.open.pop()
        elif tag in BLOCKS:
            self._end_paragraph()
        node, hidden = self.open[-1][1:]
        given = dict(attrs)
        names = " ".join(v for k in ("class", "id", "role") if (v := given.get(k))).lower().split()
        kind = ""
        if tag in CONTENT or given.get("itemprop") == "articleBody":
            kind = "main" if tag == "main" else "article"
        elif tag not in WHOLE and not MARKS.isdisjoint(names):
            kind = "named"
        elif tag in FRAME:
            kind = "frame"
        if kind:
            self.nodes.append((node, tag, kind))
            node = len(self.nodes) - 1
        hidden = hidden or tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true"
        self.open.append((tag, node, hidden))

    def regions(self, forms: bool = True) -> list[int]:
        """The region of each node. A form around content is no mark, nor is any form without ``forms``; if every
        article (without one, every main) stands in a marked element, the marked elements around them are none either."""
        def around(kinds: tuple[str, ...]) -> list[bool]:
            held = [n[2] in kinds for n in self.nodes]
            for i in range(len(held) - 1, 0, -1):
                held[self.nodes[i][0]] |= held[i]
            return held

        def marks(i: int) -> bool:
            return self.nodes[i][2] in ("named", "frame") and i not in neutral

        held = around(("article", "main"))
        neutral = {i for i, n in enumerate(self.nodes) if n[1:] == ("form", "frame") and (held[i] or not forms)}
        first = "article" if any(n[2] == "article" for n in self.nodes) else "main"
        below = [False]
        for up, _, _ in self.nodes[1:]:
            below.append(below[up] or marks(up))
        if all(below[i] for i, n in enumerate(self.nodes) if n[2] == first):
            neutral |= {i for i, x in enumerate(around((first,))) if x and marks(i)}
        out = [BODY]
        for i, (up, tag, kind) in enumerate(self.nodes[1:], 1):
            region = out[up]
            if region != MARKED:
                if kind in ("article", "main"):
                    region = ARTICLE
                elif marks(i) and (kind == "named" or not (tag == "header" and region == ARTICLE)):
                    region = MARKED
            out.append(region)
        return out

    def _end_paragraph(self) -> None:
        """A block ends an open paragraph, with the inline elements left open in it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == "p":
                del self.open[i:]
                return
            if self.open[i][0] in BLOCKS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                break  # an inline end tag does not close the block around it

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and data.strip():
            self.open.pop()
        if not self.open[-1][2]:
            self.parts.append(data)


def lines(html: str) -> list[tuple[str, int]]:
    """``(text, region)`` of each block: white space is one space, character references are decoded."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    regions = parser.regions()
    if all(regions[node] == MARKED for _, node in parser.lines):
        regions = parser.regions(forms=False)  # a page all within a form
    return [(text, regions[node]) for text, node in parser.lines]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of ``a`` are in a longest common subsequence of ``a`` and ``b``.

    Bit-parallel: a row of the table is one integer with a bit for each item of ``b``, so long
    pages cost a few machine words per item. Equal ends are taken off first.
    """
    kept = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        kept[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        kept[-1 - hi] = True
        hi += 1
    x, y = a[lo:len(a) - hi].tolist(), b[lo:len(b) - hi].tolist()
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    if not any(v in where for v in x):
        return kept
    full, row, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
    for v in x:
        rows.append(row)
        u = row & where.get(v, 0)
        row = ((row + u) | (row - u)) & full
    # A bit that is 0 in a row raises the length there; walk back from the end.
    rows.append(row)
    j = len(y)
    for i in range(len(x), 0, -1):
        below = lambda r, n: n - (r & ((1 << n) - 1)).bit_count()
        if below(rows[i], j) == below(rows[i - 1], j):
            continue
        while j and below(rows[i], j - 1) == below(rows[i], j):
            j -= 1
        kept[lo + i - 1] = True
        j -= 1
    return kept


def _hash(texts: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]


def _kept(found: list[tuple[str, int]]) -> list[str]:
    """The blocks that markup leaves: those of article and main elements, or without any all that are not marked."""
    wanted = ARTICLE if any(r == ARTICLE for _, r in found) else BODY
    return [t for t, r in found if r == wanted]


def _parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    """page_id, url and the blocks that markup leaves, as texts if ``with_text``, else as hashes and lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept(lines(x or "")) for x in batch.column("html").to_pylist()]
            columns = {"page_id": batch.column("page_id"), "url": batch.column("url"), "__page": batch.column("__page")}
            if with_text:
                columns |= {"__texts": pa.array(found, pa.list_(pa.string()))}
            else:
                columns |= {"__hashes": pa.array([_hash(f) for f in found], pa.list_(pa.int64())),
                            "__sizes": pa.array([[len(t) for t in f] for f in found], pa.list_(pa.int32()))}
            yield pa.record_batch(columns)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("__page"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, __page long, " + (
        "__texts array<string>" if with_text else "__hashes array<long>, __sizes array<int>"))


def _site_lines(dealt: DataFrame) -> DataFrame:
    """``(__host, __site)``: blocks on more than half of a host's different pages, if it has three or more."""
    # Exact copies, however many, are one page.
    unlike = dealt.groupBy("__host", "__hashes").agg(F.lit(1).alias("_one"))
    pages = unlike.groupBy("__host").agg(F.count(F.lit(1)).alias("_pages")).where("_pages > 2")
    on = unlike.select("__host", F.explode(F.array_distinct("__hashes")).alias("_line")).groupBy("__host", "_line").agg(
        F.count(F.lit(1)).alias("_on")).where("_on > 2")
    return on.join(pages, "__host").where("_on * 2 > _pages").groupBy("__host").agg(F.collect_list("_line").alias("__site"))


def _neighbours(pages: DataFrame) -> DataFrame:
    """Each distinct page with its blocks and those of the nearest pages before and after it, by path within
    its host, that are no copies of it; pages without blocks are left out.

    Pages are dealt by ranges of (host, path, id), so the pages of a large host lie in many
    partitions, and looked at in order within each; what a page needs from beyond its partition
    is handed on, one row a partition: the page at the border, then the page before the last, or
    after the first, run of copies.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    keys = _parsed(pages, with_text=False).where(F.size("__hashes") > 0).dropDuplicates(["page_id", "url", "__page"]).withColumns({"__host": host, "__path": path})
    order = ["__host", "__path", "page_id", "__page"]
    dealt = stored(keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # What is a page's own: its blocks, with their lengths, that are not those of the site.
    own = F.array_distinct(F.filter(F.arrays_zip("__hashes", "__sizes"), lambda x: ~F.coalesce(F.array_contains("__site", x["__hashes"]), F.lit(False))))
    rows = dealt.join(_site_lines(dealt), "__host", "left").withColumn("__own", own).drop("__site", "__sizes")
    within = Window.partitionBy("__part").orderBy(*order)
    back = Window.partitionBy("__part").orderBy(*[F.col(c).desc() for c in order])
    beside = F.struct("__host", "__hashes", "__own")
    first = rows.groupBy("__part").agg(F.min_by(beside, F.struct(*order)).alias("__first"), F.max_by(beside, F.struct(*order)).alias("__last"))
    parts = Window.orderBy("__part")  # a row per partition
    edges = first.select("__part", F.lag("__last").over(parts).alias("__edge_before"), F.lead("__first").over(parts).alias("__edge_after"))
    rows = rows.withColumns({"__before": F.lag(beside).over(within), "__after": F.lead(beside).over(within)}).join(edges, "__part")
    length = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + y["__sizes"])
    copy = lambda c: (c["__host"] == F.col("__host")) & ((c["__hashes"] == F.col("__hashes")) | (
        length(F.array_intersect(c["__own"], "__own")) > F.least(length(c["__own"]), length(F.col("__own"))) * F.lit(COPY)))
    # Where a run of copies begins or ends, the page beyond it.
    other = lambda c: F.when(~copy(c), F.struct(c["__host"].alias("__host"), c["__hashes"].alias("__hashes")))
    rows = stored(rows.withColumns({"__before": F.coalesce("__before", "__edge_before"), "__after": F.coalesce("__after", "__edge_after")}).select(
        *order, "url", "__part", "__hashes", other(F.col("__before")).alias("__before"), other(F.col("__after")).alias("__after")))
    ends = rows.groupBy("__part").agg(F.max_by("__before", F.when(F.col("__before").isNotNull(), F.struct(*order))).alias("_b"),
                                      F.min_by("__after", F.when(F.col("__after").isNotNull(), F.struct(*order))).alias("_a"))
    beyond = ends.select("__part", F.last("_b", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__edge_before"),
                         F.last("_a", True).over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__edge_after"))
    upto = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__before": F.last("__before", True).over(within.rowsBetween(*upto)), "__after": F.last("__after", True).over(back.rowsBetween(*upto))}).join(beyond, "__part")
    same = lambda c: F.when(c["__host"] == F.col("__host"), c["__hashes"])
    return rows.select("page_id", "url", "__page", "__hashes", same(F.coalesce("__before", "__edge_before")).alias("__before"),
                       same(F.coalesce("__after", "__edge_after")).alias("__after"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the blocks that a page shares, in order, with a neighbour."""
    for batch in batches:
        out = []
        for own, before, after in zip(*(batch.column(c).to_pylist() for c in ("__hashes", "__before", "__after"))):
            shared = np.zeros(len(own), bool)
            for other in (before, after):
                if other:
                    shared |= common(np.array(own), np.array(other))
            out.append(np.flatnonzero(shared).tolist())
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("__page"), pa.array(out, pa.list_(pa.int32()))], ["page_id", "url", "__page", "__shared"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for texts, shared in zip(*(batch.column(c).to_pylist() for c in ("__texts", "__shared"))):
            gone = set(shared or ())
            out.append("\n\n".join(t for i, t in enumerate(texts) if i not in gone))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Blocks that a page shares, in order, with the nearest page before or after it that is no copy
    of it, by path within its host, are furniture and go, in article and main elements too.
    Markup is an extra filter: it takes what it names as furniture and, on pages with an article
    or main element, what stands outside; neighbours are compared in the blocks that it leaves.

    A page's own blocks are those that at most half of the different pages of its host have (all
    of them where there are fewer than three). Pages are copies if all their blocks are equal, or
    if more than COPY of the own text of the smaller one is in the other.

    Null html is empty and gives an empty text; a null url is a host and path of its own.
    Repeated rows give repeated results and are no neighbours of each other.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    shared = _neighbours(pages).mapInArrow(_shared, f"page_id {kind}, url string, __page long, __shared array<int>").alias("s")
    rows = _parsed(pages, with_text=True).alias("p").join(
        shared, (F.col("p.__page") == F.col("s.__page")) & F.col("p.page_id").eqNullSafe(F.col("s.page_id")) & F.col("p.url").eqNullSafe(F.col("s.url")), "left")
    rows = rows.select("p.page_id", "p.url", "p.__texts", "s.__shared")
    return rows.mapInArrow(_joined, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
