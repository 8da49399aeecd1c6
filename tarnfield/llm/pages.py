"""Main text of HTML pages by differencing each page with its nearest neighbour on the host.

A page is read into text lines (blocks), each with the part of the page it stands in: article or main
element, a part that is never main text (navigation, headers, footers, asides, forms, scripts, notices,
adverts, comments), or elsewhere. Pages of a host are put into the order of their URL paths and compared with
the neighbours before and after: the longest common subsequence of the lines is the template they share, and
its lines are deleted, unless the two are copies (over half of the shorter page's letters is shared), which
show the article and not the template. An article's own lines are aligned but kept, as markup has told what
they are; a page without article keeps what lies elsewhere and is not template.

Null and empty html give an empty text. A null url puts the page on a host of its own name, the empty one.
Repeated rows and pages of equal path stay, in the order of their ids. Very long pages are read in one pass;
alignments look only at lines that both pages have.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import appended, over_batches, raw, ship, table

ship(__name__)

#: Fixed values of the markup language.
SKIPPED = frozenset(
    "script style noscript template nav header footer aside form iframe svg math button select option textarea input "
    "label fieldset dialog menu head title object embed canvas audio video map".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
BREAKS = BLOCKS - {"br"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id or role values that mark a part as not being main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription navigation nav navbar menu "
    "breadcrumb breadcrumbs sidebar side footer header masthead topbar share sharing social related recommended widget widgets "
    "comment comments commentlist replies reply disqus respond login signup search toolbar pager pagination "
    "complementary contentinfo".split()
)
#: A class such as has-sidebar tells of a part elsewhere.
ELSEWHERE = frozenset("has with without no is".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)|([^>]*))>|<[!?/][^>]*>", re.S
)
VALUE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
COPY = 0.5
#: An opening tag of these closes an open element of its kind, but not one outside the innermost of the bounds.
CLOSERS = frozenset("li td th tr dt dd option".split())
BOUNDS = MAIN | frozenset("ul ol dl table select section aside nav form header footer".split())


def noisy(name: str, attributes: str) -> bool:
    """Whether an element starts a part that is never main text."""
    if name in SKIPPED:
        return True
    if name in ("html", "body", *MAIN) or not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for value in VALUE.findall(attributes):
        for word in value.strip("\"'").lower().split():
            parts = re.split(r"[-_]+", word)
            if parts[0] not in ELSEWHERE and not NOISE.isdisjoint(parts):
                return True
    return False


def blocks(html: str) -> list[tuple[str, int]]:
    """Text blocks in page order with the part each stands in: 2 article or main element, 1 elsewhere, 0 no main text."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    opened: list[tuple[str, bool]] = []  # elements, and whether each starts a part without main text
    skipped = main = at = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, 0 if skipped else 2 if main else 1))

    def close(k: int) -> None:
        nonlocal skipped, main
        flush()
        skipped -= sum(s for _, s in opened[k:])
        main -= sum(n in MAIN for n, _ in opened[k:])
        del opened[k:]

    while tag := TAG.search(html, at):
        held.append(unescape(html[at : tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if name == "br":
            held.append(" ")
        elif name in BREAKS:
            flush()
        if not name or name in VOID:
            continue
        nearest = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name), None)
        if tag[1]:
            if nearest is not None:
                skip_or_main = any(s or n in MAIN for n, s in opened[nearest:])
                if skip_or_main:
                    close(nearest)
                else:
                    del opened[nearest:]
            continue
        attributes = tag[3] if tag[3] is not None else tag[4] or ""
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in CLOSERS and nearest is not None and not any(n in BOUNDS for n, _ in opened[nearest:]):
            close(nearest)
        elif name in BREAKS:  # a new block ends an open paragraph
            k = len(opened) - 1
            while k >= 0 and opened[k][0] not in BREAKS:
                k -= 1
            if k >= 0 and opened[k][0] == "p":
                close(k)
        skip = noisy(name, attributes)
        if skip or name in MAIN:
            flush()
        opened.append((name, skip))
        skipped += skip
        main += name in MAIN
    held.append(unescape(html[at:]))
    flush()
    return out


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, in linear space by halving ``a``."""
    left = np.flatnonzero(np.isin(a, b))
    right = b[np.isin(b, a)]
    found: list[int] = []

    def solve(at: np.ndarray, other: np.ndarray) -> None:
        if not len(at) or not len(other):
            return
        if len(at) == 1:
            if (other == a[at[0]]).any():
                found.append(int(at[0]))
            return
        mid = len(at) // 2
        cut = int((lengths(a[at[:mid]], other) + lengths(a[at[mid:]][::-1], other[::-1])[::-1]).argmax())
        solve(at[:mid], other[:cut])
        solve(at[mid:], other[cut:])

    solve(left, right)
    return found


def template(own: dict, other: dict | None) -> set[int]:
    """Lines of ``own`` that it shares with a page of the same host, unless the two are copies."""
    if not other or own["host"] != other["host"]:
        return set()
    a, b = np.array(own["marks"], dtype=np.int64), np.array(other["marks"], dtype=np.int64)
    shared = common(a, b)
    letters = np.array(own["sizes"], dtype=np.int64)
    least = min(letters.sum(), sum(other["sizes"]))
    return set() if letters[shared].sum() > COPY * least else set(shared)


def signatures(pages: DataFrame) -> DataFrame:
    """Per different page: host, path and the hash, letters and part of each of its lines."""

    def start():
        def step(batch):
            read = [blocks((h or b"").decode("utf-8", "replace")) for h in raw(batch, "html")]
            return [
                pa.array([[xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t, _ in page] for page in read], pa.list_(pa.int64())),
                pa.array([[len(t) for t, _ in page] for page in read], pa.list_(pa.int32())),
                pa.array([[p for _, p in page] for page in read], pa.list_(pa.int32())),
            ]

        return step

    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        F.xxhash64("html").alias("mark"),
        F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return appended(keyed, "marks array<bigint>, sizes array<int>, parts array<int>", start).drop("html")


def templates(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``mark``, ``gone``: the template lines that would otherwise be taken for main text.

    Pages are ordered by (host, path) over ranges, so a large host spreads over many tasks; a range's first and
    last page meet their neighbours over a table with one row per range.
    """
    single = signatures(pages).dropDuplicates(["page_id", "url", "mark"])
    order = ["host", "path", "page_id", "url", "mark"]
    ranged = table(single.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "paths")
    side = F.struct("host", "marks", "sizes")
    in_range = Window.partitionBy("range").orderBy(*order)
    near = ranged.withColumns({"before": F.lag(side).over(in_range), "after": F.lead(side).over(in_range)})
    ends = ranged.groupBy("range").agg(
        F.min_by(side, F.struct(*order)).alias("first"), F.max_by(side, F.struct(*order)).alias("last")
    )
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")
    edges = ends.select(
        "range", F.lag("last").over(by_range).alias("ahead"), F.lead("first").over(by_range).alias("behind")
    )
    near = near.join(edges, "range", "left").select(
        "page_id",
        "url",
        "mark",
        F.struct("host", "marks", "sizes", "parts").alias("own"),
        F.coalesce("before", "ahead").alias("before"),
        F.coalesce("after", "behind").alias("after"),
    )

    def start():
        def step(batch):
            gone = []
            for own, before, after in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                shared = template(own, before) | template(own, after)
                open_ = 2 not in own["parts"]
                gone.append(sorted(i for i in shared if open_ and own["parts"][i] == 1))
            return {
                **{c: batch.column(k) for k, c in enumerate(("page_id", "url", "mark"))},
                "gone": pa.array(gone, pa.list_(pa.int32())),
            }

        return step

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    found = over_batches(near, f"page_id {kinds['page_id']}, url string, mark bigint, gone array<int>", start)
    return found.filter(F.size("gone") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (main text, blocks joined by two line feeds) and ``n_chars``."""
    added = ("text", "n_chars", "_page", "_url", "_mark", "_gone")
    gone = table(templates(pages.select("page_id", "url", "html")), "gone").toDF("_page", "_url", "_mark", "_gone")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    same = same & (F.xxhash64("html") == F.col("_mark"))
    met = pages.drop(*added).join(gone, same, "left").drop("_page", "_url", "_mark")

    def start():
        def step(batch):
            texts = []
            skip = batch.column(batch.schema.get_field_index("_gone")).to_pylist()
            for html, without in zip(raw(batch, "html"), skip):
                page = blocks((html or b"").decode("utf-8", "replace"))
                if any(part == 2 for _, part in page):
                    kept = [t for t, part in page if part == 2]
                else:
                    without = set(without or ())
                    kept = [t for i, (t, part) in enumerate(page) if part == 1 and i not in without]
                texts.append("\n\n".join(kept))
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return step

    return appended(met, "text string, n_chars bigint", start).drop("_gone")
