"""Benchmark decontamination by the q-gram lemma: shared q-grams per diagonal band, then banded alignment.

Items and documents are compared in lower case with white space runs as one blank. An item is cut into windows
of ``WINDOW`` characters at every ``STEP``-th one (the last one ends with the item). A passage of WINDOW characters
starts at most STEP / 2 characters beside a window, so exact passages of that length (about 13 words) are found
wherever they start, and those with up to STEP / 2 edits as well. A window within ``BUDGET`` x WINDOW = k edits of a document region shares at least
``WINDOW - q + 1 - k q`` q-grams with it, all on diagonals (document minus window position) that differ by at
most k. Shared q-grams are counted in diagonal bands of width 2k + 1 that overlap by half, so that such a region
lies in one of them whole. Hits are kept per item and diagonal band, in the order of their places in the item, and a
window is met where so many of them in a row lie within it. Bands that reach the bound are aligned within their diagonals, and those at most k
edits apart are leaks. Shorter items are one window with a budget of their own length.

The benchmark is taken in blocks of at most about ``BLOCK`` characters, each of which meets all documents. Items
shorter than q characters after folding say nothing and are passed over, as are null items. Null and empty
texts have no leaks. Repeated items count under each id. Other columns stay; ``leaks`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import appended, quoted, raw, ship, slices

ship(__name__)

Q = 8
WINDOW = 80
STEP = 8  # at most BUDGET x WINDOW
BUDGET = 0.1
BLOCK = 1 << 20
PIECE = 1 << 16  # positions of a document whose hits are held at once
LAP = 128  # of two pieces; the hits of one band and window lie within WINDOW + 2k + 2 positions
FILTER_BITS = 22
SHIFT = 1 << 20  # keeps the band numbers of a window positive


def folded(text: bytes | None) -> np.ndarray:
    """Code points of the lower-case text with single blanks."""
    plain = " ".join((text or b"").decode("utf-8", "replace").lower().split())
    return np.frombuffer(plain.encode("utf-32-le"), dtype="<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 characters from every position, by three doublings."""
    h = points.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= step:
            return h[:0]
        h = h[:-step] * np.uint64(factor) + (h[step:] ^ (h[step:] >> np.uint64(31)))
    return h


class Windows:
    """Windows as parts of one joined text."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.text, self.starts, self.sizes = text, starts, sizes

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, w: int) -> np.ndarray:
        if w >= len(self.starts):
            raise IndexError(w)
        return self.text[self.starts[w] : self.starts[w] + self.sizes[w]]


class Index:
    """Windows of one block of items, and the places of every q-gram in the items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        none = np.zeros(0, dtype=np.int64)
        texts, hashes, owners, offsets = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.uint64)], [none], [none]
        self.item, starts, own, total = [], [none], [], 0
        for name, text in items:
            points = folded(text)
            if len(points) < Q:
                continue
            size, last = min(WINDOW, len(points)), max(0, len(points) - WINDOW)
            k = min(int(BUDGET * size), (size - Q) // Q)
            at = np.array([*range(0, last, STEP), last])
            marks = grams(points)
            hashes.append(marks)
            owners.append(np.full(len(marks), len(own), dtype=np.int64))
            offsets.append(np.arange(len(marks)))
            own.append((len(self.item), len(at), last, size, k, size - Q + 1 - k * Q))
            self.item += [name] * len(at)
            starts.append(total + at)
            texts.append(points)
            total += len(points)
        table = np.array(own, dtype=np.int64).reshape(-1, 6)
        self.window, self.windows, self.last, self.size, self.k, self.bound = table.T  # of each item
        self.edits = np.repeat(self.k, self.windows)  # of each window
        self.at = np.concatenate(starts) - np.repeat(np.cumsum([0, *map(len, texts[1:])])[:-1], self.windows)
        self.points = Windows(np.concatenate(texts), np.concatenate(starts), np.repeat(self.size, self.windows))
        joined = np.concatenate(hashes)
        order = np.argsort(joined, kind="stable")
        self.grams, self.first = np.unique(joined[order], return_index=True)
        self.first = np.r_[self.first, len(joined)]
        self.owner, self.offset = np.concatenate(owners)[order], np.concatenate(offsets)[order]
        # Of the items that hold a q-gram: the fewest shared ones that a window needs. All of them lie within ``span``.
        least = self.bound[self.owner]
        self.needed = np.minimum.reduceat(least, self.first[:-1]) if len(least) else least
        self.span = int((self.size - Q + 2 * self.k + 2).max(initial=0))
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[self.slot(self.grams)] = True

    @staticmethod
    def slot(marks: np.ndarray) -> np.ndarray:
        return ((marks * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def bands(self, points: np.ndarray) -> np.ndarray:
        """Rows (window, first diagonal) of the bands that reach their window's bound."""
        marks = grams(points)
        found = [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(marks), PIECE):
            part = marks[at : at + PIECE + LAP]
            near = np.flatnonzero(self.seen[self.slot(part)])
            if not len(near):
                continue
            place = np.searchsorted(self.grams, part[near])
            place[place == len(self.grams)] = 0
            hit = self.grams[place] == part[near]
            near, place = near[hit], place[hit]
            around = np.searchsorted(near, near + self.span, "right") - np.searchsorted(near, near - self.span)
            enough = around >= self.needed[place]  # a lonely shared q-gram is part of no region
            near, place = near[enough], place[enough]
            if not len(near):
                continue
            size = self.first[place + 1] - self.first[place]
            posting = np.arange(size.sum()) + np.repeat(self.first[place] - np.cumsum(size) + size, size)
            item, offset = self.owner[posting], self.offset[posting]
            key = (item << 32) + (np.repeat(near, size) + at - offset) // (self.k[item] + 1) + SHIFT
            keys, offset = np.concatenate([key, key - 1]), np.concatenate([offset, offset])  # two bands that overlap
            order = np.lexsort((offset, keys))
            keys, offset = keys[order], offset[order]
            item = keys >> 32
            span = np.arange(len(keys)) + self.bound[item] - 1  # from each hit to the one that reaches the bound
            ok = np.flatnonzero(span < len(keys))
            ok = ok[(keys[span[ok]] == keys[ok]) & (offset[span[ok]] - offset[ok] <= self.size[item[ok]] - Q)]
            key, item, low, high = keys[ok], item[ok], offset[ok], offset[span[ok]]
            begin = np.maximum(0, -((self.size[item] - Q - high) // STEP))
            end = np.minimum(low // STEP, self.windows[item] - 2)
            end = np.where(low >= self.last[item], self.windows[item] - 1, end)  # the last window may start off the steps
            begin = np.minimum(begin, np.where(low >= self.last[item], self.windows[item] - 1, begin))
            n = np.maximum(0, end - begin + 1)
            window = np.arange(n.sum()) + np.repeat(self.window[item] + begin - np.cumsum(n) + n, n)
            band = (np.repeat(key, n) & 0xFFFFFFFF) - SHIFT
            diagonal = band * (self.edits[window] + 1) + self.at[window]
            found.append((window << 32) + diagonal + SHIFT)  # one number is sorted faster than two
        packed = np.unique(np.concatenate(found))
        return np.stack([packed >> 32, (packed & 0xFFFFFFFF) - SHIFT], axis=1)

    def align(self, regions: list[tuple[np.ndarray, int, int]]) -> list[tuple[int, int, int] | None]:
        """(start, end, edits) of the best alignment within each band (text, window, first diagonal), if within the budget.

        Bands of windows of one length advance together, one row of the tables at a time; hopeless ones are let go.
        """
        out: list = [None] * len(regions)
        sizes = np.array([len(self.points[w]) for _, w, _ in regions], dtype=np.int64)
        for size in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == size)
            k = int(self.edits[regions[group[0]][1]])
            width = 2 * k + 2
            for some in np.array_split(group, -(-len(group) // 4096)):
                own = np.stack([self.points[regions[r][1]] for r in some])
                text = np.full((len(some), size + width), 0xFFFFFFFF, dtype=np.uint32)
                for row, r in enumerate(some):
                    points, _, low = regions[r]
                    begin, end = max(0, low), min(len(points), low + size + width)
                    if end > begin:
                        text[row, begin - low : end - low] = points[begin:end]
                reach, alive = np.arange(width), some
                cost = np.zeros((len(some), width), dtype=np.int64)
                for i in range(size):
                    turned = cost + (text[:, i : i + width] != own[:, i : i + 1])
                    turned[:, :-1] = np.minimum(turned[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(turned - reach, axis=1) + reach
                    if i % 8 == 7:
                        good = cost.min(axis=1) <= k
                        cost, text, own, alive = cost[good], text[good], own[good], alive[good]
                for r, best, edits in zip(alive.tolist(), cost.argmin(axis=1).tolist(), cost.min(axis=1).tolist()):
                    if edits <= k:
                        points, _, low = regions[r]
                        stop = min(len(points), low + best + size)
                        out[r] = max(0, stop - size), stop, edits
        return out

    def leaks(self, texts: list[bytes | None]) -> list[list[dict]]:
        """Leaks of each text: item, start and end (in the folded text, about), edits; touching windows of an item are one."""
        regions, owner = [], []
        if self.item:
            for at, text in enumerate(texts):
                points = folded(text)
                near = self.bands(points).tolist() if len(points) >= Q else []
                regions += [(points, window, diagonal) for window, diagonal in near]
                owner += [at] * len(near)
        found: list[dict] = [{} for _ in texts]
        for at, (_, window, _), place in zip(owner, regions, self.align(regions)):
            if place:
                found[at].setdefault(self.item[window], set()).add(place)
        return [merged(places) for places in found]


def merged(found: dict) -> list[dict]:
    out = []
    for name, places in found.items():
        run = None
        for start, end, edits in sorted(places):
            if run and start <= run["end"]:
                run["end"], run["edits"] = max(run["end"], end), max(run["edits"], edits)
            else:
                run = {"item_id": name, "start": start, "end": end, "edits": edits}
                out.append(run)
    return out


def blocks(benchmark: DataFrame):
    """The items in lists of at most about ``BLOCK`` characters."""
    sized = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK))
    for k in range(count):
        part = sized if count == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r[0], r[1].encode()) for r in part.collect()]


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``: where passages of the benchmark stand in the text."""
    kind = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
    out = docs.drop("leaks")
    parts = []
    for k, items in enumerate(blocks(benchmark)):
        index = Index(items)

        def start(index=index):
            kinds = pa.list_(
                pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
            )

            def step(batch):
                texts = raw(batch, "text")
                return [pa.array([x for part in slices(texts) for x in index.leaks(texts[part])], kinds)]

            return step

        parts.append(f"_leaks{k}")
        out = appended(out, f"{parts[-1]} {kind}", start)
    return out.withColumn("leaks", F.concat(*parts)).drop(*parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    return with_leaks(docs, benchmark).filter(F.size("leaks") == 0).select(*quoted(docs.columns))
