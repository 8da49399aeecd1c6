"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors.

A word is a maximal run of Latin letters of at least ``SHORTEST`` code points that occurs ``RAREST`` times or
more (A-Z lower-cased). Two words are near if one inserted, deleted or replaced code point turns one into the
other. A replaced letter raises one count by one and lowers another by one; an inserted letter raises one
count. So each word searches the tree of its own length with one step up and one step down to spend, and the
tree of the next length with one step up; a box that needs more is pruned. What remains is verified letter
by letter.

The top of each length's tree is fitted on at most ``SAMPLE`` words in all (it shapes the work, not the
result) and cuts the words into shards of about ``SHARD``. A word lives in one shard and visits every shard whose
box it can reach; within a shard a tree of its own goes on down to ``LEAF`` words. Crowded shards are cut
into a grid of parts of members and visitors. Only counts and the best neighbour of a word leave a shard.

A word's form is its near word of largest count (ties: first in code-point order), if that is at least twice
the word's own; its root is the end of the chain of forms. As counts double along a chain, chains are short;
they are followed by pointer doubling.

Null and empty texts have no words. Texts and runs of any length are taken whole. Repeated rows count as often
as they come. A missing id counts as empty text in the draw of deleted letters. An empty table gives an empty
result. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import bounded, over_batches, raw, ship, slices, table

ship(__name__)

SHORTEST = 5
RAREST = 3
DRAW = 97  # one run in so many loses a letter
SAMPLE = 65_536  # words that shape the top of the trees
LONGEST = 64  # code points of words in the sample; longer words need no top tree
SHARD = 4_096
LEAF = 16
PART = 65_536  # rows of a shard's side handled at once
BLOCK = 1 << 22  # letters compared at once
UNUSED, BARRED = -1, -2

#: Single-byte text with A-Z lower-cased and everything but letters turned into spaces.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def runs(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, one byte per code point."""
    return text.decode().encode("latin-1", "replace").translate(LETTERS).split()


def misspelt(run: bytes, start: int) -> bytes:
    """``run`` without one code point, where the draw of document (``start``) and run says so."""
    drawn = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if drawn % DRAW:
        return run
    gone = drawn % len(run)
    return run[:gone] + run[gone + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``word``, ``n`` over all texts."""

    def start():
        def step(batch):
            total: Counter = Counter()
            ids, texts = batch.column(0).to_pylist(), raw(batch, "text")
            for part in slices(texts):
                for doc_id, text in zip(ids[part], texts[part]):
                    if not text:
                        continue
                    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in Counter(runs(text)).items():
                        total[misspelt(run, begun)] += n
            long = [(w, n) for w, n in total.items() if len(w) >= shortest]
            return {
                "word": pa.array([w.decode("latin-1") for w, _ in long], pa.string()),
                "n": pa.array([n for _, n in long], pa.int64()),
            }

        return step

    counted = over_batches(docs.select("doc_id", "text"), "word string, n long", start)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    """Count of each of the 256 letters in each row."""
    n, length = rows.shape
    at = np.repeat(np.arange(n, dtype=np.int64) * 256, length) + rows.ravel()
    return np.bincount(at, minlength=n * 256).reshape(n, 256).astype(np.int32)


class Tree:
    """A node is (letter, most, left, right): left holds at most ``most`` of the letter. A leaf is its number."""

    def __init__(self, counts: np.ndarray, leaves: float):
        self.members: list[np.ndarray] = []

        def grow(at: np.ndarray, wanted: float):
            cut = self.even_cut(counts[at]) if wanted > 1 and len(at) > 1 else None
            if cut is None:
                self.members.append(at)
                return len(self.members) - 1
            letter, most = cut
            low = counts[at, letter] <= most
            return letter, most, grow(at[low], wanted / 2), grow(at[~low], wanted / 2)

        self.root = grow(np.arange(len(counts)), leaves)

    @staticmethod
    def even_cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part the rows most evenly; None where all rows are alike."""
        best = None
        for most in range(int(counts.max())):
            left = (counts <= most).sum(axis=0)
            off = np.where((left > 0) & (left < len(counts)), np.abs(2 * left - len(counts)), len(counts) + 1)
            letter = int(off.argmin())
            if off[letter] <= len(counts) and (best is None or off[letter] < best[0]):
                best = (int(off[letter]), letter, most)
        return best and best[1:]

    def homes(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(counts), dtype=np.int64)
        stack = [(self.root, np.arange(len(counts)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                low = counts[at, node[0]] <= node[1]
                stack += [(node[2], at[low]), (node[3], at[~low])]
        return out

    def visits(self, counts: np.ndarray, downs: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows that can reach its box) with one step up and, if ``downs``, one step down.

        A letter's count in the other word is known once a step was spent on it, so both steps never meet in
        one letter and no leaf is given twice for a row.
        """
        n = len(counts)
        start = (np.arange(n), np.full(n, UNUSED, np.int16), np.full(n, UNUSED if downs else BARRED, np.int16))
        stack = [(self.root, *start)]
        while stack:
            node, at, up, down = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            letter, most, left, right = node
            count = counts[at, letter] + (up == letter) - (down == letter)
            high = count > most
            rises = (count == most) & (up == UNUSED) & (down != letter)
            falls = (count == most + 1) & (down == UNUSED) & (up != letter)
            for child, stay, cross, is_up in ((right, high, rises, True), (left, ~high, falls, False)):
                spent = np.full(int(cross.sum()), letter, np.int16)
                new_up = spent if is_up else up[cross]
                new_down = down[cross] if is_up else spent
                stack.append((
                    child,
                    np.concatenate([at[stay], at[cross]]),
                    np.concatenate([up[stay], new_up]),
                    np.concatenate([down[stay], new_down]),
                ))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(i, j) of the rows of ``a`` and ``b`` that one replaced letter, or one letter more in ``b``, turns into each other."""
    found = []
    size = max(1, BLOCK // max(1, len(b) * b.shape[1]))
    for at in range(0, len(a), size):
        x = a[at : at + size, None, :]
        if a.shape[1] == b.shape[1]:
            good = (x != b[None]).sum(axis=2) == 1
        else:
            head = np.logical_and.accumulate(x == b[None, :, :-1], axis=2)
            tail = np.logical_and.accumulate((x == b[None, :, 1:])[:, :, ::-1], axis=2)
            good = head.sum(axis=2) + tail.sum(axis=2) >= a.shape[1]
        i, j = np.nonzero(good)
        found.append(np.stack([i + at, j], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def near_pairs(queries: list[str], members: list[str]) -> np.ndarray:
    """(query, member) positions of near words, for words of one length on each side, members not shorter."""
    if not queries or not members:
        return np.zeros((0, 2), dtype=np.int64)
    ours, theirs = letters(queries), letters(members)
    tree = Tree(letter_counts(theirs), len(members) / LEAF)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for leaf, at in tree.visits(letter_counts(ours), downs=ours.shape[1] == theirs.shape[1]):
        inside = tree.members[leaf]
        size = max(1, BLOCK // (theirs.shape[1] * 16))
        for first in range(0, len(inside), size):
            some = inside[first : first + size]
            pairs = one_edit(ours[at], theirs[some])
            found.append(np.stack([at[pairs[:, 0]], some[pairs[:, 1]]], axis=1))
    return np.concatenate(found)


def top_trees(words: DataFrame) -> dict[int, Tree]:
    """The tree above the shards of each length that needs one, fitted on a bounded sample."""
    short = words.filter(F.length("word") <= LONGEST)
    total = dict(short.groupBy(F.length("word")).count().collect())  # at most LONGEST rows
    per: dict[int, list[str]] = {}
    for (word,) in bounded(short.select("word"), "word", SAMPLE).collect():
        per.setdefault(len(word), []).append(word)
    trees = {}
    for length, some in sorted(per.items()):
        wanted = min(total[length] / SHARD, len(some) / LEAF)
        if wanted > 1:
            trees[length] = Tree(letter_counts(letters(sorted(some))), wanted)
            trees[length].members = []
    return trees


def routed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``length``, ``leaf``, ``kind``, ``word``, ``n``: kind 0 lives in the shard, 1 visits it, 2 visits as a shorter word."""

    def start():
        def step(batch):
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            out: dict[str, list] = {"length": [], "leaf": [], "kind": [], "at": []}

            def add(length: int, leaf, kind: int, at: np.ndarray) -> None:
                out["length"].append(np.full(len(at), length, np.int32))
                out["leaf"].append(np.broadcast_to(np.asarray(leaf, np.int32), len(at)))
                out["kind"].append(np.full(len(at), kind, np.int8))
                out["at"].append(at)

            sizes = np.array([len(w) for w in words], dtype=np.int64)
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                counts = None
                if length in trees or length + 1 in trees:
                    counts = letter_counts(letters([words[i] for i in at]))
                if length in trees:
                    add(length, trees[length].homes(counts), 0, at)
                else:
                    add(length, 0, 0, at)
                for kind, longer in ((1, length), (2, length + 1)):
                    if longer not in trees:
                        add(longer, 0, kind, at)
                        continue
                    for leaf, rows in trees[longer].visits(counts, downs=kind == 1):
                        add(longer, leaf, kind, at[rows])
            arrays = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
            where = pa.array(arrays.pop("at"))
            made = {k: pa.array(v) for k, v in arrays.items()}
            return made | {"word": batch.column(0).take(where), "n": pa.array(ns).take(where)}

        return step

    return over_batches(words, "length int, leaf int, kind tinyint, word string, n long", start)


def gridded(rows: DataFrame) -> DataFrame:
    """Rows of ``routed`` with parts (``i``, ``j``) of their shard's members and visitors, each within ``PART`` or so."""
    member = F.col("kind") == 0
    sizes = rows.groupBy("length", "leaf").agg(
        F.ceil(F.count_if(member) / PART).cast("int").alias("across"), F.ceil(F.count_if(~member) / PART).cast("int").alias("along")
    )
    sizes = sizes.filter("across > 0 AND along > 0")  # a shard that nobody lives in or visits has nothing to give
    met = rows.join(sizes, ["length", "leaf"])
    own = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = met.withColumn("i", F.explode(F.when(member, own("across")).otherwise(every("across"))))
    return met.withColumn("j", F.explode(F.when(member, every("along")).otherwise(own("along"))))


def in_shard(rows: pa.Table) -> pa.Table:
    """``word``, ``n_near``, ``near``, ``near_n``: count of near words met here and the best of them."""
    kinds, everyone, ns = rows["kind"].to_numpy(), np.array(rows["word"].to_pylist(), dtype=object), rows["n"].to_numpy()
    home = np.flatnonzero(kinds == 0)
    met = []
    for kind in (1, 2):
        guests = np.flatnonzero(kinds == kind)
        pairs = near_pairs(everyone[guests].tolist(), everyone[home].tolist())
        q, m = guests[pairs[:, 0]], home[pairs[:, 1]]
        met.append(np.stack([q, m], axis=1))
        if kind == 2:  # found once for both
            met.append(np.stack([m, q], axis=1))
    word, near = np.concatenate(met).T
    place = np.unique(everyone, return_inverse=True)[1]  # numbers in code-point order
    order = np.lexsort([place[near], -ns[near], place[word]])
    word, near = word[order], near[order]
    first = np.flatnonzero(np.r_[True, place[word[1:]] != place[word[:-1]]][: len(word)])
    n = np.diff(first, append=len(word))
    texts = lambda at: pa.array(everyone[at].tolist(), pa.string())
    return pa.table({"word": texts(word[first]), "n_near": pa.array(n, pa.int64()), "near": texts(near[first]), "near_n": pa.array(ns[near[first]], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``near``, ``near_n`` of the words that have a near word."""
    rows = table(routed(words.select("word", "n"), top_trees(words)), "routed")
    met = gridded(rows).select("length", "leaf", "i", "j", "kind", "word", "n").groupBy("length", "leaf", "i", "j")
    found = met.applyInArrow(in_shard, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for (``word``, ``form``): the end of each chain, by pointer doubling."""
    now = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.toDF("via", "beyond")
        met = now.join(ahead, F.col("root") == F.col("via"), "left")
        now = table(met.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, factor: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of the texts."""
    words = table(word_counts(docs, shortest, rarest), "words")
    found = words.join(near_words(words), "word", "left")
    better = F.col("near_n") >= F.lit(factor) * F.col("n")
    found = found.select(
        "word",
        F.when(better, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("near_n")).alias("form_n"),
    )
    found = table(found, "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    met = found.join(ends, "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
