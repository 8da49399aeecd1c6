"""Language-model scores from Brown classes: exchange clustering, class transitions and word emissions.

Words are lower-cased (A-Z) runs of non-blank bytes; every text ends with one end token. All statistics come
from all training texts. Every word of the vocabulary is exchanged by its own neighbours:

* The ``CORE`` most frequent words, the ``ENDINGS`` most frequent two-byte endings of all other words, one unit for
  the rest and one for the end start the classes: their neighbour counts are one matrix of fixed size, and exchange
  clustering moves one unit at a time to the class that gains most mutual information until no unit moves.
* The same scan counts the units before and after each word beyond the core. Tasks then move every such word from the
  class of its ending to the class that gains most, all words against the same class pairs, if that gains more than
  naming another class costs (the logarithm of the number of classes).
* Transitions are counted again with the new classes: the ``HEAD`` most frequent words are known in the tasks, all
  rarer ones get their class by a join with the word table, neighbours that are both rare by two.

Words that the training texts do not hold have no neighbours; they take the commonest class of the words seen once
with the same ending (all endings are kept). The model is P(class | class before) P(word | class): transitions are
smoothed towards the class frequencies, emissions as (c + 0.1) / (n + 0.1 (v + 1)) over the words of the class.

Scoring looks up the ``HEAD`` most frequent words inside the tasks. All rarer words of a text go through one join
with the word table, so no vocabulary is cut off and no frequent word makes a hot key.

Null texts count as empty: their only token is the end. Rows without id, repeated rows and ties are scored row
by row. Without training texts every count is zero. ``score``, ``base_score``, ``perplexity``, ``n_tokens``,
``n_known`` and ``train_tokens`` columns that come with the documents are replaced, others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import BATCH, appended, over_batches, quoted, raw, ship, table

ship(__name__)

HEAD = 131_072
CORE = 760
ENDINGS = 262
CLASSES = 64
ROUNDS = 20
ADD = 0.1
PULL = 2.0  # weight of the class frequencies in a transition
END = b" "  # no word holds a blank
BAND = 64  # units or classes whose rows travel together
FAN = 64  # matrices that one task adds up
HELD = 150_000  # different words that a task holds before it sends their counts
KEYS = 2_000_000  # neighbours that a task holds before it sends their counts
CELLS = 16_384  # neighbour counts that are weighed against all classes at once
SMALL = 16  # counts up to this one are weighed by a table
STAY = float(np.log(CLASSES))  # information that a word must gain to leave the class of its ending
NEAR = np.dtype([("code", "<u2"), ("n", "u1")])
ADDED = ("score", "base_score", "perplexity", "n_tokens", "n_known", "train_tokens")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: how often each token occurs in all texts, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.binary()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in raw(batch, "text"):
                seen.update(words_of(text))
                if len(seen) > HELD:
                    yield sent()
            seen[END] += batch.num_rows
        yield sent()

    parts = docs.select("text").mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """Words to units: core words by themselves, all others by their ending."""

    def __init__(self, core: list[bytes], endings: list[bytes]):
        self.core = {w: i + 2 for i, w in enumerate(core)}  # 0 is the end, 1 the rest
        self.ending = {e: len(core) + 2 + i for i, e in enumerate(endings)}
        self.size = len(core) + len(endings) + 2

    def of(self, word: bytes) -> int:
        unit = self.core.get(word)
        return self.ending.get(word[-2:], 1) if unit is None else unit


class Numbers(dict):
    """Numbers of words: ``fixed`` words have that of their unit or class, the others one each from ``size`` on.

    ``of`` gives the unit or class of the others, -1 if it is not known; the end is 0.
    """

    def __init__(self, size: int, fixed: dict[bytes, int], of: Callable[[bytes], int]):
        super().__init__(fixed)
        self.fixed, self.of, self.units, self.names, self.size = fixed, of, [], [], size

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.size + len(self.units)
        self.units.append(self.of(word))
        self.names.append(word)
        return number


def tallied(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def packed(keys: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, pa.Array]:
    """Different keys (number x ``width`` + code) in order: the numbers, and the counts of each one's codes as bytes."""
    parts = (n + 254) // 255  # counts that one byte does not hold are several entries
    last = np.cumsum(parts) - 1
    keys, rest = np.repeat(keys, parts), n - 255 * (parts - 1)
    near = np.empty(len(keys), dtype=NEAR)
    near["code"], near["n"] = keys % width, 255
    near["n"][last] = rest
    numbers = keys // width
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]][: len(keys)])
    ends = (np.r_[first, len(keys)] * NEAR.itemsize).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(near.tobytes())])
    return numbers[first], held


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of every entry of a packed column."""
    rows = column.to_pylist()
    near = np.frombuffer(b"".join(rows), dtype=NEAR)
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // NEAR.itemsize
    return np.repeat(np.arange(len(rows)), sizes), near["code"].astype(np.int64), near["n"].astype(np.int64)


def contexts(docs: DataFrame, size: int, fixed: dict[bytes, int], of: Callable[[bytes], int]) -> DataFrame:
    """How often which of ``size`` units or classes follows which, over all texts (before the first word: the end).

    ``word``, ``near``: of a word that is not ``fixed``, codes of those before (unit), after (``size`` + unit) and of
    itself (2 x ``size``), several rows for a word. ``word``, ``other``, ``n``: a word of unknown class and one after it.
    ``band``, ``near``: rows of the matrix of all known ones, from this one on; one matrix for each task.
    """
    width = 2 * size + 1
    schema = pa.schema([("word", pa.binary()), ("other", pa.binary()), ("n", pa.int64()), ("band", pa.int32()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, pairs, held = Numbers(size, fixed, of), [], [], 0
        known = np.zeros(size * size, dtype=np.int64)

        def rows(**given) -> pa.RecordBatch:
            arrays = {k: x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in given.items()}
            empty = pa.nulls(len(next(iter(arrays.values()))))
            return pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else empty.cast(f.type) for f in schema], schema=schema)

        def sent() -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, dtype=np.int64)
            numbers, near = packed(*np.unique(np.concatenate([none, *keys]), return_counts=True), width)
            yield rows(word=[seen.names[i - size] for i in numbers.tolist()], near=near)
            both, n = np.unique(np.concatenate([none, *pairs]), return_counts=True)
            first, second = (both >> 32) - size, (both & 0xFFFFFFFF) - size
            yield rows(word=[seen.names[i] for i in first.tolist()], other=[seen.names[i] for i in second.tolist()], n=n)

        for batch in batches:
            line = [0]
            for text in raw(batch, "text"):
                line.extend(map(seen.__getitem__, words_of(text)))
                line.append(0)
            ids = np.array(line, dtype=np.int64)
            units = np.r_[np.arange(size), np.array(seen.units, dtype=np.int64)][ids]
            a, b, unit_a, unit_b = ids[:-1], ids[1:], units[:-1], units[1:]
            same = (a == b) & (a >= size)
            after = np.flatnonzero((a >= size) & (unit_b >= 0) & ~same)
            before = np.flatnonzero((b >= size) & (unit_a >= 0) & ~same)
            keys += [a[after] * width + size + unit_b[after], b[before] * width + unit_a[before], a[same] * width + 2 * size]
            rare = np.flatnonzero((unit_a < 0) & (unit_b < 0) & ~same)
            pairs.append(a[rare] << 32 | b[rare])
            both = np.flatnonzero((unit_a >= 0) & (unit_b >= 0))
            np.add.at(known, unit_a[both] * size + unit_b[both], 1)
            held += len(after) + len(before) + len(rare)
            if len(seen.names) > HELD or held > KEYS:
                yield from sent()
                seen, held = Numbers(size, fixed, of), 0
                keys.clear()
                pairs.clear()
        yield from sent()
        bands = known.reshape(size, size)
        at = range(0, size, BAND)
        yield rows(band=list(at), near=[bands[x : x + BAND].tobytes() for x in at])

    return docs.select("text").mapInArrow(run, "word binary, other binary, n long, band int, near binary")


def merged(found: DataFrame, size: int) -> DataFrame:
    """``contexts`` without unknown words: one row for each word, and the matrices of all tasks as they are.

    The rows of a word meet in one sorted partition and are added up as they pass, so a frequent word holds no more than
    its counts per unit. Matrices are dealt over all partitions.
    """
    width = 2 * size + 1
    schema = pa.schema([("word", pa.binary()), ("band", pa.int32()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None

        def out(words: list[bytes], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            near = packed(*tallied(keys, n), width)[1]  # every word has a neighbour, so a row
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.nulls(len(words), pa.int32()), near], schema=schema)

        for batch in batches:
            matrices = batch.filter(pc.is_null(batch.column(0)))
            if matrices.num_rows:
                yield matrices
                batch = batch.filter(pc.is_valid(batch.column(0)))
            if not batch.num_rows:
                continue
            words = batch.column(0)
            new = np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]
            names = words.filter(pa.array(new)).to_pylist()
            row, code, n = unpacked(batch.column(2))
            keys = (np.cumsum(new) - 1)[row] * width + code
            if last == names[0]:
                keys, n = np.r_[held[0], keys], np.r_[held[1], n]
            elif last is not None:
                yield out([last], *held)
            start = (len(names) - 1) * width
            tail = keys >= start
            last, held = names[-1], tallied(keys[tail] - start, n[tail])
            if len(names) > 1:
                yield out(names[:-1], keys[~tail], n[~tail])
        if last is not None:
            yield out([last], *held)

    rows = found.select("word", "band", "near", F.spark_partition_id().alias("part"))
    dealt = rows.repartition(F.coalesce("word", F.concat_ws(" ", "band", "part").cast("binary"))).sortWithinPartitions("word")
    return dealt.select("word", "band", "near").mapInArrow(run, "word binary, band int, near binary")


def matrix_of(found: DataFrame, size: int) -> np.ndarray:
    """The sum of the matrices of all tasks of ``contexts``: one for each FAN of them, and so on."""

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in rows["near"])
        return pd.DataFrame({"band": rows["band"].iloc[:1], "part": rows["part"].iloc[:1], "near": [total.tobytes()]})

    sent = found.filter("band is not null").select("band", "near").withColumn("part", F.spark_partition_id())
    while True:
        fewer = sent.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        fewer = fewer.groupBy("band", "part").applyInPandas(summed, "band int, part int, near binary")
        sent = table(fewer.select("band", "near", "part"), "neighbours")
        if (sent.agg(F.max("part")).first()[0] or 0) == 0:
            break
    matrix = np.zeros((size, size), dtype=np.int64)
    for band, near in sent.select("band", "near").collect():  # size x size numbers
        matrix[band : band + BAND] += np.frombuffer(near, dtype=np.int64).reshape(-1, size)
    return matrix


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(matrix: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. The end (unit 0) is alone in class 0; the others start by rank of frequency."""
    matrix = matrix.astype(np.float64)
    size = len(matrix)
    rank = np.argsort(np.argsort(-matrix.sum(axis=0)[1:], kind="stable"), kind="stable")
    own = np.r_[0, 1 + rank % (classes - 1)].astype(np.int64)
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    after, before = matrix @ member, matrix.T @ member  # unit x class: class follows / precedes the unit
    pairs = member.T @ after
    diagonal = np.arange(classes)

    for _ in range(rounds):
        changed = 0
        for unit in range(1, size):
            at, self_pairs = own[unit], matrix[unit, unit]
            right, left = after[unit].copy(), before[unit].copy()
            right[at] -= self_pairs
            left[at] -= self_pairs
            rest = pairs.copy()
            rest[at] -= right
            rest[:, at] -= left
            rest[at, at] -= self_pairs
            gain = (entropy(rest + right) - entropy(rest)).sum(axis=1)
            gain += (entropy(rest + left[:, None]) - entropy(rest)).sum(axis=0)
            corner = rest[diagonal, diagonal]
            gain += entropy(corner + right + left + self_pairs) + entropy(corner) - entropy(corner + right) - entropy(corner + left)
            rows, columns = rest.sum(axis=1), rest.sum(axis=0)
            gain -= entropy(rows + right.sum() + self_pairs) - entropy(rows)
            gain -= entropy(columns + left.sum() + self_pairs) - entropy(columns)
            gain[0] = -np.inf
            to = int(gain.argmax())
            if to != at and gain[to] > gain[at] + 1e-9:
                changed += 1
                own[unit] = to
                pairs = rest
                pairs[to] += right
                pairs[:, to] += left
                pairs[to, to] += self_pairs
                after[:, at] -= matrix[:, unit]
                after[:, to] += matrix[:, unit]
                before[:, at] -= matrix[unit]
                before[:, to] += matrix[unit]
        if not changed:
            break
    return own


def gains(pairs: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """word x class: the sum of x log x over ``pairs`` less that over both margins if only this word moves from ``at`` to
    the class, above that without the word. ``before``, ``after``: word x class neighbour counts without the word itself."""
    pairs = pairs.astype(np.float64)
    gain = np.zeros((len(at), len(pairs)))
    steps = np.arange(SMALL + 1)[:, None, None]
    for counts, other, cells in ((after, before, np.ascontiguousarray(pairs.T)), (before, after, pairs)):
        word, near = np.nonzero(counts)
        n = counts[word, near]
        home, large = at[word] == near, n > SMALL
        small = entropy(cells + steps) - entropy(cells)  # count x neighbour x class
        added = small[np.where(large, 0, n).astype(np.int64), near]
        added[large] = entropy(cells[near[large]] + n[large, None]) - entropy(cells[near[large]])
        own = cells[near, at[word]]  # the class it has, without it
        added[np.arange(len(word)), at[word]] = entropy(own) - entropy(own - n)
        rest = cells[near[home]]
        rest[np.arange(len(rest)), near[home]] -= n[home] + itself[word[home]]
        rest -= other[word[home]]
        added[home] = entropy(rest + n[home, None]) - entropy(rest)
        if len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            gain[word[first]] += np.add.reduceat(added, first)
    word, to = np.nonzero(((before > 0) & (after > 0)) | (itself[:, None] > 0))  # the class next to itself
    left, right, self_ = before[word, to], after[word, to], itself[word]
    rest = np.diagonal(pairs)[to] - np.where(to == at[word], left + right + self_, 0)
    gain[word, to] += entropy(rest + left + right + self_) + entropy(rest) - entropy(rest + left) - entropy(rest + right)
    for margin, n in ((pairs.sum(axis=1), after.sum(axis=1) + itself), (pairs.sum(axis=0), before.sum(axis=1) + itself)):
        different, which = np.unique(n, return_inverse=True)
        lost = (entropy(margin + different[:, None]) - entropy(margin))[which]
        lost[np.arange(len(at)), at] = entropy(margin[at]) - entropy(margin[at] - n)
        gain -= lost
    return gain


def moved(near: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of greatest gain for each row of neighbour counts; the class it has where none gains ``STAY`` more."""
    shut = (np.arange(len(pairs)) == 0) | (pairs.sum(axis=0) == 0)  # the end's; an empty one, where all words would meet
    to, cells = at.copy(), np.cumsum((near > 0).sum(axis=1)) // CELLS
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(cells)) + 1):
        of = near[part]
        gain = gains(pairs, at[part], of[:, :CLASSES], of[:, CLASSES : 2 * CLASSES], of[:, -1])
        gain[:, shut] = -np.inf
        best, here = gain.argmax(axis=1), gain[np.arange(len(part)), at[part]]
        to[part] = np.where(gain.max(axis=1) > here + STAY, best, at[part])
    return to


def exchanged(found: DataFrame, pairs: np.ndarray, units: Units, own: np.ndarray) -> DataFrame:
    """``word``, ``n``, ``class`` of every word beyond the core after one move from the class of its unit."""
    width = 2 * CLASSES + 1
    to = np.r_[own, CLASSES + own, 2 * CLASSES]  # codes of units to codes of classes

    def start():
        def step(batch):
            words = raw(batch, "word")
            row, code, n = unpacked(batch.column(1))
            near = np.bincount(row * width + to[code], weights=n, minlength=len(words) * width).reshape(-1, width)
            at = own[np.fromiter(map(units.of, words), dtype=np.int64, count=len(words))]
            times = near[:, CLASSES:].sum(axis=1).astype(np.int64)
            return {"word": batch.column(0), "n": times, "class": pa.array(moved(near, at, pairs), pa.int32())}

        return step

    rows = found.filter("word is not null").select("word", "near")
    return over_batches(rows, "word binary, n long, class int", start)


def transitions(docs: DataFrame, words: DataFrame, head: dict[bytes, int]) -> np.ndarray:
    """How often class j follows class i over all texts, with the classes of all ``words``; those of ``head`` without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            row, code, n = unpacked(batch.column(1))
            at = batch.column(0).to_numpy().astype(np.int64)[row]
            side = code // CLASSES
            a, b = np.where(side == 0, code, at), np.where(side == 1, code - CLASSES, at)
            np.add.at(total, a * CLASSES + b, n)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(cells // CLASSES, pa.int32()), "b": pa.array(cells % CLASSES, pa.int32()), "n": total[cells]}
        )

    found = table(contexts(docs, CLASSES, head, lambda word: -1), "moves", BATCH)
    pairs = matrix_of(found, CLASSES)
    classes = words.select("word", "class")
    rare = found.filter("word is not null and other is null").select("word", "near").join(classes, "word").select("class", "near")
    both = found.filter("other is not null").select("word", "other", "n").join(classes.withColumnRenamed("class", "a"), "word")
    both = both.join(classes.select(F.col("word").alias("other"), F.col("class").alias("b")), "other").select("a", "b", "n")
    rows = rare.mapInArrow(run, "a int, b int, n long").unionByName(both)
    for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # a row per pair of classes
        pairs[r["a"], r["b"]] += r["n"]
    return pairs


class Classes:
    """Classes of words on the driver: frequent ones are held, a rarer one is read with its part of the word table."""

    def __init__(self, head: dict[bytes, int], unseen: Unseen, words: DataFrame, kinds: int):
        self.head, self.unseen, parts = head, unseen, max(1, kinds // HELD)

        @lru_cache(8)
        def part(number: int) -> dict[bytes, int]:
            rows = words.filter(F.crc32("word") % F.lit(parts) == F.lit(number)).select("word", "class").toPandas()
            return dict(zip(map(bytes, rows["word"]), rows["class"].tolist()))

        self.rest = lambda word: part(crc32(word) % parts).get(word)

    def of(self, word: bytes) -> int:
        found = self.head.get(word)
        found = self.rest(word) if found is None else found
        return self.unseen.of(word) if found is None else found


class Unseen:
    """Class of words that no training text holds: the commonest among words seen once with the same two last bytes."""

    def __init__(self, words: DataFrame):
        once = words.filter(F.col("n") == 1).groupBy(F.substring("word", -2, 2).alias("ending"), "class").agg(F.count(F.lit(1)).alias("n"))
        best = F.max(F.struct("n", -F.col("class"))).alias("best")
        found = once.groupBy("ending").agg(best).collect()  # at most 2^16 + 2^8 endings
        whole = once.groupBy("class").agg(F.sum("n").alias("n")).agg(best).first()["best"]
        self.ending = {bytes(r["ending"]): -r["best"][1] for r in found}
        self.other = -whole[1] if whole else 1

    def of(self, word: bytes) -> int:
        return self.ending.get(word[-2:], self.other)


class Places(dict):
    """Places of the most frequent words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Model:
    def __init__(self, units, own, step, head, numbers, classes, unseen, tokens, kinds, mass):
        self.units, self.own, self.step = units, own, step  # own[units.of(word)]: its class; step: log10 P(class j | class i)
        self.head, self.numbers, self.classes = head, numbers, classes  # most frequent words, their counts and classes
        self.unseen = unseen  # classes of words that are not in the table
        self.tokens, self.kinds = tokens, kinds  # N and V
        self.mass = mass  # log10 of each class's n + 0.1 (v + 1)


def most_frequent(words: DataFrame) -> pd.DataFrame:
    """The most frequent words, at most ``HEAD``, by falling count: those above a count taken from a histogram.

    The histogram has a row per five per cent of count, so neither it nor the words found need a sort or a
    limit over the whole table.
    """
    step = F.floor(F.log(F.col("n").cast("double")) * 20)
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    room, least = HEAD, None
    for row in sizes:
        room -= row["words"]
        if room < 0:
            break
        least = row["step"]
    found = words.filter(step >= F.lit(least)) if least is not None else words.limit(0)
    return found.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the word table (``word``, ``n``, ``class``) of the training texts."""
    vocabulary = table(counts(docs), "words")
    size = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    head = most_frequent(vocabulary.filter(F.col("word") != F.lit(END)))
    words = [bytes(w) for w in head["word"]]
    others = vocabulary.filter((F.col("word") != F.lit(END)) & ~F.col("word").isin(words[:CORE]))
    ending = F.substring("word", -2, 2).alias("ending")
    common = others.groupBy(ending).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()
    units = Units(words[:CORE], [bytes(r["ending"]) for r in common])
    found = table(merged(contexts(docs, units.size, units.core, units.of), units.size), "contexts", BATCH)
    matrix = matrix_of(found, units.size)
    own = exchange(matrix, CLASSES)
    member = np.zeros((units.size, CLASSES))
    member[np.arange(units.size), own] = 1
    pairs = member.T @ matrix @ member
    fixed = vocabulary.filter((F.col("word") == F.lit(END)) | F.col("word").isin(words[:CORE])).toPandas()
    rows = [(bytes(w), int(n), 0 if bytes(w) == END else int(own[units.core[bytes(w)]])) for w, n in zip(fixed["word"], fixed["n"])]
    core = docs.sparkSession.createDataFrame(rows, "word binary, n long, class int")
    classed = table(exchanged(found, pairs, units, own).unionByName(core), "classes")

    head = most_frequent(classed.filter(F.col("word") != F.lit(END)))
    classes = dict(zip(map(bytes, head["word"]), head["class"].tolist()))
    pairs = transitions(docs, classed, classes)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    step = np.log10((pairs + PULL * share) / (pairs.sum(axis=1, keepdims=True) + PULL))
    mass = np.full(CLASSES, np.log10(ADD))
    for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["class"]] = np.log10(r["n"] + ADD * (r["v"] + 1))
    unseen = Unseen(classed)
    found = Classes(classes, unseen, classed, size[1])
    numbers = head["n"].to_numpy(dtype=np.float64)
    return Model(found, np.arange(CLASSES), step, list(classes), numbers, head["class"].to_numpy(dtype=np.int64), unseen, size[0] or 0, size[1], mass), classed


def scored(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """``docs`` with log10 probabilities of each text under the model and under the unigram base, and token counts.

    All columns but ``text`` come back, next to the results; the text is read once and not exchanged. Words outside the
    head are joined with the word table by occurrence: the class before is known in the task, or that of the word
    before in the same run of such words.
    """
    kept = docs.select(*quoted([c for c in docs.columns if c not in ADDED]))
    keyed = kept.withColumn("_row", F.monotonically_increasing_id())  # fixed by the table it is written to
    ended = vocabulary.filter(F.col("word") == F.lit(END)).first()
    ends = float(np.log10((ended["n"] if ended else 0) + ADD))
    end_known = int(ended is not None)
    head, numbers, classes, unseen, moves, mass = model.head, model.numbers, model.classes, model.unseen, model.step, model.mass

    def start():
        place = Places((w, i) for i, w in enumerate(head))
        logs = np.r_[np.log10(numbers + ADD), 0]
        own = np.r_[classes, -1]
        enter = np.zeros((CLASSES + 1, CLASSES + 1))  # the last row and column: not known here
        enter[:-1, :-1] = moves - mass

        def step(batch):
            numbers, tails, ways = [], [], []
            for text in raw(batch, "text"):
                words = words_of(text)
                found = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
                rare = np.flatnonzero(found < 0)
                path = np.r_[0, own[found], 0]
                tail = [words[i] for i in rare.tolist()]
                other = np.fromiter(map(unseen.of, tail), dtype=np.int64, count=len(tail))
                numbers.append((len(words) + 1, len(words) - len(rare), logs[found].sum() + ends, enter[path[:-1], path[1:]].sum()))
                tails.append(tail)
                ways.append(((path[rare] + 1) * (CLASSES + 1) + path[rare + 2] + 1) * CLASSES + other)
            columns = list(zip(*numbers)) or [[]] * 4
            return [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.float64()),
                pa.array(columns[3], pa.float64()),
                pa.array(tails, pa.list_(pa.binary())),
                pa.array(ways, pa.list_(pa.int32())),
            ]

        return step

    schema = "_tokens bigint, _common bigint, _known double, _moves double, _tail array<binary>, _ways array<int>"
    narrow = table(appended(keyed, schema, start).drop("text"), "texts", BATCH)
    rare = narrow.select("_row", F.posexplode(F.arrays_zip("_tail", "_ways")).alias("_at", "_w")).select(
        "_row", "_at", F.col("_w._tail").alias("word"), F.col("_w._ways").alias("_way")
    )
    met = rare.join(vocabulary, "word", "left").select(
        "_row",
        "_at",
        "n",
        F.coalesce("class", F.col("_way") % CLASSES).alias("_class"),
        (F.floor(F.col("_way") / (CLASSES * (CLASSES + 1))) - 1).cast("int").alias("_given"),
        (F.floor(F.col("_way") / CLASSES) % (CLASSES + 1) - 1).cast("int").alias("_after"),
    )
    run = F.lag("_class").over(Window.partitionBy("_row").orderBy("_at"))
    met = met.withColumn("_before", F.when(F.col("_given") < 0, run).otherwise(F.col("_given")))
    cells = [(a, b, float(moves[a, b] - mass[b])) for a in range(CLASSES) for b in range(CLASSES)]
    small = F.broadcast(docs.sparkSession.createDataFrame(cells, "_a int, _b int, _step double"))
    met = met.join(small.toDF("_before", "_class", "_enter"), ["_before", "_class"], "left")
    met = met.join(small.toDF("_class", "_after", "_leave"), ["_class", "_after"], "left")
    sums = met.groupBy("_row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("_rare"),
        F.sum(F.col("_enter") + F.coalesce("_leave", F.lit(0.0))).alias("_turns"),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("_seen"),
    )
    rest = F.coalesce("_rare", F.lit(0.0))
    whole = float(np.log10(model.tokens + ADD * (model.kinds + 1)))
    score = F.col("_known") + F.col("_moves") + rest + F.coalesce("_turns", F.lit(0.0))
    out = narrow.join(sums, "_row", "left").withColumns(
        {
            "n_tokens": F.col("_tokens"),
            "n_known": F.col("_common") + F.coalesce("_seen", F.lit(0)) + F.lit(end_known),
            "train_tokens": F.lit(model.tokens).cast("long"),
            "base_score": F.col("_known") + rest - F.col("_tokens") * F.lit(whole),
            "score": score,
            "perplexity": F.pow(F.lit(10.0), -score / F.col("_tokens")),
        }
    )
    return out.select(*quoted([c for c in kept.columns if c != "text"]), *ADDED)
