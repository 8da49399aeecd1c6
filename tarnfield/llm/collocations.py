"""Phrase collocations per language: frequent phrases of 2 to 4 words, counted by double-array tries.

Texts (A-Z lower-cased) fall into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs.
Words that occur ``FREQUENT`` times or more in their language become symbols; the texts become arrays of
symbols with a barrier wherever a piece ends or a rarer word stands, written once.

Level by level: a phrase is a candidate if its words but the last and its words but the first are both
frequent phrases (no other phrase can be frequent) and the partial counts of that pair of phrases, each cut at
``FREQUENT``, reach it. Candidates are packed into double-array tries of about ``TRIE`` phrases; a trie is built
from its rows alone by a task of its own, and broadcast, so what the driver or a task holds of them at once has
a fixed size. The symbols of a phrase tell its trie, so each text position visits one trie, however many there are; a
task loads a trie once for a group of slices. numpy advances the states of all these positions together, word by
word through the trie; the accepting states are counted by bincount, and the counts of all tasks are summed. The
states at neighbouring positions give the next level's candidates.

A candidate's score is floor(2000000 a / (l + r)), in exact decimals, for its weakest cut into a first part (l)
and a rest (r), ties to the shortest first part. It is dropped if a longer phrase that contains it occurs at
least 80 % as often. Languages are ranked apart, in two steps so that no task ranks a whole language.

Null and empty texts have no words; a missing language is ``und``. Texts of any length are taken whole. Repeated
rows count as often as they come. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import BATCH, over_parts, raw, ship, slices, table

ship(__name__)

FREQUENT = 30
LONGEST = 4
TOP = 2_000
CONTAINED = 80  # percent
TRIE = 1 << 19  # phrases aimed at in one trie; ids leave room for eight times as many
ROOM = 1 << 22
DIGIT = 11  # bits of a symbol that one step of a trie takes
SLICE = 1 << 22  # bytes of text handled at once
GROUP = 1 << 23  # text positions for which a task loads each of several tries once
HELD = 1 << 23  # counts that a task holds before it hands them on
PAIRS = 1 << 19  # pairs of neighbours that a task counts at once
WIDE = 1 << 24  # symbols, known or not, that a table of a trie's symbols may span
FACTOR, PRIME = 1_103_515_245, (1 << 31) - 1  # products stay within 63 bits
PARTS = 64  # of a language, ranked apart first

#: A-Z lower-cased, tabs as blanks, every separator of pieces as a line feed.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256)
)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and a place for each; words of one piece that follow each other have places that do."""
    letters = np.frombuffer(b"\n".join(texts).translate(FOLD), dtype=np.uint8)
    inside = np.zeros(len(letters) + 2, dtype=bool)
    inside[1:-1] = (letters != 32) & (letters != 10)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = letters[inside[1:-1]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    piece = np.searchsorted(np.flatnonzero(letters == 10), starts)
    places = np.arange(len(starts))
    places[1:] += np.cumsum(piece[1:] != piece[:-1])
    return words, places


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, in slices."""
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    texts = raw(batch, "text")
    for part in slices(texts, SLICE):
        per: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[part], texts[part]):
            if text:
                per.setdefault("und" if lang is None else lang, []).append(text)
        yield from per.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` of all words."""

    def start():
        def step(batch):
            for lang, texts in by_language(batch):
                found = words_of(texts)[0].value_counts()
                yield {
                    "lang": pa.repeat(pa.scalar(lang, pa.string()), len(found)),
                    "word": found.field("values").cast(pa.binary()).cast(pa.string()),
                    "n": found.field("counts"),
                }

        return step

    counted = over_parts(docs.select("lang", "text"), "lang string, word string, n long", start)
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_marks(langs: list[str], words: list[bytes], seed: int = 0) -> np.ndarray:
    """What ``xxhash64(lang, word)`` gives in Spark, if ``seed`` is 0."""
    digest = xxhash.xxh64_intdigest
    starts = {lang: digest(lang.encode(), 42 + seed) for lang in set(langs)}
    return np.fromiter((digest(w, starts[lang]) for lang, w in zip(langs, words)), dtype=np.uint64, count=len(words))


def phrase_mark(symbols: Column) -> Column:
    return F.aggregate(symbols, F.lit(0).cast("long"), lambda mark, symbol: (mark * FACTOR + symbol) % PRIME)


def phrase_marks(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``phrase_mark`` of the ``length`` symbols from each position on."""
    marks = np.zeros(len(at), dtype=np.int64)
    for word in range(length):
        marks = (marks * FACTOR + codes[at + word]) % PRIME
    return marks


def identified(df: DataFrame, mark: Column, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``shard`` (of about ``TRIE`` rows, told by ``mark``) and ``id``, and the number of shards.

    Ids of a shard follow ``order`` without gaps.
    """
    shards = max(1, math.ceil(df.count() / TRIE))
    if shards * ROOM > 1 << 31:
        raise ValueError("more frequent phrases than ids")
    placed = df.withColumn("shard", F.pmod(mark, F.lit(shards)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    return placed.withColumn("id", (F.col("shard") * ROOM + nth).cast("int")), shards


def by_shard(df: DataFrame, order: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one shard after the other, in order; each is bounded."""
    shards = df.agg(F.max("shard")).first()[0]
    for shard in range(0 if shards is None else shards + 1):
        rows = df.filter(F.col("shard") == shard).drop("shard").toArrow().sort_by(order)
        if rows.num_rows:
            if rows.num_rows > ROOM:
                raise ValueError("a shard holds more phrases than it has ids")
            yield shard, rows.combine_chunks()


def held(shared: Broadcast):
    """Value of a broadcast that the task lets go of again, so that it holds one at a time."""
    value = shared.value
    if getattr(shared, "_path", None):  # it can be loaded again
        shared.__dict__.pop("_value", None)
    return value


class Vocabulary:
    """Frequent words of one shard: sorted hashes, ids, and the words themselves to make sure."""

    def __init__(self, rows: pa.Table):
        langs, words = rows["lang"].to_pylist(), [w.encode() for w in rows["word"].to_pylist()]
        self.seed = 0
        while True:
            hashes = word_marks(langs, words, self.seed)
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break
            self.seed += 1  # two words met in one hash
        self.ids = rows["id"].to_numpy()[order]
        keys = [lang.encode() + b"\x00" + w for lang, w in zip(langs, words)]
        self.keys = pa.array(keys, pa.large_binary()).take(pa.array(order))

    def ids_of(self, lang: str, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Id of each word (with its ``word_marks``), -1 where it is none of these words."""
        if self.seed:
            hashes = word_marks([lang] * len(words), words, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[at] == hashes)
        out = np.full(len(words), -1, dtype=np.int32)
        head = lang.encode() + b"\x00"
        same = pc.equal(self.keys.take(pa.array(at[met])), pa.array([head + words[i] for i in met], pa.large_binary()))
        met = met[same.to_numpy(zero_copy_only=False)]
        out[met] = self.ids[at[met]]
        return out


def encoded(docs: DataFrame, vocabularies: dict[int, Broadcast], shards: int) -> DataFrame:
    """``codes``: slices of text as 32-bit ids of frequent words, with -1 for barriers, compressed one by one.

    A task holds the compressed slices of a whole batch but only one slice of open codes. A word is looked up in
    the vocabulary of its shard alone.
    """

    def start():
        pack = zstandard.ZstdCompressor(level=1).compress

        def step(batch):
            for lang, texts in by_language(batch):
                words, places = words_of(texts)
                if not len(words):
                    continue
                kinds = words.dictionary_encode()
                keys = kinds.dictionary.to_pylist()
                hashes = word_marks([lang] * len(keys), keys)
                ids = np.full(len(keys), -1, dtype=np.int32)
                for shard, shared in vocabularies.items():
                    mine = np.flatnonzero(hashes.view(np.int64) % shards == shard)
                    ids[mine] = held(shared).ids_of(lang, [keys[i] for i in mine], hashes[mine])
                codes = np.full(places[-1] + 1, -1, dtype=np.int32)
                codes[places] = ids[kinds.indices.to_numpy()]
                keep = codes >= 0  # one barrier in a row is enough
                keep[1:] |= codes[:-1] >= 0
                yield {"codes": pa.array([pack(codes[keep].tobytes())], pa.binary())}

        return step

    return over_parts(docs.select("lang", "text"), "codes binary", start)


class DoubleArray:
    """A trie of digit strings of one length: the child of state ``s`` by ``d`` is ``base[s] + d`` if ``check`` there is ``s``."""

    def __init__(self, digits: np.ndarray, width: int):
        rows, depth = digits.shape
        self.width, self.random = width, np.random.default_rng(11)
        first = np.zeros((rows, depth), dtype=bool)
        first[0] = True
        first[1:] = np.logical_or.accumulate(digits[1:] != digits[:-1], axis=1)
        size = width + 64 + int(first.sum() * 1.2)
        self.base, self.check = np.zeros(size + width, np.int32), np.full(size + width, -1, np.int32)
        self.check[0] = 0  # the root is nobody's child: no base is 0
        state = np.zeros(rows, dtype=np.int64)
        for d in range(depth):
            new = np.flatnonzero(first[:, d])
            slots = self.placed(state[new], digits[new, d].astype(np.int64))
            state = slots[np.cumsum(first[:, d]) - 1]
        self.accepts = np.full(len(self.check), -1, np.int32)
        self.accepts[state] = np.arange(rows)

    def grow(self, least: int) -> None:
        more = max(least, len(self.check) // 4)
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def placed(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """A slot for each child; children of one parent stand together, in the order of their digits."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(starts, append=len(parents))
        slots = np.zeros(len(parents), dtype=np.int64)
        for low, high in ((256, 1 << 30), (32, 256), (8, 32), (2, 8)):  # full nodes first, only children last
            pending = np.flatnonzero((sizes >= low) & (sizes < high))
            while len(pending):
                count = sizes[pending]
                heads = np.cumsum(count) - count
                child = np.repeat(starts[pending] - heads, count) + np.arange(count.sum())
                base = self.random.integers(1, len(self.check) - self.width, len(pending))
                want = np.repeat(base, count) + digits[child]
                lone = np.zeros(len(want), dtype=bool)
                lone[np.unique(want, return_index=True)[1]] = True
                good = np.logical_and.reduceat(lone & (self.check[want] < 0), heads)
                mine = np.repeat(good, count)
                slots[child[mine]] = want[mine]
                self.check[want[mine]] = np.repeat(parents[starts[pending]], count)[mine]
                self.base[parents[starts[pending[good]]]] = base[good]
                if good.sum() * 8 < len(pending):
                    self.grow(self.width)
                pending = pending[~good]
        single = starts[sizes == 1]
        free = np.flatnonzero(self.check[self.width : len(self.check) - self.width] < 0) + self.width
        if len(free) < len(single):
            self.grow(len(single) - len(free) + self.width)
            free = np.flatnonzero(self.check[self.width : len(self.check) - self.width] < 0) + self.width
        at = free[: len(single)]
        slots[single] = at
        self.check[at] = parents[single]
        self.base[parents[single]] = at - digits[single]
        return slots

    def step(self, states: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states of those that go on, and which do."""
        to = self.base[states] + digits
        goes = self.check[to] == states
        return to[goes], goes


class PhraseTrie:
    """Phrases of one length and shard; positions of a text are advanced together."""

    def __init__(self, shard: int, rows: pa.Table):
        symbols = rows["symbols"].combine_chunks()
        n = len(symbols)
        paths = symbols.flatten().to_numpy().reshape(n, -1)
        self.first, self.length = shard * ROOM, paths.shape[1]
        self.known, local = np.unique(paths, return_inverse=True)
        if len(self.known) > 1 << 2 * DIGIT:
            raise ValueError("more symbols in a trie than two digits tell apart")
        local = local.reshape(n, -1)
        digits = np.stack([local >> DIGIT, local & ((1 << DIGIT) - 1)], axis=2).reshape(n, -1)
        order = np.lexsort(digits.T[::-1])
        self.trie = DoubleArray(digits[order], 1 << DIGIT)
        accepts = self.trie.accepts
        accepts[accepts >= 0] = (rows["id"].to_numpy() - self.first)[order][accepts[accepts >= 0]]
        self.count = int(rows["id"].to_numpy().max()) - self.first + 1

    def packed(self) -> pa.Table:
        """One row of what ``unpacked`` needs, compressed."""
        pack = zstandard.ZstdCompressor(level=1).compress
        arrays = {"known": self.known, "base": self.trie.base, "check": self.trie.check, "accepts": self.trie.accepts}
        plain = {"shard": self.first // ROOM, "length": self.length, "count": self.count}
        held = {name: pa.array([pack(x.astype(np.int32).tobytes())], pa.binary()) for name, x in arrays.items()}
        return pa.table({name: pa.array([x], pa.int32()) for name, x in plain.items()} | held)

    @classmethod
    def unpacked(cls, row: dict) -> PhraseTrie:
        unpack = zstandard.ZstdDecompressor().decompress
        one, one.trie = cls.__new__(cls), DoubleArray.__new__(DoubleArray)
        one.first, one.length, one.count = row["shard"] * ROOM, row["length"], row["count"]
        one.known, *arrays = (np.frombuffer(unpack(row[name]), dtype=np.int32) for name in ("known", "base", "check", "accepts"))
        one.trie.base, one.trie.check, one.trie.accepts = arrays
        return one

    def spread(self) -> np.ndarray | None:
        """The numbers of all symbols up to the last known one in a row, without the ids that no shard reaches."""
        shards, self.stride = int(self.known[-1]) // ROOM + 1, int((self.known & (ROOM - 1)).max()) + 1
        if shards * self.stride > WIDE:
            return None
        out = np.full(shards * self.stride + 1, -1, dtype=np.int32)  # the last one stands for all symbols beyond
        out[self.known // ROOM * self.stride + (self.known & (ROOM - 1))] = np.arange(len(self.known))
        return out

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Each symbol's number in this trie, -1 for others."""
        if not hasattr(self, "table"):
            self.table = self.spread()
        if self.table is not None:
            nth = codes & (ROOM - 1)
            inside = (codes >= 0) & (codes <= self.known[-1]) & (nth < self.stride)
            return self.table[np.where(inside, (codes >> ROOM.bit_length() - 1) * self.stride + nth, -1)]
        found = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        found[self.known[found] != codes] = -1
        return found

    def accepted(self, codes: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase starts and its number in the shard; only of those ``at`` that have room, if given."""
        if few := at is not None:
            local = None
        else:
            local = np.r_[self.numbers(codes), np.full(self.length, -1, np.int32)]
            at = np.flatnonzero(local[: len(codes)] >= 0)
        states = np.zeros(len(at), dtype=np.int64)
        for word in range(self.length):
            symbol = self.numbers(codes[at + word]) if few else local[at + word]
            alive = symbol >= 0
            at, states, symbol = at[alive], states[alive], symbol[alive]
            states, goes = self.trie.step(states, symbol >> DIGIT)
            at, symbol = at[goes], symbol[goes]
            states, goes = self.trie.step(states, symbol & ((1 << DIGIT) - 1))
            at = at[goes]
        return at, self.trie.accepts[states]


def built(placed: DataFrame, shards: int) -> Iterator[tuple[int, PhraseTrie]]:
    """The trie of one shard after the other; tasks build them, each its shards."""

    def build(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        if rows.num_rows > ROOM:
            raise ValueError("a shard holds more phrases than it has ids")
        return PhraseTrie(key[0].as_py(), rows.sort_by("id").combine_chunks()).packed()

    schema = "shard int, length int, count int, known binary, base binary, check binary, accepts binary"
    rows = placed.select("shard", "symbols", "id").repartition(shards, "shard").groupBy("shard")
    packed = table(rows.applyInArrow(build, schema), "tries")
    for shard in range(shards):
        for row in packed.filter(F.col("shard") == shard).toArrow().to_pylist():
            yield shard, PhraseTrie.unpacked(row)


def dealt(codes: np.ndarray, length: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``length`` symbols before the next barrier in the order of their shards, and where each shard begins."""
    alive = codes[: max(0, len(codes) - length + 1)] >= 0
    for word in range(1, length):
        alive &= codes[word : len(alive) + word] >= 0
    at = np.flatnonzero(alive).astype(np.int32)
    shard = (phrase_marks(codes, at, length) % shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    return at[np.argsort(shard, kind="stable")], np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]


def advanced(group: list[np.ndarray], tries: Iterator[tuple[int, PhraseTrie]], shards: int, length: int, total: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Ids of the phrases that start at the positions of each slice (-1: none); their counts are added to ``total`` by the trie's first id."""
    ids = [np.full(len(codes), -1, dtype=np.int32) for codes in group]
    places = [dealt(codes, length, shards) for codes in group] if shards > 1 else []
    for shard, trie in tries:
        for k, codes in enumerate(group):
            some = places[k][0][places[k][1][shard] : places[k][1][shard + 1]] if places else None
            at, found = trie.accepted(codes, some)
            n = np.bincount(found, minlength=trie.count)
            total[trie.first] = total[trie.first] + n if trie.first in total else n
            ids[k][at] = trie.first + found
    return ids


def scanned(codes: DataFrame, tries: dict[int, Broadcast], shards: int, length: int, last: bool) -> DataFrame:
    """Counts of phrases of ``length`` words and, unless ``last``, partial counts of pairs of neighbouring ones.

    ``pair`` false: ``key`` is an id. ``pair`` true: ``key`` holds the ids at a position and at the next one.
    """

    def rows(pair: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), pair)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "key", "n"]
        )

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Open slices, of ``GROUP`` positions together where there are several tries to load."""
        unpack, group = zstandard.ZstdDecompressor().decompress, []
        for batch in batches:
            for packed in batch.column(0):
                group.append(np.frombuffer(unpack(packed.as_buffer()), dtype=np.int32))
                if shards == 1 or sum(map(len, group)) >= GROUP:
                    yield group
                    group = []
        if group:
            yield group

    def counts(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for first in list(total):
            n = total.pop(first)
            at = np.flatnonzero(n)
            yield rows(False, first + at, n[at])

    def neighbours(ids: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return (ids[at].astype(np.int64) << 32) | ids[at + 1]

    def pairs(met: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(met), return_counts=True)
        met.clear()
        return rows(True, keys, np.minimum(n, FREQUENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of the whole task, however many batches it gets, while they are few
        met: list[np.ndarray] = []
        for group in groups(batches):
            found = group
            if length > 1:
                found = advanced(group, ((shard, held(shared)) for shard, shared in tries.items()), shards, length, total)
            for ids in [] if last else found:
                met.append(neighbours(ids))
                if sum(map(len, met)) >= PAIRS:
                    yield pairs(met)
            if sum(map(len, total.values())) > HELD:
                yield from counts(total)
        if met:
            yield pairs(met)
        yield from counts(total)

    found = codes.mapInArrow(run, "pair boolean, key long, n long")
    summed = found.groupBy("pair", "key").agg(F.sum("n").alias("n"))
    return summed.filter(~F.col("pair") | (F.col("n") >= FREQUENT))


def longer(shorter: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates ``lang``, ``symbols``, ``text`` out of pairs of neighbouring shorter phrases."""
    head = shorter.select(F.col("id").alias("head"), "lang", "symbols", "text")
    tail = shorter.select(
        F.col("id").alias("tail"), F.element_at("symbols", -1).alias("symbol"), F.substring_index("text", " ", -1).alias("word")
    )
    split = pairs.select(F.shiftright("key", 32).cast("int").alias("head"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("tail"))
    met = split.join(head, "head").join(tail, "tail")
    return met.select("lang", F.concat("symbols", F.array("symbol")).alias("symbols"), F.concat_ws(" ", "text", "word").alias("text"))


def phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to 4 words (``lang``, ``symbols``, ``text``, ``size``, ``f``) and all words (``lang``, ``word``, ``n``)."""
    spark = docs.sparkSession
    words = table(word_counts(docs), "word_counts", BATCH)
    often, shards = identified(words.filter(F.col("n") >= FREQUENT), F.xxhash64("lang", "word"), "lang", "word")
    frequent = table(often, "vocabulary")
    shared = {
        shard: spark.sparkContext.broadcast(Vocabulary(rows))
        for shard, rows in by_shard(frequent.select("shard", "lang", "word", "id"), "id")
    }
    codes = table(encoded(docs, shared, shards), "codes", BATCH)
    for one in shared.values():
        one.unpersist()
    level = frequent.select("id", "lang", F.array("id").alias("symbols"), F.col("word").alias("text"))
    found = [level.join(frequent.select("id", F.col("n").alias("f")), "id")]
    tries: dict[int, Broadcast] = {}
    for size in range(1, LONGEST + 1):
        counted = table(scanned(codes, tries, shards, size, last=size == LONGEST), "counts", BATCH)
        for one in tries.values():
            one.unpersist()
        if size > 1:
            found.append(level.join(counted.filter("NOT pair").select(F.col("key").cast("int").alias("id"), F.col("n").alias("f")), "id"))
        if size < LONGEST:
            made = longer(level, counted.filter("pair"))
            placed, shards = identified(table(made, "candidates"), phrase_mark(F.col("symbols")), "symbols")
            placed = table(placed, "phrases")
            tries = {shard: spark.sparkContext.broadcast(trie) for shard, trie in built(placed, shards)}
            level = placed.select("id", "lang", "symbols", "text")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return table(out.select("lang", "symbols", "text", F.size("symbols").alias("size"), "f"), "frequent"), words


def scored(found: DataFrame) -> DataFrame:
    """``symbols``, ``a``, ``l``, ``r``, ``score`` of phrases of two words or more at their weakest cut."""
    whole = found.filter("size > 1").select("symbols", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("cut"))
    parts = whole.withColumns({
        "head": F.slice("symbols", F.lit(1), F.col("cut")),
        "rest": F.slice("symbols", F.col("cut") + 1, F.size("symbols") - F.col("cut")),
    })
    of = found.select("symbols", "f")
    met = parts.join(of.toDF("head", "l"), "head").join(of.toDF("rest", "r"), "rest")
    score = F.expr("(CAST(a AS DECIMAL(25,0)) * 2000000BD) div (CAST(l AS DECIMAL(25,0)) + CAST(r AS DECIMAL(25,0)))")
    cut = met.withColumn("score", score).groupBy("symbols", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    return cut.select("symbols", "a", "weakest.l", "weakest.r", F.col("weakest.score").cast("long").alias("score"))


def contained(found: DataFrame) -> DataFrame:
    """``symbols``, ``most``: count of the most frequent longer phrase that contains the phrase."""
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> slice(symbols, i, n))))"
    )
    inner = found.filter("size > 2").select(F.explode(spans).alias("symbols"), "f")
    return inner.groupBy("symbols").agg(F.max("f").alias("most"))


def ranked(rows: DataFrame, within: str, order: list[Column], top: int) -> DataFrame:
    """``rank`` from 1 and only the first ``top`` of each key, first in parts of the key."""
    part = Window.partitionBy(within, F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of each language."""
    found, words = phrases(docs)
    met = scored(found).join(contained(found), "symbols", "left")
    kept = met.filter(f"most IS NULL OR CAST(100 AS DECIMAL(3,0)) * most < CAST({CONTAINED} AS DECIMAL(3,0)) * a")
    named = kept.join(found.select("symbols", "lang", F.col("text").alias("phrase")), "symbols")
    best = table(ranked(named, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top), "ranked")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    met = best.join(total, "lang")
    return met.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
