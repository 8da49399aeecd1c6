"""Quality rules by tokeniser fertility: how well public vocabularies fit a text, with bands per language.

The words of a text are encoded one by one. Four measures follow: code points per token of a byte-level
vocabulary (``chars_per_byte_token``; it sees a blank before the word) and of a vocabulary of pieces
(``chars_per_piece``), the share of pieces that are single bytes (``byte_share``), and the mean entropy in bits
of the byte-level tokens in windows of 64 consecutive tokens (``token_entropy``; the last window ends with the
text, a shorter text is one window), which does not grow with the length of the text.

A measure's band in a group is its median plus and minus ``WIDTH`` times its median absolute deviation (at
least ``LEAST`` of the measure). Medians are exact to a bin of a fixed histogram over all texts that pass the
plain rules, so they do not depend on the order of rows. The group is the language where at least ``ENOUGH``
such texts have it, else the script of most letters where ``ENOUGH`` texts of rarer languages have that, else
all texts. A text outside a band is rejected and ``outside`` names the measures.

Plain rules: fewer than 50 words, or over half of the words in three-word windows that occur twice or more in
the text. They also give ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``.

Null and empty texts have no words and fail the plain rules; their measures are null. Very long texts are
measured whole. Repeated rows are judged alike, each on its own; an empty table gives an empty table. Rows
without id or language are judged like others. Extra columns stay; those named like an added one are replaced.
"""

from __future__ import annotations

import base64
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import apart, appended, raw, ship, slices, table

ship(__name__)

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabularies, present on every executor
WINDOW = 64
KEPT = 1 << 18  # words remembered in a task
SLICE = 1 << 22  # bytes of text whose words are looked up together
WIDTH = 8.0
ENOUGH = 100
MEASURES = ("chars_per_byte_token", "chars_per_piece", "byte_share", "token_entropy")
BINS = {"chars_per_byte_token": 64, "chars_per_piece": 64, "byte_share": 1024, "token_entropy": 64}  # per unit
LEAST = {"chars_per_byte_token": 0.06, "chars_per_piece": 0.06, "byte_share": 0.004, "token_entropy": 0.06}

# The pre-split of the byte-level vocabularies as their publishers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")

PLAIN = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURED = f"{PLAIN}, script string, {', '.join(m + ' double' for m in MEASURES)}"


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and where each list begins and the last one ends."""
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))]
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1])), ends


class Words:
    """What the vocabularies make of each distinct word; at most about ``KEPT`` words are remembered."""

    def __init__(self, folder: str):
        with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_bytes = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.by_pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.is_byte = np.array([self.by_pieces.is_byte(i) for i in range(self.by_pieces.get_piece_size())])
        self.scripts: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.figures = np.zeros((5, 0), dtype=np.int64)  # code points, pieces, byte pieces, letters, script
        self.starts, self.tokens = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def learn(self, lists: list[list[bytes]]) -> None:
        """Know every word of the lists."""
        if len(self.number) > KEPT:
            self.forget()
        fresh = sorted(set().union(*lists).difference(self.number))
        if not fresh:
            return
        texts = [w.decode() for w in fresh]
        tokens, token_ends = flat([self.by_bytes.encode_ordinary(" " + t) for t in texts])
        pieces, piece_ends = flat(self.by_pieces.encode(texts, num_threads=1))
        in_bytes = np.r_[0, np.cumsum(self.is_byte[pieces])]
        letters, scripts = zip(*map(self.letters, texts))
        new = [list(map(len, texts)), np.diff(piece_ends), np.diff(in_bytes[piece_ends]), letters, scripts]
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        self.figures = np.concatenate([self.figures, np.array(new, dtype=np.int64)], axis=1)
        self.starts = np.concatenate([self.starts, self.starts[-1] + token_ends[1:]])
        self.tokens = np.concatenate([self.tokens, tokens])

    def letters(self, word: str) -> tuple[int, int]:
        """Number of letters of the word's most frequent script (ties: first of ``SCRIPTS``), and that script."""
        if word.isascii():
            return sum(map(str.isalpha, word)), 0
        found: Counter = Counter()
        for letter in filter(str.isalpha, word):
            if letter not in self.scripts:
                named = (k for k, s in enumerate(SCRIPTS) if regex.match(rf"\p{{Script={s}}}", letter))
                self.scripts[letter] = next(named, len(SCRIPTS))
            found[self.scripts[letter]] += 1
        most = min(found, key=lambda k: (-found[k], k), default=0)
        return found[most], most

    def measures(self, at: np.ndarray) -> tuple:
        """Script and the four measures of a text, given as its words' numbers."""
        points, pieces, in_bytes, letters, script = self.figures[:, at]
        per = np.bincount(script, weights=letters, minlength=len(SCRIPTS) + 1)
        named = (*SCRIPTS, "other")[int(per.argmax())] if per.any() else ""
        length = self.starts[at + 1] - self.starts[at]
        begins = np.cumsum(length) - length
        tokens = self.tokens[np.arange(length.sum()) + np.repeat(self.starts[at] - begins, length)]
        if not len(tokens) or not pieces.sum():
            return named, None, None, None, None
        total = int(points.sum())
        share = float(in_bytes.sum() / pieces.sum())
        return named, total / len(tokens), total / int(pieces.sum()), share, window_entropy(tokens)


def repeated_words(at: np.ndarray) -> int:
    """Words, given as numbers, inside windows of three that occur at least twice."""
    if len(at) < 4:
        return 0
    many = int(at.max()) + 1
    pairs = at[:-1] * many + at[1:]
    if many > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].ravel()
    _, which, n = np.unique(pairs[:-1] * many + at[2:], return_inverse=True, return_counts=True)
    again = n[which.ravel()] > 1
    inside = np.zeros(len(at), dtype=bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def plain_rules(text: bytes, at: np.ndarray) -> tuple:
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = repeated_words(at)
    return (
        len(at),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        again,
        len(at) < 50 or 100 * again > 50 * len(at),
    )


def window_entropy(tokens: np.ndarray) -> float:
    """Mean entropy, in bits, of windows of ``WINDOW`` tokens."""
    size = min(WINDOW, len(tokens))
    whole = len(tokens) // size * size
    rows = tokens[:whole].reshape(-1, size)
    if whole < len(tokens):
        rows = np.vstack([rows, tokens[-size:]])
    rows = np.sort(rows, axis=1)
    first = np.ones(rows.shape, dtype=bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    starts = np.flatnonzero(first)  # of equal tokens; each row starts anew
    n = np.diff(starts, append=rows.size)
    return float(np.log2(size) - (n * np.log2(n)).sum() / size / len(rows))


def measured(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``docs`` with the plain rules' figures, the script and the four measures."""

    def start():
        words = Words(folder)

        def step(batch):
            rows = []
            texts = raw(batch, "text")
            for part in slices(texts, SLICE):
                some = [t or b"" for t in texts[part]]
                lists = [t.split() for t in some]  # bytes: the six ASCII spaces only
                words.learn(lists)
                for text, own in zip(some, lists):
                    at = np.array([words.number[w] for w in own], dtype=np.int64)
                    rows.append(plain_rules(text, at) + words.measures(at))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.string()] + [pa.float64()] * 4
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

        return step

    return appended(docs, MEASURED, start)


def histograms(kept: DataFrame) -> DataFrame:
    """``group``, ``measure``, ``bin``, ``n`` of rows with ``group`` and the measures."""
    bins = [F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * BINS[m]).cast("int").alias("bin")) for m in MEASURES]
    long = kept.select("group", F.explode(F.array(*bins)).alias("b")).filter("b.bin IS NOT NULL")
    return long.groupBy("group", "b.measure", "b.bin").agg(F.count(F.lit(1)).alias("n"))


def medians(counted: DataFrame, value: str) -> DataFrame:
    """Smallest ``value`` with at least half of the rows up to it, per group and measure of a histogram."""
    within = Window.partitionBy("group", "measure").orderBy(value)
    total = Window.partitionBy("group", "measure")
    at = counted.withColumns({"upto": F.sum("n").over(within), "all": F.sum("n").over(total)})
    return at.filter("2 * upto >= all").groupBy("group", "measure").agg(F.min(value).alias("middle"))


def bands(counted: DataFrame, width: float = WIDTH) -> DataFrame:
    """``group``, ``measure``, ``low``, ``high`` out of histograms with one row per group, measure and bin."""
    middle = medians(counted, "bin")
    far = counted.join(middle, ["group", "measure"]).withColumn("away", F.abs(F.col("bin") - F.col("middle")))
    far = far.groupBy("group", "measure", "away").agg(F.sum("n").alias("n"))
    spread = medians(far, "away").withColumnRenamed("middle", "spread")
    per, least = F.lit(1.0), F.lit(0.0)
    for m in MEASURES:
        per = F.when(F.col("measure") == m, F.lit(float(BINS[m]))).otherwise(per)
        least = F.when(F.col("measure") == m, F.lit(LEAST[m])).otherwise(least)
    centre = (F.col("middle") + 0.5) / per
    reach = width * F.greatest(F.col("spread") / per, least)
    met = middle.join(spread, ["group", "measure"])
    return met.select("group", "measure", (centre - reach).alias("low"), (centre + reach).alias("high"))


def judged(docs: DataFrame, folder: str = TOKENIZERS, width: float = WIDTH, texts: bool = True) -> DataFrame:
    """``docs`` with the figures, ``group``, ``outside`` (measures outside their band) and ``kept``.

    With ``texts`` false the texts do not come back and are not written on the way.
    """

    def step(given: DataFrame) -> DataFrame:
        if "lang" not in given.columns:
            given = given.withColumn("lang", F.lit(None).cast("string"))
        found = measured(given, folder)
        found = table(found if texts else found.drop("text"), "measured")
        good = found.filter("NOT base_failed")
        by_lang = F.concat(F.lit("lang "), "lang")
        by_script = F.concat(F.lit("script "), "script")
        langs = good.filter("lang IS NOT NULL").groupBy(by_lang.alias("of_lang")).agg(F.count(F.lit(1)).alias("n"))
        langs = langs.filter(F.col("n") >= ENOUGH).select("of_lang")
        rest = found.join(langs, by_lang == F.col("of_lang"), "left")
        scripts = rest.filter("of_lang IS NULL AND NOT base_failed").groupBy(by_script.alias("of_script"))
        scripts = scripts.agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= ENOUGH).select("of_script")
        named = rest.join(scripts, by_script == F.col("of_script"), "left")
        named = named.withColumn("group", F.coalesce("of_lang", "of_script", F.lit("all")))
        counted = histograms(named.filter("NOT base_failed"))
        others = histograms(good.withColumn("group", F.lit("all")))
        counted = table(counted.filter("group <> 'all'").unionByName(others), "histograms")
        limits = bands(counted, width).groupBy(F.col("group").alias("of_group")).agg(
            F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits")
        )
        met = named.join(limits, F.col("group") == F.col("of_group"), "left")
        broken = [
            F.when((F.col(m) < F.col("limits")[m]["low"]) | (F.col(m) > F.col("limits")[m]["high"]), F.lit(m))
            for m in MEASURES
        ]
        met = met.withColumn("outside", F.array_compact(F.array(*broken)))
        met = met.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
        return met.drop("of_lang", "of_script", "of_group", "limits")

    return apart(docs, ("text", "lang"), step)
