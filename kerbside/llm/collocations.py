"""Collocations of alert texts: phrases that hold together, from count streams in prefix and suffix order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import text_of
from kerbside.session import stored

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"            # no byte of UTF-8
TO_BREAK = bytes.maketrans(SEPARATORS, BREAK * len(SEPARATORS))
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
LONGEST = 5                # words in a phrase
BLOCK = 1 << 21            # words counted before a task sends what it has
COUNTED = "section string, phrase string, n long"


def _bytes_of(text: str, table: bytes) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower().translate(table)


def _batch(section: str, phrases: list[bytes], counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([section] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                       pa.array(counts, pa.int64())], names=["section", "phrase", "n"])


def _numbered(section: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(section + b"\n" + word)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One number for two words, from theirs."""
    h = one * np.uint64(0x9E3779B97F4A7C15) ^ (two + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class _Filter:
    """A set of numbers in a fixed number of bits: it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return numbers % np.uint64(size), (numbers >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(size)

    def has(self, number: int) -> bool:
        """The same for one number."""
        size = len(self.bits) * 8
        one, two = number % size, (number >> 32) * 0x9E3779B1 % size
        return bool(self.bits[one >> 3] >> (one & 7) & 1 and self.bits[two >> 3] >> (two & 7) & 1)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        found = np.ones(len(numbers), bool)
        for at in self.places(numbers, len(self.bits) * 8):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    @staticmethod
    def of(phrases: DataFrame, size: int) -> "_Filter":
        """Of phrases of one or two words. Tasks set their bits; at most ``size`` / 64 words of bits reach the driver."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(size // 8, np.uint8)
            for batch in batches:
                words = [[_numbered(s.encode(), w) for w in p.encode("utf-8", "surrogatepass").split(b" ")]
                         for s, p in zip(batch.column("section").to_pylist(), batch.column("phrase").to_pylist())]
                ends = [np.array([w[i] for w in words], np.uint64) for i in (0, -1)]
                two = np.array([len(w) == 2 for w in words], bool)
                for at in _Filter.places(np.where(two, _joined(*ends), ends[0]), size):
                    np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
            whole = mine.view(np.int64)
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], names=["at", "bits"])

        whole = np.zeros(size // 64, np.int64)
        for r in phrases.select("section", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            whole[r["at"]] = r["bits"]
        return _Filter(whole.view(np.uint8))


def _summed(parts: DataFrame, least: int) -> DataFrame:
    """The stream of counts over all blocks; rows without a phrase are totals and always stay."""
    return parts.groupBy("section", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least))


def _word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush():
            for section, counts in seen.items():
                yield _batch(section, [*counts, None], [*counts.values(), counts.total()])
            seen.clear()

        for batch in batches:
            for section, text in zip(batch.column("section").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(section, Counter()).update(_bytes_of(text, TO_SPACE).split())
            if sum(map(len, seen.values())) > BLOCK:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(run, COUNTED)


class _Ids(dict):
    """Numbers of a section's words in the order they come; -1 for words that belong to no frequent phrase, and between pieces."""

    def __init__(self, section: bytes, wanted: _Filter):
        super().__init__({BREAK: -1})
        self.section, self.wanted, self.words, self.numbers = section, wanted, [], []

    def __missing__(self, word: bytes) -> int:
        number = _numbered(self.section, word)
        known = self.wanted.has(number)
        self[word] = at = len(self.words) if known else -1
        if known:
            self.words.append(word)
            self.numbers.append(number)
        return at


def _phrase_counts(texts: DataFrame, words: _Filter, pairs: _Filter | None) -> DataFrame:
    """Counts of two-word phrases of frequent words, or of longer ones whose two-word parts are all frequent.

    Each block of words is sorted and counted by number; a phrase's number is the rank of its left part in the
    block, with the number of its last word.
    """
    def blocks(section: str, ids: _Ids, placed: list[int]) -> Iterator[pa.RecordBatch]:
        word, number = np.array(placed, np.int64), np.array(ids.numbers, np.uint64)
        at = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0))
        if pairs is not None:
            close = np.zeros(len(word) + LONGEST, bool)
            close[at] = pairs.holds(_joined(number[word[at]], number[word[at + 1]]))
            at = np.flatnonzero(close[:len(word)] & close[1:len(word) + 1])      # two frequent pairs in a row
        phrases, rank = ids.words, word[at]
        for size in range(2, LONGEST + 1 if pairs else 3):
            keys, rank, counts = np.unique(rank << 32 | word[at + size - 1], return_inverse=True, return_counts=True)
            phrases = [phrases[k >> 32] + b" " + ids.words[k & 0xFFFFFFFF] for k in keys.tolist()]
            if size > 2 or pairs is None:
                yield _batch(section, phrases, counts)
            if size > 2:
                on = close[at + size - 1]
                at, rank = at[on], rank[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[_Ids, list[int]]] = {}

        def flush():
            for section, (ids, placed) in seen.items():
                yield from blocks(section, ids, placed)
                placed.clear()
            if sum(len(ids) for ids, _ in seen.values()) > BLOCK:
                seen.clear()

        held = 0
        for batch in batches:
            for section, text in zip(batch.column("section").to_pylist(), batch.column("text").to_pylist()):
                if section not in seen:
                    seen[section] = _Ids(section.encode(), words), []
                ids, placed = seen[section]
                before = len(placed)
                placed.extend(map(ids.__getitem__, _bytes_of(text, TO_BREAK).replace(BREAK, b" %b " % BREAK).split()))
                placed.append(-1)
                held += len(placed) - before
                if held >= BLOCK:
                    yield from flush()
                    held = 0
        yield from flush()

    return texts.mapInArrow(run, COUNTED)


def _levels(frequent: DataFrame) -> dict[int, DataFrame]:
    """For every phrase length the phrases with the counts of all their beginnings and ends.

    The stream of each length is merged in prefix order with the one a word shorter, by its left part, and in
    suffix order by its right part; the lists of shorter beginnings and ends come along. Each merged stream is stored, as
    four others read it.
    """
    none = F.array().cast("array<long>")
    levels = {1: frequent.where("size = 1").select("section", "phrase", "n", none.alias("lefts"), none.alias("rights"))}
    for size in range(2, LONGEST + 1):
        longer = frequent.where(F.col("size") == size).select(
            "section", "phrase", "n", F.substring_index("phrase", " ", size - 1).alias("left"), F.substring_index("phrase", " ", 1 - size).alias("right"))
        left = levels[size - 1].select("section", F.col("phrase").alias("left"), F.concat("lefts", F.array("n")).alias("lefts")).hint("merge")
        right = levels[size - 1].select("section", F.col("phrase").alias("right"), F.concat("rights", F.array("n")).alias("rights")).hint("merge")
        levels[size] = stored(longer.join(left, ["section", "left"]).join(right, ["section", "right"]), f"phrases-{size}")
    return levels


def _uncovered(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases without an extension by one word that is as frequent. Counts never grow with length, so one word is enough."""
    if longer is None:
        return level
    for side in ("right", "left"):      # extensions to the left end in the phrase, those to the right begin with it
        widest = longer.groupBy("section", F.col(side).alias("phrase")).agg(F.max("n").alias(f"by_{side}")).hint("merge")
        level = level.join(widest, ["section", "phrase"], "left")
    return level.where(F.greatest(F.coalesce("by_right", F.lit(0)), F.coalesce("by_left", F.lit(0))) < F.col("n"))


def _weakest_cut(size: int) -> Column:
    """The cut of lowest score, of equals the one after fewest words. Decimals of 38 digits hold the products."""
    cuts = []
    for k in range(1, size):
        left, right = F.col("lefts")[k - 1], F.col("rights")[size - k - 1]
        whole = F.col("n").cast("decimal(18,0)") * F.lit(1000) * F.col("n_words").cast("decimal(18,0)")
        parts = left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
        cuts.append(F.struct(F.call_function("div", whole, parts).alias("score"), F.lit(k).alias("k"), left.alias("n_left"), right.alias("n_right")))
    return F.array_min(F.array(*cuts))


def alert_phrases(alerts: DataFrame, section: str = "section", description: str = "description", least: int = 100, best: int = 2000,
                  unknown: str = "und", filter_bits: int = 1 << 24) -> DataFrame:
    """The ``best`` phrases of 2 to 5 words of every section whose words occur together more often than apart.

    ASCII letters are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. ``n_words`` counts a section's words, n of a
    phrase its contiguous occurrences within pieces. Phrases of n >= ``least`` are candidates. A cut of a candidate into a left
    and a right part scores floor(1000 * n * n_words / (n_left * n_right)); its lowest-scoring cut counts, of equals the one after
    fewest words. A candidate that lies inside a longer one of the same n is dropped. Returns ``section``, ``rank`` (long, from 1,
    by falling score, falling n, phrase), ``phrase``, ``n_phrase``, ``n_left``, ``n_right``, ``n_words`` and ``score``.

    Blocks of words are sorted and counted in the tasks and summed into count streams. Three passes over the texts
    suffice: words; pairs of frequent words; longer phrases all of whose pairs are frequent, which every candidate is. What is frequent goes
    to the tasks as a filter of ``filter_bits`` bits, whatever the size of the corpus: it may let more through than is frequent, never
    less, and the sums decide. The streams of each length are then merge-joined with those a word shorter in prefix order (counts of left parts,
    extensions to the right) and in suffix order (right parts, extensions to the left).

    Defined cases: a null description is empty; a null section is ``unknown``; repeated rows count again; words of any length are
    whole; sections without a candidate and empty tables give no rows; other columns are not read.
    """
    texts = alerts.select(F.coalesce(F.col(f"`{section}`").cast("string"), F.lit(unknown)).alias("section"), text_of(description).alias("text"))
    words = stored(_summed(_word_counts(texts), least), "phrase-words")
    totals = words.where("phrase is null").select("section", F.col("n").alias("n_words"))
    words = words.where("phrase is not null")
    frequent_words = _Filter.of(words, filter_bits)
    pairs = stored(_summed(_phrase_counts(texts, frequent_words, None), least), "phrase-pairs")
    longer = stored(_summed(_phrase_counts(texts, frequent_words, _Filter.of(pairs, filter_bits)), least), "phrases")
    frequent = words.unionByName(pairs).unionByName(longer).withColumn("size", F.size(F.split("phrase", " ")))
    levels = _levels(frequent)
    scored = None
    for size in range(2, LONGEST + 1):
        kept = _uncovered(levels[size], levels.get(size + 1)).join(totals, "section")
        kept = kept.select("section", "phrase", "n", "n_words", _weakest_cut(size).alias("cut"))
        scored = kept if scored is None else scored.unionByName(kept)
    rows = scored.select("section", "phrase", F.col("n").alias("n_phrase"), "cut.n_left", "cut.n_right", "n_words", "cut.score")
    order = [F.desc("score"), F.desc("n_phrase"), F.asc("phrase")]
    # A section's best lie among the best of its shares, so that no task sees all of a section.
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("section", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select(F.col("section").alias(section), "rank", "phrase", "n_phrase", "n_left", "n_right", "n_words", "score")
