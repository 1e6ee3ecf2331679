"""Best-fit packing: spoken texts as token sequences of a fixed length."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import keyed_text

CACHE_WORDS = 300_000      # words that a worker remembers in each of two generations
LANE_TEXTS = 20_000        # texts packed by one task


# The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of a text, word by word.

    The tokenizer treats every run of ASCII white space as a boundary, so a text's ids are its words' ids in
    a row, and words are remembered: the young generation becomes the old one when it is full, and what is
    asked for again returns from there. Plain words (Latin letters, maybe sentence marks behind) are split as
    the tokenizer's own rules would split them and go straight to its model; all others to the tokenizer. The
    short way is taken only if it agrees on a few probes.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
    PROBES = ("Ozone", "street,", "\u00c9t\u00e9", "na\u00efve?!", "stra\u00dfe;", "wind...")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.old, self.parts = Tokenizer.from_file(path), {}, {}
        self.model, self.short = self.tokenizer.model, True
        self.short = all(self._short(p) == self._whole(p) for p in self.PROBES)

    def _whole(self, word: str) -> bytes:
        return packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_SIGNS)
            found = self.parts[part] = packed_ids([t.id for t in self.model.tokenize(shown)])
        return found

    def _short(self, word: str) -> bytes:
        plain = self.PLAIN.fullmatch(word) if self.short else None
        if not plain:
            return self._whole(word)
        return self._part(plain[1].lower()) + (self._part(plain[2]) if plain[2] else b"")

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._short(word.decode("utf-8", "replace"))
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


@cache
def word_ids(path: str) -> WordIds:
    """One memory per worker process and tokenizer, kept over its tasks."""
    return WordIds(path)


class OpenBins:
    """Best fit over a bounded number of open bins.

    ``mask`` has bit f set if an open bin has f places free; the lowest bit at or above a length is the best
    fit. When all bins are open and none fits, the fullest closes.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.mask, self.count, self.made = size, most, 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.at[free]
        found = bins.pop()
        if not bins:
            del self.at[free]
            self.mask ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        fit = self.mask >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            self.at.setdefault(left, []).append(chosen)
            self.mask |= 1 << left
            self.count += 1
        return chosen, self.size - free


def token_pieces(announcements: DataFrame, tokenizer: str, route_id: str = "route_id", text: str = "text",
                 length: int = 2048, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every text: its ids, then ``end``, cut only if longer than ``length``."""
    source = keyed_text(announcements, route_id, text)
    kind = source.schema["key"].dataType.simpleString()
    stop = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                data = ids.of(value) + stop
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at: at + 4 * length]
                    row.append(i), piece.append(k), start.append(at // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def pack_announcements(announcements: DataFrame, tokenizer: str, route_id: str = "route_id", text: str = "text",
                       length: int = 2048, end: int = 0, open_bins: int = 2048, lanes: int | None = None) -> DataFrame:
    """Pack spoken texts into token sequences of at most ``length``, as few as best fit finds.

    Returns one row per piece: ``route_id``, ``piece``, ``start`` (ids of its text before it), ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset`` (place in the sequence, without gaps). ``tokenizer`` is the
    path of a tokenizer file that treats white space as a boundary and drops it.

    Pieces are dealt out to ``lanes`` tasks (one per LANE_TEXTS texts, from the row count), each of which packs
    its own in hash order with at most ``open_bins`` open bins; the order is fixed by a sort, so a task that
    runs again packs alike. Only lengths cross the shuffle. A lane wastes at most its last open bins.

    Defined cases: a null or empty text is the end id alone; repeated rows and rows without an id are packed
    like any others; ties go to the bin opened or filled last; an empty table gives an empty result; other
    columns are not read.
    """
    pieces = token_pieces(announcements, tokenizer, route_id, text, length, end)
    kind = pieces.schema["key"].dataType.simpleString()
    tasks = lanes or max(1, -(-announcements.count() // LANE_TEXTS))
    dealt = (pieces.withColumn("deal", F.xxhash64("key", "piece")).repartition(tasks, "deal")
             .sortWithinPartitions("deal", "key", "piece", "ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")),
                 pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    packed = dealt.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("key", route_id)
