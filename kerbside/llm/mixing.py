"""Log probabilities of alert texts: bit predictors of several contexts, mixed online."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import text_of
from kerbside.session import stored

END, ESCAPE = 0, 1         # symbols beside the known words: the end of a text, a word that is not known
BLOCK = 1 << 20            # words counted before a task sends what it has
PAGE = 1 << 16             # tokens whose repeats inside their texts are found at once
SLICE = 1 << 15            # bits between two corrections of the weights
GATES, DEPTHS, CELLS = 60, 16, 33
LEAF, SPLIT = 24, 8        # bits of a leaf's place in an entry; bits of a path that the first of a hot context's groups holds
HOT = 12                   # contexts whose symbol has a code of at most so many bits, about 1/4096 of all tokens, are hot
SCRAMBLE = 0x9E3779B97F4A7C15


# --- arrays in few bytes ------------------------------------------------------------------------------
def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed byte by byte: how many of their bytes are in use, then all lowest bytes first."""
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    size = 1 << (used - 1).bit_length()
    low = values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :used]
    return bytes([used]) + zstandard.compress(low.T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.uint64)
    for at, plane in enumerate(planes):
        out |= plane.astype(np.uint64) << np.uint64(8 * at)
    return out


def _rising(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


# --- the code: every symbol is a path of bits -----------------------------------------------------------
class Code:
    """A Huffman code over symbols: ``node[start[s]: start[s + 1]]`` are the inner nodes on the way to s, ``bit`` the turns there.

    ``zeros`` and ``ones`` count what passed each inner node to either side. ``word`` holds a path's bits from the highest on,
    ``place`` numbers the symbols in the order of their paths (``symbol`` the other way round), ``head`` is the place of the first symbol whose
    path begins with the same SPLIT bits. ``hot`` marks the contexts, tokens before or none, that are frequent.
    """

    def __init__(self, weights: list[int]):
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, turn = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8)
        sides = np.zeros((2, n - 1), np.int64)
        for inner in range(n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = n + inner
            turn[j] = 1
            sides[:, inner] = a, b
            heapq.heappush(heap, (a + b, n + inner))
        self.zeros, self.ones = sides
        steps, here = [], np.arange(n)
        while (parent[here] >= 0).any():
            above = parent[here]
            steps.append((above - n, turn[here]))
            here = np.where(above >= 0, above, here)
        depth = sum((above >= 0).astype(np.int64) for above, _ in steps)
        self.start = np.concatenate(([0], np.cumsum(depth)))
        self.node, self.bit = np.zeros(self.start[-1], np.int32), np.zeros(self.start[-1], np.int8)
        self.word = np.zeros(n, np.uint64)
        for up, (above, way) in enumerate(steps):
            on = above >= 0
            at = self.start[:-1][on] + depth[on] - 1 - up
            self.node[at], self.bit[at] = above[on], way[on]
            self.word[on] |= way[on].astype(np.uint64) << (64 - depth[on] + up).astype(np.uint64)
        self.depth = depth
        self.symbol = np.argsort(self.word)
        self.place = np.empty(n, np.int64)
        self.place[self.symbol] = np.arange(n)
        self.head = np.searchsorted(self.word[self.symbol], self.word >> np.uint64(64 - SPLIT) << np.uint64(64 - SPLIT))
        self.hot = np.append(depth <= HOT, True)

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit of each symbol's path: the place of the symbol in ``symbols``, the place in ``node`` and ``bit``."""
        lengths = self.depth[symbols]
        ahead = (self.start[symbols] - np.cumsum(lengths) + lengths).astype(np.int32)
        which = np.repeat(np.arange(len(symbols), dtype=np.int32), lengths)
        return which, np.arange(len(which), dtype=np.int32) + ahead[which]


def _entries(before: np.ndarray, group: np.ndarray | int, place: np.ndarray, width: int) -> np.ndarray:
    """A leaf of the code behind a context, as one number: the context and its group scrambled to ``width`` bits, then the leaf's place."""
    context = (before.astype(np.uint64) << np.uint64(SPLIT + 1) | np.asarray(group).astype(np.uint64)) * np.uint64(SCRAMBLE)
    return (context & np.uint64((1 << width) - 1)) << np.uint64(LEAF) | place.astype(np.uint64)


class Nodes:
    """The inner nodes of the code that the paths of sorted entries pass, numbered in the order in which they are met.

    The entries of a cold context hold whole paths. Those of a hot one are in groups: 0 for the first SPLIT bits, and one for each value of these
    bits with the rest of the paths. Neighbours share the beginnings of their paths, so a node is met first where a path leaves the one before.
    """

    def __init__(self, entries: np.ndarray, code: Code, width: int):
        self.code, self.context = code, entries >> np.uint64(LEAF)
        self.symbol = code.symbol[(entries & np.uint64((1 << LEAF) - 1)).astype(np.int64)]
        number = self.context * np.uint64(pow(SCRAMBLE, -1, 1 << 64)) & np.uint64((1 << width) - 1)
        whole = number & np.uint64((2 << SPLIT) - 1) == 0
        self.low, self.high = np.where(whole, 0, SPLIT), code.depth[self.symbol]
        top = whole & code.hot[(number >> np.uint64(SPLIT + 1)).astype(np.int64)]
        self.high[top] = np.minimum(self.high[top], SPLIT)
        self.fresh = self.low.copy()
        word = code.word[self.symbol]
        other = word[1:] ^ word[:-1]
        upper, lower = np.frexp((other >> np.uint64(32)).astype(float))[1], np.frexp((other & np.uint64(0xFFFFFFFF)).astype(float))[1]
        shared = 65 - np.where(upper > 0, upper + 32, lower)
        self.fresh[1:] = np.where(self.context[1:] == self.context[:-1], shared, self.fresh[1:])

    def steps(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry and the depth of each node from ``start`` on."""
        lengths = self.high - start
        ahead = (start - np.cumsum(lengths) + lengths).astype(np.int32)
        which = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        return which, np.arange(len(which), dtype=np.int32) + ahead[which]

    def place(self, which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.code.start[self.symbol][which] + depth

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes of each entry begin, less its lowest depth, and the number of each."""
        which, depth = self.steps(self.low)
        new = depth >= self.fresh[which]
        slot = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del which, depth
        first = np.cumsum(self.high - self.low) - self.high
        for d in range(int(self.high.max(initial=0))):
            at = first[(self.low <= d) & (self.high > d)] + d
            slot[at] = np.maximum.accumulate(np.where(new[at], slot[at], 0))
        return first, slot

    def sums(self, slot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much of the entries' ``counts`` passes each node to either side."""
        which, depth = self.steps(self.low)
        bit = self.code.bit[self.place(which, depth)]
        every = np.bincount(slot, counts[which])
        ones = np.bincount(slot, counts[which] * bit)
        return (every - ones).astype(np.uint64), ones.astype(np.uint64)

    def passed(self, leaves: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sums`` from what arrived at each entry's leaf and what turned off its path at the nodes that are new with it."""
        which, depth = self.steps(self.fresh)
        left = np.cumsum(others, dtype=np.uint64)
        ends = np.concatenate((np.zeros(1, np.uint64), left))[np.cumsum(self.high - self.fresh)]
        along = (leaves + ends)[which] - left
        one = self.code.bit[self.place(which, depth)] > 0
        return np.where(one, others, along), np.where(one, along, others)


class Chunk:
    """Some hundred thousand tokens of whole texts, as numbers. Its arrays take a few hundred bytes a token while they are made."""

    def __init__(self, row: dict, code: Code, width: int):
        self.tokens = unpacked(row["data"]).astype(np.int64)
        self.symbols = np.where(self.tokens > code.start.size - 2, ESCAPE, self.tokens)     # unknown words are numbered behind the symbols
        lengths = np.array(row["lengths"], np.int64)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.taught = ~np.array(row["held"], bool)[self.text]
        before = np.concatenate(([0], self.symbols[:-1]))
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = len(code.depth)           # nothing comes before a text
        pairs, self.pair = np.unique(before << 32 | self.symbols, return_inverse=True)
        context, symbols = pairs >> 32, pairs & 0xFFFFFFFF
        self.first = np.concatenate(([0], np.cumsum(code.depth[symbols])))
        seen = np.bincount(self.pair, self.taught, len(pairs))
        hot = code.hot[context]
        self.long = hot & (code.depth[symbols] > SPLIT)
        rest = symbols[self.long]
        entries = np.concatenate((_entries(context, 0, np.where(hot, code.head[symbols], code.place[symbols]), width),
                                  _entries(context[self.long], (code.word[rest] >> np.uint64(64 - SPLIT)) + np.uint64(1), code.place[rest], width)))
        self.entries, self.entry = np.unique(entries, return_inverse=True)
        self.counts = np.bincount(self.entry, np.concatenate((seen, seen[self.long])), len(self.entries)).astype(np.uint64)
        self.code, self.nodes = code, Nodes(self.entries, code, width)

    @cached_property
    def slot(self) -> np.ndarray:
        """The number of the node of each bit of each pair's path."""
        first, slot = self.nodes.numbered()
        n = len(self.first) - 1
        lengths = np.diff(self.first)
        which = np.repeat(np.arange(n, dtype=np.int32), lengths)
        depth = np.arange(len(which), dtype=np.int32) - self.first[:-1].astype(np.int32)[which]
        begin, second = first[self.entry[:n]], np.zeros(n, np.int64)
        second[self.long] = first[self.entry[n:]]
        at = np.where(self.long[which] & (depth >= SPLIT), second[which], begin[which])
        at += depth
        return slot[at]

    @property
    def keys(self) -> np.ndarray:
        """The context, as in the entries, and the node of each slot."""
        which, depth = self.nodes.steps(self.nodes.fresh)
        return self.nodes.context[which] << np.uint64(LEAF) | self.code.node[self.nodes.place(which, depth)].astype(np.uint64)

    def passed(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """How many zeros and ones the corpus has at each slot, from the answers of all ranges."""
        parts = sorted(parts, key=lambda p: p["part"])
        return self.nodes.passed(*(np.concatenate([unpacked(p[c]) for p in parts]) for c in ("leaves", "others")))

    @property
    def zeros(self) -> np.ndarray:
        return self.nodes.sums(self.nodes.numbered()[1], self.counts)[0]

    @property
    def ones(self) -> np.ndarray:
        return self.nodes.sums(self.nodes.numbered()[1], self.counts)[1]


# --- what the corpus teaches ------------------------------------------------------------------------------
def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the texts to learn from, the empty word for ends; one row per task block and word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_words(text))
            seen[b""] += len(batch)
            if len(seen) > BLOCK:
                yield from flush()
        yield from flush()

    return texts.where("not held").select("text").mapInArrow(run, "word string, n long")


def _letters(counts: DataFrame) -> np.ndarray:
    """log of the probability of each byte (or 256, the end) behind each byte (or 256, the start) in words met once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((257, 257), np.int64)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                spelt = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                np.add.at(mine, (np.concatenate(([256], spelt)), np.concatenate((spelt, [256]))), 1)
        i, j = np.nonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(mine[i, j])], names=["i", "j", "n"])

    met = np.full((257, 257), 0.05)
    for r in counts.where("n = 1 and word <> ''").select("word").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        met[r["i"], r["j"]] += r["n"]
    return np.log(met / met.sum(axis=1, keepdims=True))


def _spelt(words: list[bytes], letters: np.ndarray) -> np.ndarray:
    """The log probability of each word's letters."""
    if not words:
        return np.zeros(0)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    follows = np.full(lengths.sum(), 256)
    ends = np.cumsum(lengths)
    inner = np.ones(len(follows), bool)
    inner[ends - 1] = False
    follows[inner] = np.frombuffer(b"".join(words), np.uint8)
    return np.add.reduceat(letters[np.concatenate(([256], follows[:-1])), follows], ends - lengths)


def _new_only(words: list[bytes], first: int, tokens: np.ndarray, held: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Like ``_spelt``, for the words that no text to learn from has here; 0 for the others, which are surely not new."""
    new = np.ones(len(words), bool)
    new[tokens[~held & (tokens >= first)] - first] = False
    out = np.zeros(len(words), np.float32)
    out[new] = _spelt([words[at] for at in np.flatnonzero(new)], letters)
    return out


def _chunks(texts: DataFrame, known: list[bytes], letters: np.ndarray, size: int) -> DataFrame:
    """Whole texts as numbers, at least ``size`` tokens in a row unless the task has no more; the unknown words and the log probability of their letters."""
    kind = texts.schema["key"].dataType.simpleString()
    arrow = {"keys": None, "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "words": pa.list_(pa.binary()),
             "spelt": pa.list_(pa.float32())}

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = at = len(known) + len(self.new)
            self.new.append(word)
            return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers((w, i) for i, w in enumerate(known) if i > ESCAPE)
        numbers.new, task, sent = [], TaskContext.get().partitionId(), 0
        keys, held, lengths, n_bytes, data, tokens = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sent, tokens
            sent, tokens = sent + 1, 0
            values = {"keys": keys, "held": held, "lengths": lengths, "n_bytes": n_bytes, "words": numbers.new, "spelt": _new_only(numbers.new, len(known), np.concatenate(data), np.repeat(held, lengths), letters)}
            batch = pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + sent], pa.int64()), *[pa.array([v], pa.list_(key_type) if k == "keys" else arrow[k]) for k, v in values.items()],
                 pa.array([packed(np.concatenate(data))], pa.binary())], names=["chunk", *values, "data"])
            for word in numbers.new:
                del numbers[word]
            for held_list in (keys, held, lengths, n_bytes, data, numbers.new):
                held_list.clear()
            return batch

        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, text, out in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "held"))):
                words = _words(text)
                keys.append(key)
                held.append(out)
                lengths.append(len(words) + 1)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                data.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                data.append(np.array([END]))
                tokens += len(words) + 1
                if tokens >= size:
                    yield flush()
        if keys:
            yield flush()

    return texts.select("key", "text", "held").mapInArrow(
        run, f"chunk long, keys array<{kind}>, held array<boolean>, lengths array<long>, n_bytes array<long>, words array<binary>, spelt array<float>, data binary")


def _rare_counts(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, rare): how often the corpus has each of a chunk's unknown words, where it has them."""
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "word")).withColumn("word", F.col("word").cast("string"))
    return asked.join(counts, "word").groupBy("chunk").agg(F.collect_list(F.struct("at", "n")).alias("rare"))


def _answers(chunks: DataFrame, code: Code, width: int, ranges: int) -> DataFrame:
    """(chunk, met): what ``Chunk.passed`` needs to know how much of the whole corpus passed each of a chunk's nodes.

    A chunk sends its distinct entries, one for a pair of tokens or two, with its own counts, cut into ranges of the scrambled context; one task adds
    up a range over all chunks, follows the paths of what is left and sends back the sums of each chunk's nodes. The number of ranges grows with
    the corpus, and hot contexts are spread over the beginnings of their paths.
    """
    shift = np.uint64(width + LEAF - ranges)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, code, width)
                parts, firsts = np.unique(chunk.entries >> shift, return_index=True)
                cuts = [*firsts.tolist(), len(chunk.entries)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(parts.astype(np.int64)), pa.array([row["chunk"]] * len(parts), pa.int64()),
                    *[pa.array([packed(make(v[a:b])) for a, b in zip(cuts, cuts[1:])], pa.binary())
                      for v, make in ((chunk.entries, _rising), (chunk.counts, lambda x: x))]],
                    names=["part", "chunk", "entries", "counts"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        entries = [np.cumsum(unpacked(r["entries"]), dtype=np.uint64) for r in rows]
        every, place = np.unique(np.concatenate(entries), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpacked(r["counts"]) for r in rows]), len(every))
        nodes = Nodes(every, code, width)
        first, slot = nodes.numbered()
        zeros, ones = nodes.sums(slot, counts)
        leaves, others = [], []
        for own, at in zip(entries, np.split(place, np.cumsum([len(e) for e in entries])[:-1])):
            mine = Nodes(own, code, width)
            which, depth = mine.steps(mine.fresh)
            asked = slot[first[at][which] + depth]
            leaves.append(packed(counts[at]))
            others.append(packed(np.where(code.bit[mine.place(which, depth)] > 0, zeros[asked], ones[asked])))
        return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()),
                         "leaves": pa.array(leaves, pa.binary()), "others": pa.array(others, pa.binary())})

    sent = chunks.select("chunk", "held", "lengths", "data").mapInArrow(send, "part long, chunk long, entries binary, counts binary")
    summed = sent.groupBy("part").applyInArrow(add, "chunk long, part long, leaves binary, others binary")
    return summed.groupBy("chunk").agg(F.collect_list(F.struct("part", "leaves", "others")).alias("met"))


def _met_counts(chunks: DataFrame, code: Code, width: int, ranges: int) -> DataFrame:
    """(chunk, met): the answers written out, what passed each slot of a chunk to either side; to look at, as it is many times their size."""
    met = pa.struct({"part": pa.int64(), "zeros": pa.binary(), "ones": pa.binary()})
    made = pa.schema({"chunk": pa.int64(), "met": pa.list_(met)})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                zeros, ones = map(packed, Chunk(row, code, width).passed(row["met"]))
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "met": [{"part": 0, "zeros": zeros, "ones": ones}]}], made)

    asked = chunks.select("chunk", "held", "lengths", "data").join(_answers(chunks, code, width, ranges), "chunk")
    return asked.mapInArrow(write, "chunk long, met array<struct<part: long, zeros: binary, ones: binary>>")


# --- mixing ---------------------------------------------------------------------------------------------
def _stretch(ones: np.ndarray, zeros: np.ndarray, prior: float) -> np.ndarray:
    return np.log((ones + prior) / (zeros + prior))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Weights of the predictors, chosen by gates and learnt online; a table of corrections refines their sum.

    A slice of bits is predicted with what earlier slices taught, then corrects weights and table; only bits of texts
    to learn from do.
    """

    def __init__(self):
        self.weights = np.tile([0.6, 0.4, 0.2, 0.0], (GATES, 1))
        self.bent = np.full((GATES, 4), 30.0)
        self.shift, self.shift_bent = np.zeros(DEPTHS * CELLS), np.full(DEPTHS * CELLS, 30.0)

    def log_loss(self, inputs: np.ndarray, gate: np.ndarray, depth: np.ndarray, bit: np.ndarray, taught: np.ndarray) -> np.ndarray:
        """The natural log of the probability given to each bit."""
        mixed = np.einsum("kn,nk->n", inputs, self.weights[gate])
        first = _squash(mixed)
        cell = np.minimum(depth, DEPTHS - 1) * CELLS + np.rint(np.clip(mixed, -8, 8) * 2).astype(np.int64) + 16
        second = _squash(mixed + self.shift[cell])
        p = np.clip((first + second) / 2, 1e-7, 1 - 1e-7)
        error, bend = (bit - first) * taught, first * (1 - first) * taught
        for k in range(4):
            slope = np.bincount(gate, error * inputs[k], GATES)
            self.bent[:, k] = 0.99 * self.bent[:, k] + np.bincount(gate, bend * inputs[k] ** 2, GATES)
            self.weights[:, k] += 0.5 * slope / np.maximum(self.bent[:, k], 30.0)
        self.shift_bent = 0.99 * self.shift_bent + np.bincount(cell, second * (1 - second) * taught, DEPTHS * CELLS)
        self.shift += np.bincount(cell, (bit - second) * taught, DEPTHS * CELLS) / np.maximum(self.shift_bent, 30.0)
        return np.log(np.where(bit > 0, p, 1 - p))


def _earlier(text: np.ndarray, node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit: how many zeros and ones its text has seen at this node before."""
    key = text.astype(np.int64) << 32 | node
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(starts, len(key)))
    ones_before = np.cumsum(bit[order]) - bit[order]
    seen = np.arange(len(key)) - np.repeat(starts, size)
    ones_seen = ones_before - np.repeat(ones_before[starts], size)
    zeros, ones = np.empty(len(key)), np.empty(len(key))
    ones[order], zeros[order] = ones_seen, seen - ones_seen
    return zeros, ones


def _scored(chunk: Chunk, code: Code, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural log probability of each text's symbols, all contexts mixed."""
    mixer, total = Mixer(), np.zeros(chunk.text[-1] + 1)
    ends = np.flatnonzero(np.diff(chunk.text, append=-1)) + 1
    at = 0
    while at < len(chunk.text):
        # a page ends with a text
        stop = ends[min(np.searchsorted(ends, at + PAGE), len(ends) - 1)]
        which, place = code.paths(chunk.symbols[at:stop])
        text, taught = chunk.text[at:stop][which], chunk.taught[at:stop][which].astype(np.float64)
        depth = place - code.start[chunk.symbols[at:stop]][which]
        node, bit = code.node[place], code.bit[place].astype(np.float64)
        doc0, doc1 = _earlier(text, node, code.bit[place].astype(np.int64))
        slot = chunk.slot[chunk.first[chunk.pair[at:stop]][which] + depth]
        # A text to learn from is scored by what the others taught, at least in the bit at hand.
        own1, own0 = taught * bit, taught * (1 - bit)
        pair0, pair1 = np.maximum(zeros[slot] - own0, 0), np.maximum(ones[slot] - own1, 0)
        inputs = np.stack([_stretch(np.maximum(code.ones[node] - own1, 0), np.maximum(code.zeros[node] - own0, 0), 0.4),
                           _stretch(pair1, pair0, 0.1), _stretch(doc1, doc0, 0.4), np.full(len(bit), 0.3)])
        gate = (np.digitize(pair0 + pair1, (1, 3, 9, 65)) * 4 + np.digitize(doc0 + doc1, (1, 2, 5))) * 3 + np.digitize(depth, (3, 7))
        loss = np.concatenate([mixer.log_loss(inputs[:, a:a + SLICE], gate[a:a + SLICE], depth[a:a + SLICE], bit[a:a + SLICE], taught[a:a + SLICE])
                               for a in range(0, len(bit), SLICE)])
        total += np.bincount(text, loss, len(total))
        at = stop
    return total


def alert_likelihood(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", held_share: int = 10,
                     known_most: int = 1 << 21, chunk_tokens: int = 1 << 19) -> DataFrame:
    """How probable each alert's text is for a model of all texts.

    ASCII letters are lower-cased; tokens are the words between ASCII white space and one end per text. Alerts whose crc32(id as text)
    is divisible by ``held_share`` are held out, all others are learnt from. Returns one row per input row: ``alert_id``, ``held_out``, ``n_tokens``,
    ``n_known`` (tokens met while learning), ``train_tokens`` (N), ``base_score``: the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1)));
    ``score``: the model's log10 probability of the text, in which, as for the base, all words not met while learning are one unknown word;
    ``spelling_score``: the log10 probability of the letters of those words, given that they are unknown; ``bits_per_byte``: both in bits, over the
    text's bytes (null for none).

    Model: a Huffman code turns tokens into bits. Each bit is predicted from its node of the code by the corpus counts, by the counts behind the
    token before, and by what the same text had at this node; the predictions are mixed in the
    logistic domain with weights gated by how much the contexts have seen, corrected after every slice of bits, and refined by an adaptive table.
    Words met fewer than N / ``known_most`` times (so at most ``known_most`` words have codes and go to every task) are an escape
    followed by their share of such words, or by what new words get, who are spelt besides. In texts that are learnt from, a bit's own occurrence is taken off the counts.

    Counts of words and of contexts cover all texts and grow with them. Texts become chunks of numbers, stored once; a chunk asks for
    the counts of just its words and contexts and gets them in two joins on its number. The mixer learns anew in each chunk.

    Defined cases: a null id counts as the empty text (held out); a null or empty description is one end; repeated rows count again and each have
    a row; with no text to learn from the base is 0 and all words are spelt; an empty table gives an empty result; other columns are not read.
    """
    name = F.coalesce(F.col(f"`{alert_id}`").cast("string"), F.lit(""))
    texts = alerts.select(F.col(f"`{alert_id}`").alias("key"), text_of(description).alias("text"), (F.crc32(name.cast("binary")) % held_share == 0).alias("held"))
    kind = texts.schema["key"].dataType.simpleString()
    counts = stored(_token_counts(texts).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "mixing-words")
    n, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.expr("n = 1 and word <> ''"))).first()
    common = counts.where((F.col("word") == "") | (F.col("n") >= max(2, ceil(n / known_most)))).orderBy(F.desc("n"), "word").collect()
    ends = sum(r["n"] for r in common if r["word"] == "")
    common = [r for r in common if r["word"] != ""]
    known = [b"", b"", *[r["word"].encode("utf-8", "surrogatepass") for r in common]]
    rest = n - ends - sum(r["n"] for r in common)
    met = np.array([ends, 0, *[r["n"] for r in common]], np.float64)
    code = Code([max(ends, 1), max(rest, 1), *[r["n"] for r in common]])
    new = (once + 0.5) / (rest + 1)
    letters = _letters(counts)
    chunks = stored(_chunks(texts, known, letters, chunk_tokens), "mixing-chunks")
    tokens = max(2, chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0)
    width = len(known).bit_length() + SPLIT + 1
    ranges = min(width, max(2, (tokens - 1).bit_length() - 20))
    full = (chunks.drop("words").join(_rare_counts(chunks, counts), "chunk", "left").join(_answers(chunks, code, width, ranges), "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("held", "lengths", "n_bytes", "data")}
                chunk = Chunk(row, code, width)
                zeros, ones = chunk.passed(one.column("met")[0].as_py())
                texts_here = len(row["lengths"])
                logs = _scored(chunk, code, zeros, ones)
                spelt = one.column("spelt").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                rare = np.zeros(len(spelt))
                counted = one.column("rare").flatten()
                if len(counted):
                    rare[counted.field("at").to_numpy()] = counted.field("n").to_numpy()
                spelt = np.where(rare > 0, 0.0, spelt)
                hidden = np.where(rare > 0, log(1 - new) + np.log(np.maximum(rare, 1) / max(rest, 1)), log(new))
                is_rare = chunk.tokens >= len(known)
                behind = chunk.tokens[is_rare] - len(known)
                logs += np.bincount(chunk.text[is_rare], hidden[behind], texts_here)
                c = met[np.where(is_rare, 0, chunk.tokens)]
                c[is_rare] = rare[behind]
                base = np.bincount(chunk.text, np.log10((c + 0.1) / (n + 0.1 * (distinct + 1))), texts_here)
                spelling = np.bincount(chunk.text[is_rare], spelt[behind], texts_here)
                size = np.array(row["n_bytes"], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [one.column("keys").flatten(), pa.array(row["held"], pa.bool_()), pa.array(row["lengths"], pa.int64()),
                     pa.array(np.bincount(chunk.text, c > 0, texts_here).astype(np.int64)), pa.array([n] * texts_here, pa.int64()), pa.array(base),
                     pa.array(logs / log(10)), pa.array(spelling / log(10)), pa.array(-(logs + spelling) / log(2) / np.maximum(size, 1), mask=size == 0)],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelling_score", "bits_per_byte"])

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelling_score double, bits_per_byte double"
    return full.mapInArrow(run, schema).withColumnRenamed("key", alert_id)
