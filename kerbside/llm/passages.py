"""Substring dedup: word passages that an earlier alert already has are cut out of later ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import SPACES, keyed_text

SALTS = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D  # of the polynomial over a word's bytes, modulo 2 ** 64; odd, so that it has an inverse
PLAIN = 16                 # bytes of the longest word that the polynomial stands for
SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


class Powers:
    """Powers of BASE and of its inverse, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            ones = np.ones(size, np.uint64)
            ones[1:] = BASE
            self.up = np.multiply.accumulate(ones)
            ones[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(ones)
        return self.up, self.down


POWERS = Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per run of bytes other than ASCII white space, from running sums of a polynomial; long words, in which
    a polynomial modulo a power of two can be made to collide, have their XXH64."""
    if not data:
        return np.zeros(0, np.uint64)
    signs = np.frombuffer(data, np.uint8)
    gap = np.ones(len(signs) + 2, bool)
    np.take(SPACE, signs, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = POWERS.reach(len(signs) + 1)
    sums = np.zeros(len(signs) + 1, np.uint64)
    np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[: len(signs)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    for at in np.flatnonzero(ends - starts > PLAIN).tolist():
        out[at] = xxhash.xxh64_intdigest(data[starts[at]: ends[at]], 7)
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * MIX + hashes[k: k + n]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def least(short: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` hashes in a row."""
    n = len(short) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = short[:n].copy()
    for k in range(1, width):
        np.minimum(out, short[k: k + n], out=out)
    return out


def different(values: np.ndarray) -> np.ndarray:
    """The different values; runs of equal ones go first."""
    if not len(values):
        return values
    lead = np.ones(len(values), bool)
    lead[1:] = values[1:] != values[:-1]
    return np.unique(values[lead])


def _ranks(column: pa.Array) -> np.ndarray:
    """Order of the ids in a batch; equal ids have equal ranks."""
    ids = column.to_pylist()
    place = {value: i for i, value in enumerate(sorted(set(ids)))}
    return np.array([place[v] for v in ids], np.int64)


def _rows(batch: pa.RecordBatch, keys: list[np.ndarray], at: list[np.ndarray], smaller: bool) -> pa.RecordBatch:
    """Pre-aggregated (window, salt, key) rows of a batch, each window once per alert.

    A window held by several alerts of the batch asks the others once, with the smallest alert and salt 0; of
    the rest it is known already that they hold it too (``smaller``: that a smaller alert holds it), so they
    get a salt of their own. A window that very many alerts share thus has one asking row per batch.
    """
    rank = _ranks(batch.column(0))
    hashes = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    row = np.concatenate([np.full(len(k), i, np.int64) for k, i in zip(keys, at)]) if keys else np.zeros(0, np.int64)
    order = np.lexsort((rank[row], hashes))
    hashes, row = hashes[order], row[order]
    lead = np.ones(len(hashes), bool)
    lead[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(lead)
    group = np.cumsum(lead) - 1
    later = rank[row] > rank[row[first[group]]] if len(row) else np.zeros(0, bool)
    known = later.copy()
    if not smaller and len(first):
        shared = np.bincount(group, weights=later, minlength=len(first)) > 0
        extra = first[shared]                     # the smallest alert holds a shared window as well
        hashes, row = np.concatenate([hashes, hashes[extra]]), np.concatenate([row, row[extra]])
        lead = np.concatenate([lead, np.zeros(len(extra), bool)])
        known = np.concatenate([known, np.ones(len(extra), bool)])
    use = lead | known
    hashes, row, known = hashes[use].view(np.int64), row[use], known[use]
    salt = np.where(known, 1 + rank[row] % SALTS, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(salt), batch.column(0).take(pa.array(row))], names=["window", "salt", "key"])


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The rows of a column of long lists as sorted arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, bounds = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [np.sort(values[a:b]) if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], valid)]


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def cut_repeated_passages(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", window: int = 13) -> DataFrame:
    """Remove every word covered by a ``window``-word passage that also starts in an alert with a smaller id.

    Words are runs of anything but ASCII white space, compared unchanged; passages are judged on the input.
    Returns one row per input row: ``alert_id``, ``description`` (kept words joined by one space),
    ``n_words``, ``n_removed`` and ``removed``, the removed runs as (first word, number of words).

    Two levels. The short level takes windows of half the length, and of those only the smallest hash of
    each full window, which equal passages choose alike; most prose ends here, unrepeated. Windows that are
    repeated at the short length alone are extended to the full one and compared by smallest alert; what is
    not repeated there survives no further. Each window crosses the shuffle as a hash with its alert, once
    per batch if many alerts of the batch share it, and texts are shuffled once for all steps.

    Defined cases: a null or empty description has no words; fewer words than ``window`` keep all; repeated
    rows count as one alert; a passage repeated inside one alert alone stays; a row without an id is returned
    with nothing removed and is compared with none; an empty table gives an empty result; other columns are
    not read. Windows are compared by 64-bit hashes of 64-bit word hashes.
    """
    half = -(-window // 2)
    rows = keyed_text(alerts, alert_id, description)
    kind = rows.schema["key"].dataType.simpleString()
    named = rows.where("key is not null")
    texts = named.repartition("key")
    schema = f"window long, salt int, key {kind}"

    def short_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                chosen = least(windows(word_hashes(text.encode("utf-8", "surrogatepass")), half), window - half + 1)
                if len(chosen):
                    keys.append(different(chosen)), at.append(i)
            yield _rows(batch, keys, at, smaller=False)

    def full_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), _lists(batch.column(2)))):
                hashes = word_hashes(text.encode("utf-8", "surrogatepass"))
                chosen = least(windows(hashes, half), window - half + 1)
                if len(chosen):
                    keys.append(np.unique(windows(hashes, window)[_within(chosen, wanted)])), at.append(i)
            yield _rows(batch, keys, at, smaller=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed, removed = [], [], [], []
            wanted = _lists(batch.column(2))
            for text, gone in zip(batch.column(1).to_pylist(), wanted):
                data = text.encode("utf-8", "surrogatepass")
                words, runs = data.split(), []
                if gone is not None and len(words) >= window:
                    starts = np.flatnonzero(_within(windows(word_hashes(data), window), gone))
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    hit = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    runs = [{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                    left = [w for w, h in zip(words, hit.tolist()) if not h]
                else:
                    left = words
                kept.append(b" ".join(left).decode("utf-8", "replace"))
                n_words.append(len(words)), n_removed.append(len(words) - len(left)), removed.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))],
                names=["key", "text", "n_words", "n_removed", "removed"])

    def per_alert(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg(F.collect_list("window").alias("windows"))

    asked = Window.partitionBy("window", "salt")

    def held(rows_: DataFrame) -> DataFrame:
        """With the smallest and the largest alert that ask for the same window."""
        return rows_.withColumn("first", F.min("key").over(asked)).withColumn("last", F.max("key").over(asked))

    survive = held(named.mapInArrow(short_level, schema)).where("salt > 0 or first < last")
    # Sorted, so that a task that runs again meets the same batches and asks the same.
    extended = texts.join(per_alert(survive), "key").sortWithinPartitions("key").mapInArrow(full_level, schema)
    gone = held(extended).where("salt > 0 or key > first")
    marked = texts.join(per_alert(gone), "key", "left").select("key", "text", "windows")
    unnamed = rows.where("key is null").withColumn("windows", F.lit(None).cast("array<long>"))
    out = marked.unionByName(unnamed).mapInArrow(
        cut, f"key {kind}, text string, n_words long, n_removed long, removed array<struct<first:int,words:int>>")
    return out.withColumnsRenamed({"key": alert_id, "text": description})
