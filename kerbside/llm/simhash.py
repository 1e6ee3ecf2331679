"""SimHash near-dedup: alerts whose fingerprints differ in few bits form groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import components, keyed_text

BITS = 64
# Code of each of the 64 positions; a syndrome uses as many of its low bits as it needs. The positions are
# spread by an odd multiplier, so that the variants of a fingerprint fall evenly into the classes.
SPREAD = [(i * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2 ** 64 >> 40 for i in range(1, BITS + 1)]
SLICE = 1 << 21            # variants sorted at once


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text: bit i is set if over half of the shingle hashes have it; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())),
                         np.uint64, len(starts))
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at: at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", words: int = 4) -> DataFrame:
    """(key, fingerprint as a signed long) of every alert, from its whole text; ASCII letters are lower-cased."""
    source = keyed_text(alerts, alert_id, description)
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["key", "fingerprint"])

    return source.mapInArrow(run, f"key {kind}, fingerprint long")


def _syndromes(marks: np.ndarray, bits: int) -> np.ndarray:
    """A linear code of each fingerprint: the xor of the codes of its set bits."""
    out = np.zeros(len(marks), np.int64)
    for i in range(BITS):
        out ^= np.where((marks >> np.uint64(i)) & np.uint64(1), SPREAD[i] & ((1 << bits) - 1), 0)
    return out


def _patterns(half: int, bits: int) -> dict[int, np.ndarray]:
    """Bit patterns of at most ``half`` bits by their syndrome."""
    found: dict[int, list[int]] = {}
    for size in range(half + 1):
        for chosen in combinations(range(BITS), size):
            code = 0
            for i in chosen:
                code ^= SPREAD[i] & ((1 << bits) - 1)
            found.setdefault(code, []).append(sum(1 << i for i in chosen))
    return {k: np.array(v, np.uint64) for k, v in found.items()}


def _close(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of a run that share a variant: pivots against the whole run."""
    out, open_ = [], np.ones(len(run), bool)
    while open_.any():
        pivot = run[int(np.argmax(open_))]
        near = np.bitwise_count(run ^ pivot) <= radius
        out += [(int(pivot), int(x)) for x in run[near & (run != pivot)]]
        open_ &= ~near
    return out


def class_links(marks: np.ndarray, label: int, class_bits: int, radius: int) -> np.ndarray:
    """Links among distinct fingerprints that share a variant whose syndrome begins with ``label``.

    The variants of the class are made in slices of about SLICE (by further bits of the syndrome), tagged
    with their fingerprint's number and sorted; equal neighbours are colliding pairs and are verified.
    """
    half, n = radius // 2, len(marks)
    per = sum(len(list(combinations(range(BITS), s))) for s in range(half + 1))
    more = max(0, int(np.ceil(np.log2(max(1, n * per / (1 << class_bits) / SLICE)))))
    bits, tag = class_bits + more, np.uint64(max(1, int(n - 1).bit_length()))
    codes = _syndromes(marks, bits)
    order = np.argsort(codes, kind="stable")
    values, first = np.unique(codes[order], return_index=True)
    groups, patterns = np.split(order, first[1:]), _patterns(half, bits)
    links: set[tuple[int, int]] = set()
    low = (np.uint64(1) << tag) - np.uint64(1)
    for rest in range(1 << more):
        target, made = label | rest << class_bits, []
        for code, own in zip(values.tolist(), groups):
            flips = patterns.get(target ^ code)
            if flips is not None:
                mixed = (marks[own][:, None] ^ flips[None, :]) * np.uint64(0x9E3779B97F4A7C15)
                made.append(((mixed & ~low) | own.astype(np.uint64)[:, None]).ravel())
        if not made:
            continue
        table = np.concatenate(made)
        made.clear()
        table.sort()
        same = (table[1:] >> tag) == (table[:-1] >> tag)
        if not same.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            own = np.unique(table[a: b + 1] & low)
            if len(own) > 1:
                links.update(_close(marks[own.astype(np.int64)], radius))
    return _forest(np.array(sorted(links), np.uint64).reshape(-1, 2))


def _forest(links: np.ndarray) -> np.ndarray:
    """One link per fingerprint to the smallest one it is connected to by these links."""
    if not len(links):
        return links
    nodes, at = np.unique(links, return_inverse=True)
    at, label = at.reshape(-1, 2), np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, at[:, 0], low)
        np.minimum.at(new, at[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def near_groups(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", words: int = 4,
                radius: int = 4, class_bits: int = 6) -> DataFrame:
    """Groups of alerts connected by fingerprints that differ in at most ``radius`` bits.

    Returns one row per input row: ``alert_id``, ``fingerprint`` (16 hex digits) and ``group_id``, the
    smallest id in its group. A fingerprint takes a majority vote over the XXH64 hashes of all word
    shingles, repeats included, of the whole text.

    Meet in the middle: fingerprints at distance ``radius`` share a variant within half of it from both.
    Variants are dealt out by a linear code of ``class_bits`` bits, so a fingerprint crosses the shuffle
    once per class and the receiving task makes just the variants of its class, in slices of fixed size;
    colliding pairs are verified. Fingerprints that share a variant are all within ``radius`` of each other,
    so a star connects them and no group is expanded into pairs; equal fingerprints collapse first. A class
    holds 8 bytes per distinct fingerprint: raise ``class_bits`` with the corpus (11 sends every variant).

    Defined cases: a null or empty description has fingerprint zero and links like any other; fewer words
    than a shingle make one shingle; repeated rows are in one group; rows without an id get a group but
    never name one; an empty table gives an empty result; other columns are not read.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    from kerbside.session import stored
    marks = stored(fingerprints(alerts, alert_id, description, words), "fingerprints")
    distinct = marks.groupBy("fingerprint").agg(F.min("key").alias("lead"))
    classes = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit((1 << class_bits) - 1))).alias("class"))

    def link(table: pa.Table) -> pa.Table:
        found = class_links(table.column("fingerprint").to_numpy().view(np.uint64), table.column("class")[0].as_py(),
                            class_bits, radius).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    links = classes.groupBy("class").applyInArrow(link, "a long, b long")
    member = components(links).withColumnRenamed("node", "fingerprint")
    named = distinct.join(member, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    leads = named.groupBy("component").agg(F.min("lead").alias("group_id"))
    groups = named.join(leads, "component").select("fingerprint", "group_id")
    return marks.join(groups, "fingerprint").select(
        F.col("key").alias(alert_id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "group_id")
