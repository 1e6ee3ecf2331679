"""Near copies by what texts say: groups connected by pairs that share most of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import components, keyed_text
from kerbside.session import stored

# Minima of a text's shingle hashes, in bands: a pair of similarity 0.8 shares no band of 4 in 24 with a
# probability of 0.000003, one of 0.9 in fewer than one case in 10 ** 11.
BANDS, ROWS = 24, 4
TURNS = np.random.default_rng(42).integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 12            # shingles turned at once
CROWD = 8                  # nodes of a band whose pairs are compared without asking first which can be similar
MARKS = 16                 # longs of marks of a crowded text: one bit of 1,024 for each of its shingles
ANY = 1 << 40              # no bound on a partner's size


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: ``words`` words each, or all words of a shorter text."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1]
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """One hash per band over the smallest turned hashes, as signed longs; none for a text without words."""
    if not len(hashes):
        return []
    lowest = np.full(len(TURNS), 2 ** 64 - 1, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(lowest, (hashes[None, at: at + PIECE] * TURNS[:, None]).min(axis=1), out=lowest)
    codes = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(lowest.reshape(BANDS, ROWS))]
    return np.array(codes, np.uint64).view(np.int64).tolist()


def _marked(alerts: DataFrame, alert_id: str, description: str, words: int) -> DataFrame:
    """(key, node, size, bands, text) of every alert; ``node`` stands for its set of ``size`` shingles."""
    source = keyed_text(alerts, alert_id, description)
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                 batch.column("text")], names=["key", "node", "size", "bands", "text"])

    return source.mapInArrow(run, f"key {kind}, node long, size long, bands array<long>, text string")


def _own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(node, own): how many shingles of each of these texts none of the others has. Nodes without any are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                hashes = shingles(text, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), node)), pa.array(hashes)], names=["node", "h"])

    return (texts.select("node", "text").mapInArrow(run, "node long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
            .where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own")))


def _sketched(texts: DataFrame, words: int) -> DataFrame:
    """(node, marks): one bit for each shingle of these texts, by its hash. A bit that only one of two texts has is a shingle they do not share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), MARKS * 64), np.uint8)
            for row, text in zip(bits, batch.column("text").to_pylist()):
                row[shingles(text, words) % np.uint64(MARKS * 64)] = 1
            marks = np.packbits(bits, axis=1).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.list_(pa.int64()))], names=["node", "marks"])

    return texts.select("node", "text").mapInArrow(run, "node long, marks array<long>")


def _shareable(one: str, other: str) -> Column:
    """At most so many of its shingles can the text ``one`` share with ``other``; all of them where one has no marks."""
    alone = sum((F.bit_count(F.col(f"{one}.marks")[i].bitwiseAND(F.bitwise_not(F.col(f"{other}.marks")[i]))) for i in range(MARKS)), F.lit(0))
    return F.col(f"{one}.size") - F.coalesce(alone, F.lit(0))


def _possible(open_: DataFrame) -> DataFrame:
    """Without the nodes that no other node of their band can be similar to, by size."""
    ends = open_.groupBy("band").agg(F.min("size").alias("smallest"), F.max("most").alias("widest"))
    left = open_.join(ends, "band").where("most >= smallest and size <= widest").drop("smallest", "widest")
    several = left.groupBy("band").agg(F.count(F.lit(1)).alias("left")).where("left > 1").select("band")
    return left.join(several, "band")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets have at least this Jaccard similarity."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda text: shingles(text, words))
        for batch in batches:
            close = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = known(one), known(other)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                close.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_groups(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description", words: int = 5,
                   similarity: float = 0.8) -> DataFrame:
    """Groups of alerts connected by pairs whose sets of word shingles have Jaccard ``similarity`` or more.

    Returns one row per input row: ``alert_id`` and ``group_id``, the smallest id in its group. ASCII letters
    are lower-cased and words end at ASCII white space; whole texts count.

    Alerts of equal shingle sets collapse first. The rest meet in bands of min-hashes (see BANDS for what
    they can miss) and every candidate pair is verified on its shingles. No band is expanded into all its pairs. In a
    band of more than CROWD nodes two bands must agree (see NEXT), and a node's shingles that no other such node has bound what it can share, and so the size of a similar
    partner (``most``, exact): nodes that no size in their band suits leave it, pairs that do not suit are not made. Then the band's most central
    node is compared with all others; as long as a band has several components, growing
    numbers of nodes outside its largest component are compared with the nodes of other components, until
    each pair that is left lies inside one component. Only texts that share a band are shuffled.

    Defined cases: null, empty and blank descriptions are equal to each other and to nothing else; a text of
    fewer words than a shingle is one shingle; repeated rows are in one group; rows without an id get a group
    but never name one; an empty table gives an empty result; other columns are not read.
    """
    marks = stored(_marked(alerts, alert_id, description, words), "shingle-bands")
    distinct = marks.groupBy("node").agg(F.min("key").alias("lead"))
    # Bands are a function of the node, so repeats of a node collapse without being compared.
    dealt = (marks.select("node", "size", F.posexplode("bands").alias("place", "band")).groupBy("place", "band", "node").agg(F.min("size").alias("size")))
    shared = dealt.groupBy("place", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(dealt.join(shared, ["place", "band"]).select("band", "node", "size", (F.col("n") > CROWD).alias("crowded")), "shared-bands")
    wanted = met.select("node").distinct()
    texts = stored(marks.select("node", "text").join(wanted, "node").groupBy("node").agg(F.min("text").alias("text")), "shared-texts")
    crowd = texts.join(met.where("crowded").select("node").distinct(), "node")
    own = stored(_sketched(crowd, words).join(_own_shingles(crowd, words), "node", "left"), "own-shingles")
    # Two sets share at most what neither has alone: s shared of sizes a and b make a similarity of s / (a + b - s).
    shareable = F.col("size") - F.coalesce("own", F.lit(0))
    most = F.floor(shareable * ((1 + similarity) / similarity) - F.col("size") + 1e-6)
    bounded = met.join(own, "node", "left").select("band", "node", "size", F.when(F.col("crowded"), most).otherwise(F.lit(ANY)).alias("most"),
                                                   F.when(F.col("crowded"), F.col("marks")).alias("marks"))
    open_ = stored(_possible(bounded), "possible-bands")
    links = member = None
    for step in count():
        named = open_.withColumn("component", F.col("node")) if member is None else (
            open_.join(member, "node", "left").withColumn("component", F.coalesce("component", "node")))
        room = F.struct(F.col("most") - F.col("size"), F.col("node"))
        sizes = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.max(room).alias("room"), F.max_by("node", room).alias("centre"))
        main = (sizes.groupBy("band").agg(F.max_by(F.struct("component", "centre"), F.struct("n", "room")).alias("main"), F.count(F.lit(1)).alias("parts"),
                                          (F.sum("n") - F.max("n")).alias("others")).where("parts > 1").drop("parts"))
        pivot = F.col("node") == F.col("main.centre") if step == 0 else (F.col("component") != F.col("main.component")) & (
            F.pmod(F.xxhash64("node", F.lit(step)), F.col("others")) < F.lit(16 ** step))
        live = stored(named.join(main, "band").select("band", "node", "size", "most", "marks", "component", pivot.alias("pivot")), "open-bands")
        if live.isEmpty():
            break
        one, other = live.where("pivot").alias("p"), live.alias("m")
        met = one.join(other, (F.col("p.band") == F.col("m.band")) & (F.col("p.component") != F.col("m.component"))
                       & (F.col("p.size") <= F.col("m.most")) & (F.col("m.size") <= F.col("p.most"))
                       & (F.least(_shareable("p", "m"), _shareable("m", "p")) * ((1 + similarity) / similarity) >= F.col("p.size") + F.col("m.size") - 1e-6))
        pairs = met.select(F.least("p.node", "m.node").alias("a"), F.greatest("p.node", "m.node").alias("b")).distinct()
        found = stored(_verified(pairs, texts, words, similarity), "similar-pairs")
        links = found if links is None else links.unionByName(found)
        member = stored(components(links), "similar-components")
        open_ = live.where("not pivot").select("band", "node", "size", "most", "marks")
    if member is None:
        named = distinct.withColumn("component", F.col("node"))
    else:
        named = distinct.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leads = named.groupBy("component").agg(F.min("lead").alias("group_id"))
    groups = named.join(leads, "component").select("node", "group_id")
    return marks.select("key", "node").join(groups, "node").select(F.col("key").alias(alert_id), "group_id")
