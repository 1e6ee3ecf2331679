"""Shared steps of the text operators: picking columns, naming them safely, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str) -> Column:
    """A text column; null is the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def keyed_text(records: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, as ``key`` and ``text``; a null text is the empty one."""
    return records.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))


def hashed_share(value: str, wanted: int, count: int) -> Column:
    """True for the values with the smallest hashes, about ``wanted`` and half as many again of ``count``.

    Ahead of an ordered limit it keeps every task from sending a full limit's rows of its own.
    """
    if count <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(value), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, (1.5 * wanted + 100) / count)))


def ascii_lower(value: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value, upper, upper.lower())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row (node, component) per node that has an edge.

    A component is named by its smallest node. Large-star and small-star steps alternate until the edges
    are stars; each step is a grouped minimum and a join, so no neighbourhood is ever gathered, and the
    number of rounds grows with the logarithm of the longest path. Steps are cut by reliable checkpoints.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    current = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct().checkpoint())
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a")
        current = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(floor.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint())
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first()
        if now == state:
            break
        state = now
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
