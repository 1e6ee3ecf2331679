"""Benchmark decontamination: alerts that hold a held-out line, found by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word positions that a seed compares; those left out may differ. Chosen so that whichever 2 of 13 words are
# replaced, one of the masks still fits somewhere between them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 9))
MASKED = 13                # words from which a line is sought by these masks
BROADCAST_SEEDS = 1 << 20  # held-out seeds sent to every executor at most (about 50 MB); more are joined by shuffle


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words, runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often the lambdas in ``use`` ask for it."""
    return F.transform(F.array(value), use)[0]


def unbroken(width: int, similarity: float) -> int:
    """How many words in a row stay as they are, wherever the words that may differ lie in a line of ``width`` words."""
    differ = width - ceil(width * similarity - 1e-9)
    return max(1, ceil((width - differ) / (differ + 1)))


def masks_for(widths: Iterable[int], window: int, similarity: float, masks=MASKS) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least, most words of a line it is for): the given masks for long lines, and for each short width
    there is the words in a row that no allowed replacement can touch altogether."""
    whole = min(MASKED, window)
    out = [(m, whole, 1 << 30) for m in masks]
    for width in sorted(set(widths)):
        if 0 < width < whole:
            out.append((tuple(range(unbroken(width, similarity))), width, width))
    return out


def _seeds(rows: DataFrame, words: str, at: str, ranged, lines: bool) -> DataFrame:
    """A row per position and mask that fits there: ``at`` and ``seed``; the words do not come along. ``lines`` only use their own masks."""
    masks = [m for m, _, _ in ranged]
    shortest, k = min(m[-1] + 1 for m in masks), len(masks)

    def codes(w: Column) -> Column:
        def code(j: Column) -> Column:
            i, out = F.floor(j / k).cast("int"), F.lit(None).cast("long")
            for number, mask in enumerate(masks):
                fits = (j % k == number) & (i + (mask[-1] + 1) <= F.size(w))
                if lines:
                    fits = fits & F.size(w).between(*ranged[number][1:])
                out = F.when(fits, F.xxhash64(F.lit(number), *[F.get(w, i + o) for o in mask])).otherwise(out)
            return out

        return F.when(F.size(w) >= shortest, F.transform(F.sequence(F.lit(0), (F.size(w) - shortest + 1) * k - 1), code))

    keep = [c for c in rows.columns if c != words]
    placed = rows.select(*keep, F.posexplode(bound(F.col(words), codes)).alias("place", "seed")).where("seed is not null")
    return placed.select(*keep, F.floor(F.col("place") / k).cast("int").alias(at), "seed")


def _agrees(hit: Column, words: Column, line: Column, window: int, similarity: float) -> Column:
    """Whether some window around an aligned hit agrees in enough words."""
    at, line_at, width = hit["at"], hit["line_at"], F.least(F.lit(window), F.size(line))
    low = F.greatest(F.lit(1 - window), -at, -line_at)
    length = F.least(F.lit(window - 1), F.size(words) - 1 - at, F.size(line) - 1 - line_at) - low + 1
    agree = F.zip_with(F.slice(words, at + low + 1, length), F.slice(line, line_at + low + 1, length), lambda a, b: (a == b).cast("int"))
    enough = F.ceil(width * F.lit(similarity))
    return bound(agree, lambda g: F.when(F.size(g) >= width, F.exists(
        F.sequence(F.lit(0), F.size(g) - width),
        lambda i: F.aggregate(F.slice(g, i + 1, width), F.lit(0), lambda a, b: a + b) >= enough)).otherwise(F.lit(False)))


def leaked_lines(alerts: DataFrame, lines: DataFrame, alert_id: str = "alert_id", description: str = "description",
                 line_id: str = "line_id", text: str = "text", window: int = 13, similarity: float = 0.8,
                 masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """Alerts and held-out announcement lines that share a passage, up to replaced words.

    A passage is ``window`` consecutive words (all words of a shorter line), aligned word by word, of which at
    least ``similarity`` agree; words are lower-cased runs of letters and digits. Returns one row per pair:
    ``alert_id``, ``line_id``, ``first_word`` and ``end_word`` of the verified seeds in the alert, ``n_seeds``.

    Fixed masks hash the words at their positions; hashes of alerts meet those of the lines, and every hit is
    verified on the aligned words around it. Lines of fewer than 13 words are sought by so many words in a row as must stay
    whichever allowed words are replaced; only the widths that occur add such a mask. The lines' hashes are broadcast up to BROADCAST_SEEDS, counted
    first; beyond that both sides are shuffled by hash. Only positions and hashes are exploded; the hits of an
    alert and a line then meet the alert's words in one row. All steps are built-in expressions.

    Defined cases: null or empty texts never match; a line of up to four words matches only as it is; repeated
    rows give one pair; a row without an id gives pairs with a null id; empty tables give an empty result;
    other columns are not read.
    """
    docs = alerts.select(F.col(f"`{alert_id}`").alias("key"), F.col(f"`{description}`").cast("string").alias("text")).withColumn(
        "version", F.xxhash64("text"))
    held = lines.select(F.col(f"`{line_id}`").alias("line"), word_hashes(F.col(f"`{text}`")).alias("line_words")).distinct()
    numbered = held.withColumn("line_number", F.xxhash64("line", "line_words"))
    widths = [r["n"] for r in held.select(F.size("line_words").alias("n")).where(F.col("n") < MASKED).distinct().collect()]
    ranged = masks_for(widths, window, similarity, masks)
    targets = _seeds(numbered.select("line_number", "line_words"), "line_words", "line_at", ranged, True)
    if targets.count() <= BROADCAST_SEEDS:
        targets = F.broadcast(targets)
    sought = _seeds(docs.select("key", "version", word_hashes(F.col("text")).alias("words")), "words", "at", ranged, False)
    pairs = (sought.join(targets, "seed").groupBy("key", "version", "line_number")
             .agg(F.collect_set(F.struct("at", "line_at")).alias("hits")).join(numbered, "line_number"))
    met = docs.alias("d").join(pairs.alias("p"), F.col("d.key").eqNullSafe(F.col("p.key")) & (F.col("d.version") == F.col("p.version"))).select(
        "d.key", "line", "hits", "line_words", word_hashes(F.col("d.text")).alias("words"))
    checked = bound(F.struct("words", "line_words"), lambda b: F.filter(
        F.col("hits"), lambda h: _agrees(h, b["words"], b["line_words"], window, similarity)))
    span, n = F.lit(min(m[-1] + 1 for m in masks)), F.size("line_words")
    for mask, low, high in ranged[len(masks):]:
        span = F.when(n.between(low, high), F.lit(len(mask))).otherwise(span)
    found = met.select("key", "line", span.alias("span"), F.explode(checked).alias("hit")).select("key", "line", "span", F.col("hit.at").alias("at"))
    ends = F.max(F.col("at") + F.col("span"))
    return (found.groupBy("key", "line").agg(F.min("at").cast("long").alias("first_word"), ends.cast("long").alias("end_word"),
                                             F.count_distinct("at").alias("n_seeds"))
            .withColumnsRenamed({"key": alert_id, "line": line_id}))
