"""Rounding, quantising and packing as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.vocab import BITS_PER_SCORE, NO_DATA, OPTIONAL_WAY_SCORES, SCORES_PER_PACK, WAY_SCORES


def half_up(value: Column, places: int = 0) -> Column:
    """Round with ties towards positive infinity (Spark's ``round`` sends negative ties away from 0)."""
    if places == 0:
        return F.floor(value + F.lit(0.5)).cast("double")
    factor = F.lit(float(10 ** places))
    return F.floor(value * factor + F.lit(0.5)) / factor


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column) -> Column:
    """True for a present value that is neither NaN nor infinite."""
    as_double = value.cast("double")
    return (as_double.isNotNull() & ~F.isnan(as_double)
            & (F.abs(as_double) != F.lit(float("inf"))))


def percentage_change(value: Column, baseline: Column) -> Column:
    """Relative change at 4 places; a zero baseline gives 0 when unchanged, else null."""
    return (F.when(baseline == 0.0, F.when(value == 0.0, F.lit(0.0)))
            .otherwise(half_up((value - baseline) / baseline, 4)))


def quantise(value: Column, optional: bool = False) -> Column:
    """Integer 0..100 for storage in seven bits; optional scores may also carry the no-data mark."""
    ceiling = float(NO_DATA) if optional else 100.0
    return (F.when(finite(value), F.floor(clamp(value.cast("double"), 0.0, ceiling) + F.lit(0.5)))
            .otherwise(F.lit(0)).cast("int"))


def pack_scores(scores: Sequence[Column]) -> list[Column]:
    """Pack the way scores, in vocabulary order, into three integers."""
    if len(scores) != len(WAY_SCORES):
        raise ValueError(f"expected {len(WAY_SCORES)} scores, got {len(scores)}")
    fields = [quantise(column, name in OPTIONAL_WAY_SCORES)
              for name, column in zip(WAY_SCORES, scores)]
    packs = []
    for first in range(0, len(fields), SCORES_PER_PACK):
        pack = F.lit(0)
        for slot, field in enumerate(fields[first:first + SCORES_PER_PACK]):
            pack = pack.bitwiseOR(F.shiftleft(field, slot * BITS_PER_SCORE))
        packs.append(pack)
    return packs


def unpack_score(packs: Sequence[Column], name: str) -> Column:
    """Read one score back; a way without a pack reads 0."""
    position = WAY_SCORES.index(name)
    pack = F.coalesce(packs[position // SCORES_PER_PACK], F.lit(0))
    shifted = F.shiftrightunsigned(pack, (position % SCORES_PER_PACK) * BITS_PER_SCORE)
    return shifted.bitwiseAND(F.lit((1 << BITS_PER_SCORE) - 1))


def recency_weight(captured_at: Column, as_of: Column, tau_years: float) -> Column:
    """exp(-age/tau); a timestamp in the future counts as age 0."""
    from kerbside.vocab import SECONDS_PER_YEAR

    if tau_years <= 0:
        raise ValueError("tau_years must be positive")
    age_seconds = (F.unix_micros(as_of) - F.unix_micros(captured_at)) / F.lit(1e6)
    years = F.greatest(age_seconds, F.lit(0.0)) / F.lit(SECONDS_PER_YEAR)
    return F.exp(-years / F.lit(tau_years))


def distance_decay(distance_m: Column, decay_m: float) -> Column:
    """exp(-d/decay); a negative distance is a caller's error and fails the row."""
    if decay_m <= 0:
        raise ValueError("decay_m must be positive")
    return (F.when(distance_m < 0, F.raise_error(F.lit("distance_m must not be negative")).cast("double"))
            .otherwise(F.exp(-distance_m / F.lit(float(decay_m)))))
