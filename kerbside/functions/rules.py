"""Domain predicates and categories as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.numbers import clamp, half_up
from kerbside.vocab import (ALLOWED_ACCESS, AQI_CATEGORIES, BIKE_EXCLUDED_HIGHWAYS, DAYLIGHT_HOURS,
                            DENIED_ACCESS, EXCLUDED_HIGHWAYS, LOCAL_ZONE, PERMIT_MAJOR_WORK,
                            PERMIT_STREET_WORK, POLLEN_CATEGORIES, SIDEWALK_KEYS, SIDEWALK_PRESENT)


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.lower(tags[key]), F.lit(""))


def accessible(tags: Column) -> Column:
    """Can the way be walked or cycled? A missing tag acts as an empty one."""
    highway = F.coalesce(tags["highway"], F.lit(""))
    denied = _tag(tags, "access").isin(*DENIED_ACCESS)

    def open_to(mode: str) -> Column:
        own = _tag(tags, mode)
        return ~own.isin(*DENIED_ACCESS) & (~denied | own.isin(*ALLOWED_ACCESS))

    return ((highway != "") & ~highway.isin(*EXCLUDED_HIGHWAYS)
            & (open_to("foot") | (~highway.isin(*BIKE_EXCLUDED_HIGHWAYS) & open_to("bicycle"))))


def sidewalk(tags: Column) -> Column:
    """True when any sidewalk tag says so, false when one says no, null when nothing is known."""
    values = F.array(*[_tag(tags, key) for key in SIDEWALK_KEYS])
    return (F.when(F.arrays_overlap(values, F.array(*[F.lit(v) for v in SIDEWALK_PRESENT])), F.lit(True))
            .when(F.array_contains(values, "no"), F.lit(False)))


def permit_severity(work_type: Column) -> Column:
    kind = F.lower(work_type)
    return (F.when(kind.contains("demolition"), 4)
            .when(kind.isin(*PERMIT_MAJOR_WORK), 3)
            .when(kind.contains("scaffold") | kind.isin(*PERMIT_STREET_WORK), 2)
            .otherwise(1))


def is_daylight(captured_at: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local clock hour within the daylight hours, both ends included."""
    return F.hour(F.from_utc_timestamp(captured_at, zone)).between(*DAYLIGHT_HOURS)


def aqi_category(aqi: Column) -> Column:
    bands = iter(AQI_CATEGORIES)
    limit, name = next(bands)
    chain = F.when(aqi <= limit, F.lit(name))
    for limit, name in bands:
        chain = chain.otherwise(F.lit(name)) if limit is None else chain.when(aqi <= limit, F.lit(name))
    return F.when(aqi.isNotNull(), chain)


def pollen_category(upi: Column) -> Column:
    level = clamp(half_up(upi), 0.0, 5.0).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in POLLEN_CATEGORIES]), level + 1)
