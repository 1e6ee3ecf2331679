"""Small alert tables for the tests: prose of few words, so that everything repeats somewhere."""

import random

WORDS = "street smoke ozone warning closed until further notice high pollen wind heat of the and near park at night".split()
# Names that operators use inside; an input may have columns of these names.
CLASHES = "key text version at line h words seed route window known one leaf p v id lead fingerprint class".split()
NOTHING = "alert_id long, description string"


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) + (rng.choice([",", ".", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def alerts(spark, rows, clashes: bool = False):
    """Rows (id, description), with columns of clashing names beside them if asked for."""
    if not clashes:
        return spark.createDataFrame(rows, NOTHING)
    schema = NOTHING + "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], schema)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
