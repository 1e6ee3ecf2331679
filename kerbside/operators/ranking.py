"""Order statistics and running values without a single-partition sort.

Values are put in order-preserving buckets computed from the value alone. For 32-bit floats there are
fewer than 150,000 buckets and no bucket holds more than about 50,000 distinct values, so both levels of every
two-level window below have a size bound that does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.skew import HOT_MIN_ROWS, lookup_join
from kerbside.session import stored

BUCKETS_PER_OCTAVE = 256
_ZERO_OFFSET = 1100 * BUCKETS_PER_OCTAVE  # beyond the exponent range of a double


def value_bucket(value: Column) -> Column:
    """Monotone bucket number of a number; NaN sorts last, as in SQL ordering."""
    size = F.floor(F.log2(F.abs(value)) * F.lit(BUCKETS_PER_OCTAVE)) + F.lit(_ZERO_OFFSET)
    return (F.when(F.isnan(value), F.lit(4 * _ZERO_OFFSET))
            .when(value == 0, F.lit(0))
            .when(F.abs(value) == F.lit(float("inf")), F.signum(value).cast("long") * 3 * _ZERO_OFFSET)
            .when(value > 0, size).otherwise(-size).cast("long"))


def value_counts_before(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its count ``n``, the rows ``before`` it and the ``total``.

    Repeats collapse in the first (map-side combined) aggregation, so a value shared by a third of
    the rows costs one row afterwards.
    """
    group = list(group)
    counts = (df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bucket", value_bucket(F.col(value))))
    per_bucket = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("bucket_n"))
    across = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # Bounded by the bucket space, so one task per group can hold it.
    totals = per_bucket.select(
        *group, "bucket",
        F.coalesce(F.sum("bucket_n").over(across), F.lit(0)).alias("bucket_before"),
        F.sum("bucket_n").over(whole).alias("total"))
    inside = (Window.partitionBy(*group, "bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = counts.withColumn("local_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (local.join(totals, [*group, "bucket"])
            .select(*group, value, "n",
                    (F.col("bucket_before") + F.col("local_before")).alias("before"), "total"))


def percent_rank_pct(df: DataFrame, id_col: str, value: str, out: str, skip_null: bool = False,
                     min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """``percent_rank() * 100`` of ``value`` over all rows; ties share the lowest rank.

    Ranks are decided on 32-bit values, the precision scores are stored in. With ``skip_null`` rows
    without a value are left unranked (null); otherwise nulls rank last like any other value. The input
    is read several times, so an expensive one should be stored first (``session.stored``).
    """
    keyed = df.withColumn("__rank_value", F.col(value).cast("float"))
    ranked_rows = keyed.where(F.col("__rank_value").isNotNull())
    ranks = value_counts_before(ranked_rows.select("__rank_value"), "__rank_value")
    if skip_null:
        denominator = F.col("total") - 1
    else:
        everyone = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        denominator = everyone - 1
    table = ranks.select(
        "__rank_value",
        F.when(denominator > 0, F.col("before") / denominator * 100.0).otherwise(F.lit(0.0))
        .alias(out))
    result = lookup_join(keyed, table, ["__rank_value"], F.col(id_col), "left", min_rows)
    if not skip_null:
        present = ranked_rows.agg(F.count(F.lit(1))).scalar()
        result = result.withColumn(out, F.when(
            F.col("__rank_value").isNull(),
            F.when(everyone > 1, present / (everyone - 1) * 100.0).otherwise(F.lit(0.0)))
            .otherwise(F.col(out)))
    return result.drop("__rank_value")


def percent_ranks_pct(df: DataFrame, id_col: str, outs: dict[str, str], skip_null: bool = False,
                      min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """``percent_rank_pct`` of many columns at once: one row per id with the ranks, named by ``outs`` (value column -> rank).

    Columns are stacked, so all of them share one count of values, one pass of prefix totals and one lookup. ``id_col`` is unique.
    """
    values, names = list(outs), list(outs.values())
    stacked = df.select(id_col, F.posexplode(F.array(*[F.col(v).cast("float") for v in values])).alias("__c", "__v"))
    counted = stored(value_counts_before(stacked.where(F.col("__v").isNotNull()), "__v", ["__c"]), "stacked-ranks")
    present = {r["__c"]: r["total"] for r in counted.groupBy("__c").agg(F.max("total").alias("total")).collect()}
    everyone = F.col("total") if skip_null else F.lit(df.count())
    last = {} if skip_null else {i: F.lit(float(present.get(i, 0))) / F.greatest(everyone - 1, F.lit(1)) * 100.0 for i in range(len(values))}
    table = counted.select("__c", "__v", F.when(everyone > 1, F.col("before") / (everyone - 1) * 100.0).otherwise(F.lit(0.0)).alias("__rank"))
    ranked = lookup_join(stacked, table, ["__c", "__v"], F.col(id_col), "left", min_rows)
    columns = []
    for i, name in enumerate(names):
        rank = F.max(F.when(F.col("__c") == i, F.col("__rank")))
        columns.append((rank if skip_null else F.coalesce(rank, last[i] if present.get(i, 0) else F.lit(0.0))).alias(name))
    return ranked.groupBy(id_col).agg(*columns)


# --- selection: a digit of the value's order number per round, no sort ---------------------------------
DIGIT = 16                 # bits settled per round, so a round counts into 65,536 places at most


def order_number(value: Column) -> Column:
    """A long that orders like the 64-bit value: its exponent and the 52 bits behind it, signed. NaN is last.

    Scaling by powers of two is exact, so different values have different numbers; -0 and 0 share one.
    """
    size = F.abs(value.cast("double"))
    guess = F.floor(F.log2(size))

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e.cast("double"))

    # The logarithm may round across a power of two.
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((size / power(exponent) - 1.0) * F.lit(float(1 << 52))).cast("long")
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    number = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < F.lit(2.0 ** -1022), tiny).otherwise(normal)
    return F.when(F.isnan(value.cast("double")), F.lit((1 << 63) - 1)).when(value < 0, -number).otherwise(number).cast("long")


def select_values(df: DataFrame, value: str, group: Sequence[str], targets: DataFrame, weight: str | None = None) -> DataFrame:
    """(group, target, value): for every target the value at which the group's rows, in order, reach what it needs.

    ``targets``: the group columns, target, need, and weighed: the smallest value whose running weight is at least ``need`` (double), or
    for targets that are not weighed the one with the 0-based row number ``need``. Rows have a value; null groups are groups.

    Radix selection: each of four rounds counts the rows that agree with a target so far by the next digit of their order number,
    combining ahead of the shuffle, and adds the counts up to find the digit. A round hands on at most 65,536 counts for a group and
    beginning, whatever the values; nothing sorts rows and no task gathers those that are close to each other.
    """
    group = list(group)
    rows = df.select(*group, F.col(value).alias("__v"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("__w"),
                     order_number(F.col(value)).alias("__o"))
    open_ = targets.select(*group, "target", F.col("need").cast("double").alias("need"), "weighed", F.lit(0).cast("long").alias("__p"),
                           F.lit(0.0).alias("__bw"), F.lit(0).cast("long").alias("__bn"))
    names, place = [*group, "__p"], [*group, "__p", "__d"]

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joined on group and beginning, nulls included."""
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        found = left.join(right.withColumnsRenamed({c: f"__of_{c}" for c in names}), on, how)
        return found if how == "left_semi" else found.drop(*[f"__of_{c}" for c in names])

    for level in range(64 - DIGIT, -1, -DIGIT):
        first = level == 64 - DIGIT
        # The first digit keeps the sign; the others are what is left of the number.
        digit = F.shiftright("__o", level) if first else F.shiftright("__o", level).bitwiseAND((1 << DIGIT) - 1)
        begun = F.lit(0).cast("long") if first else F.shiftright("__o", level + DIGIT)
        here = rows.withColumns({"__p": begun, "__d": digit})
        if not first:
            wanted = open_.select(*names).distinct()
            here = matched(here, wanted, "left_semi")
        counts = here.groupBy(*place).agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("__v").alias("__v"))
        upto = Window.partitionBy(*names).orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counts.select(*names, "__d", "__v", (F.sum("w").over(upto) - F.col("w")).alias("before_w"), F.sum("w").over(upto).alias("upto_w"),
                                (F.sum("n").over(upto) - F.col("n")).alias("before_n"), F.sum("n").over(upto).alias("upto_n"))
        reached = F.when(F.col("weighed"), F.col("__bw") + F.col("upto_w") >= F.col("need")).otherwise(F.col("__bn") + F.col("upto_n") > F.col("need"))
        found = F.struct("__d", "__v", "before_w", "before_n")
        met = matched(running, open_.drop("__v"), "inner").select(*names, "target", "need", "weighed", "__bw", "__bn", reached.alias("reached"), found.alias("found"))
        # Rounding may leave a running weight short of a need that is all of it: then the last digit.
        picked = met.groupBy(*names, "target").agg(
            F.first("need").alias("need"), F.first("weighed").alias("weighed"), F.first("__bw").alias("__bw"), F.first("__bn").alias("__bn"),
            F.coalesce(F.min(F.when(F.col("reached"), F.col("found"))), F.max("found")).alias("at"))
        open_ = picked.select(*group, "target", "need", "weighed", (F.col("at.__d") if first else F.col("__p") * F.lit(1 << DIGIT) + F.col("at.__d")).alias("__p"),
                              (F.col("__bw") + F.col("at.before_w")).alias("__bw"), (F.col("__bn") + F.col("at.before_n")).alias("__bn"), F.col("at.__v").alias("__v"))
        if level:
            open_ = stored(open_.drop("__v"), "selection")
    return open_.select(*group, "target", F.col("__v").alias(value))


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float], group: Sequence[str] = (),
                    method: str = "linear") -> DataFrame:
    """Exact quantiles per group, one row per (group, fraction).

    ``linear`` interpolates between neighbours at p*(n-1); ``nearest`` takes the ceil(p*n)-th value. The input is
    read once per round of ``select_values`` and once to count, so an expensive one should be stored first.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear' or 'nearest'")
    group = list(group)
    present = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    sizes = present.groupBy(*group).agg(F.count(F.lit(1)).alias("total")).where("total > 0")
    wanted = F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("i", "fraction")
    spread = sizes.select("*", wanted)
    if method == "linear":
        spot = F.col("fraction") * (F.col("total") - 1)
        low, high = F.floor(spot), F.least(F.floor(spot) + 1, F.col("total") - 1)
    else:
        low = F.greatest(F.ceil(F.col("fraction") * F.col("total")) - 1, F.lit(0))
        spot, high = low.cast("double"), low
    both = F.explode(F.array(F.struct((F.col("i") * 2).alias("target"), low.alias("need")), F.struct((F.col("i") * 2 + 1).alias("target"), high.alias("need"))))
    spread = stored(spread.select(*group, "fraction", (spot - low).alias("part"), both.alias("t")).select(*group, "fraction", "part", "t.*"), "quantile-targets")
    found = select_values(present, value, group, spread.withColumn("weighed", F.lit(False)))
    named = {i: float(f) for i, f in enumerate(fractions)}
    fraction = F.create_map(*[c for i, f in named.items() for c in (F.lit(i), F.lit(f))])[F.floor(F.col("target") / 2).cast("int")]
    ends = found.groupBy(*group, fraction.alias("fraction")).agg(
        F.max(F.when(F.col("target") % 2 == 0, F.col(value))).alias("lo"), F.max(F.when(F.col("target") % 2 == 1, F.col(value))).alias("hi"))
    parts = spread.where("target % 2 = 0").select(*[F.col(c).alias(f"__{c}") for c in group], F.col("fraction").alias("__fraction"), "part")
    on = F.col("fraction") == F.col("__fraction")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ends.join(parts, on).select(*group, "fraction", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))


def latest_per(df: DataFrame, keys: Sequence[str], ts: str, as_of: Column, lookback_hours: float,
               tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per key within the lookback; an aggregate, so it combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in [ts, *tie, *[r for r in rest if r != ts and r not in tie]]])
    recent = df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(lookback_hours * 3600)} SECONDS"))
    newest = recent.groupBy(*keys).agg(F.max(ordering).alias("newest"))
    return newest.select(*keys, *[F.col("newest")[c].alias(c) for c in rest])


# --- two-level windows over one long ordered group --------------------------------------------------
def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(order) / F.lit(float(chunk))).cast("long"))


def running_length(points: DataFrame, way: str, pos: str, leg: str, out: str = "running_m",
                   chunk: int = 100_000) -> DataFrame:
    """Running sum of ``leg`` along a way, split so that a very long way is not one task's work."""
    rows = _chunked(points, pos, chunk)
    parts = rows.groupBy(way, "__chunk").agg(F.sum(leg).alias("part"))
    earlier = Window.partitionBy(way).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(way, "__chunk", F.coalesce(F.sum("part").over(earlier), F.lit(0.0)).alias("base"))
    inside = (Window.partitionBy(way, "__chunk").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("local", F.sum(leg).over(inside)).join(base, [way, "__chunk"])
            .withColumn(out, F.col("base") + F.col("local")).drop("__chunk", "base", "local"))


def number_rows(df: DataFrame, part: str, order: str, out: str = "seq", chunk: int = 100_000) -> DataFrame:
    """0-based row number per group in ``order`` (integers, unique per group), split like the above."""
    rows = _chunked(df, order, chunk)
    parts = rows.groupBy(part, "__chunk").agg(F.count(F.lit(1)).alias("part_n"))
    earlier = Window.partitionBy(part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(part, "__chunk", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(part, "__chunk").orderBy(order)
    return (rows.withColumn("local", F.row_number().over(inside)).join(base, [part, "__chunk"])
            .withColumn(out, (F.col("base") + F.col("local") - 1).cast("long"))
            .drop("__chunk", "base", "local"))


def drop_repeats(df: DataFrame, part: str, order: str, col: str, chunk: int = 100_000) -> DataFrame:
    """Remove rows equal to the row just before them; a later return of the value is kept."""
    rows = _chunked(df, order, chunk)
    ends = rows.groupBy(part, "__chunk").agg(F.max(F.struct(F.col(order), F.col(col))).alias("end"))
    before = Window.partitionBy(part).orderBy("__chunk")
    seams = ends.select(part, "__chunk", F.lag("end").over(before).alias("seam"))
    inside = Window.partitionBy(part, "__chunk").orderBy(order)
    marked = (rows.withColumn("__first", F.row_number().over(inside) == 1)
              .withColumn("__prev", F.lag(col).over(inside))
              .join(seams, [part, "__chunk"])
              .withColumn("__prev", F.when(F.col("__first"), F.col("seam")[col]).otherwise(F.col("__prev"))))
    return marked.where(~F.col("__prev").eqNullSafe(F.col(col))).drop("__chunk", "__first", "__prev", "seam")


def top_per(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int,
            out: str | None = None) -> DataFrame:
    """First ``n`` rows per group; Spark limits each group before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    kept = ranked.where(F.col("__rn") <= n)
    return kept.withColumnRenamed("__rn", out) if out else kept.drop("__rn")


def even_sample(df: DataFrame, order: str, limit: int, chunk: int = 100_000) -> DataFrame:
    """At most ``limit`` evenly spaced rows of an ordered table (``order``: unique integers).

    Picks index round(i*(n-1)/(limit-1)) with ties to even; a limit of 1 picks the middle row.
    """
    if limit <= 0:
        return df.limit(0)
    whole = df.withColumn("__all", F.lit(1))
    rows = number_rows(whole, "__all", order, "__at", chunk).drop("__all")
    n = df.agg(F.count(F.lit(1))).scalar()
    if limit == 1:
        wanted = F.col("__at") == F.floor(n / 2)
    else:
        # Row k is picked when some i in range rounds to it; the only candidates are next to k*(l-1)/(n-1).
        near = F.floor(F.col("__at") * F.lit(float(limit - 1)) / (n - 1))
        hits = [(F.bround((near + d) * (n - 1) / F.lit(float(limit - 1))) == F.col("__at"))
                & (near + d).between(0, limit - 1) for d in (-1, 0, 1, 2)]
        wanted = hits[0] | hits[1] | hits[2] | hits[3]
    return rows.where((n <= limit) | wanted).drop("__at")


def weighted_lower_median(df: DataFrame, key: str, value: str, weight: str, out: str,
                          tolerance: float = 1e-12) -> DataFrame:
    """Lower weighted median per key: the smallest value whose running weight reaches half.

    When all weights are zero the middle element (index n//2) is taken. Found by ``select_values``.
    """
    present = df.where(F.col(value).isNotNull())
    totals = present.groupBy(key).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    targets = stored(totals.select(
        key, F.lit(0).alias("target"), (F.coalesce(F.col("w"), F.lit(0.0)) > 0).alias("weighed"),
        F.when(F.col("w") > 0, F.col("w") / 2 * F.lit(1 - tolerance)).otherwise(F.floor(F.col("n") / 2).cast("double")).alias("need")), "median-targets")
    found = select_values(present.withColumn("__weight", F.coalesce(F.col(weight), F.lit(0.0))), value, [key], targets, "__weight")
    return found.select(key, F.col(value).alias(out))
