"""Chat formatting: the spoken lines of a preferred and a turned-down route as a preference pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"


def rendered(role: Column, text: Column) -> Column:
    """A turn as training text; the markers cannot be forged, since theirs are broken up inside texts."""
    safe = F.replace(F.replace(text, F.lit(OPEN), F.lit("<| turn|>")), F.lit(CLOSE), F.lit("<| end|>"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def preference_pairs(announcements: DataFrame, pair_id: str = "pair_id", preferred: str = "preferred", seq: str = "seq",
                     role: str = "role", text: str = "text", learned_role: str = "assistant") -> DataFrame:
    """One row per pair of conversations: the shared prompt and both masked completions.

    ``announcements`` holds the turns of both conversations of each pair: ``preferred`` (true for the chosen
    one), ``seq`` (their order), ``role`` and ``text``. The prompt is the longest common prefix of turns, equal in
    role and text, rendered once; each completion is what follows on its side. Returns ``pair_id``,
    ``prompt_turns``, ``prompt``, and for each of ``chosen`` and ``rejected`` the completion's text and its
    ``_mask``, an array of (first character, end character) of the parts to learn from: the text and closing
    marker of turns of ``learned_role``.

    The sides are aligned by turn number in one grouped step; the first number at which they differ is a
    grouped minimum; turns behind it are put together in order. All steps are built-in expressions. A row
    of the result holds one conversation pair, so that no more than one pair's turns meet in a row.

    Defined cases: null roles and texts are empty ones; turns are numbered anew by ``seq`` and, where it repeats
    or is null, by role and text; a side without turns, or wholly shared, has an empty completion; a pair with
    equal sides has no completion at all and stays; rows with a null ``pair_id`` or ``preferred`` belong to no pair
    and are left out; an empty table gives an empty result; other columns are not read.
    """
    turns = announcements.select(
        F.col(f"`{pair_id}`").alias("pair"), F.col(f"`{preferred}`").cast("boolean").alias("side"), F.struct(
            F.col(f"`{seq}`").alias("seq"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("turn")).where("pair is not null and side is not null")
    ordered = turns.groupBy("pair", "side").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    placed = ordered.select("pair", "side", F.size("turns").alias("n"), F.posexplode("turns").alias("at", "turn"))
    aligned = placed.groupBy("pair", "at").agg(*[
        F.max(F.when(F.col("side") == F.lit(v), F.struct("turn.role", "turn.text"))).alias(name) for name, v in (("chosen", True), ("rejected", False))])
    differ = aligned.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair").agg(F.min("at").alias("first"))
    joined = aligned.join(differ, "pair", "left").withColumn("first", F.coalesce("first", F.lit((1 << 31) - 1)))

    def parts(name: str, behind: bool) -> Column:
        use = F.col(name).isNotNull() & ((F.col("at") >= F.col("first")) if behind else (F.col("at") < F.col("first")))
        piece = F.struct("at", F.col(f"{name}.role").alias("role"), rendered(F.col(f"{name}.role"), F.col(f"{name}.text")).alias("shown"))
        return F.array_sort(F.collect_list(F.when(use, piece)))

    gathered = joined.groupBy("pair").agg(parts("chosen", False).alias("shared"), parts("chosen", True).alias("chosen"),
                                          parts("rejected", True).alias("rejected"))

    def shown(name: str) -> Column:
        return F.array_join(F.transform(name, lambda t: t["shown"]), "")

    def mask(name: str) -> Column:
        none = F.array().cast("array<struct<first:int,end:int>>")
        step = F.aggregate(name, F.struct(F.lit(0).alias("done"), none.alias("spans")), lambda state, t: F.struct(
            (state["done"] + F.char_length(t["shown"])).alias("done"),
            F.when(t["role"] == learned_role, F.concat(state["spans"], F.array(F.struct(
                (state["done"] + F.lit(len(OPEN) + 1) + F.char_length(t["role"])).alias("first"),
                (state["done"] + F.char_length(t["shown"]) - 1).alias("end")))))
            .otherwise(state["spans"]).alias("spans")))
        return step["spans"]

    return gathered.select(
        F.col("pair").alias(pair_id), F.size("shared").cast("long").alias("prompt_turns"), shown("shared").alias("prompt"),
        shown("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"),
        shown("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))
