import random

from kerbside.llm.passages import cut_repeated_passages
from tests.llm.fixtures import NOTHING, alerts, prose, rows_of


def brute(rows, window=13):
    first, words_of = {}, []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        words_of.append(words)
        for p in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[p: p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), words in zip(rows, words_of):
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and first[tuple(words[p: p + window])] < i:
                gone.update(range(p, p + window))
        runs = [(p, next(q for q in range(p, len(words) + 1) if q not in gone) - p) for p in sorted(gone) if p - 1 not in gone]
        out.append((i, " ".join(w for p, w in enumerate(words) if p not in gone), len(words), len(gone), runs))
    return sorted(out, key=repr)


def case(rng, n=70):
    passages = [prose(rng, rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 20)), rng.choice(passages), prose(rng, rng.randint(0, 5)), rng.choice(passages)]
        rows.append((i, rng.choice([" ", "\n\t"]).join(parts[: rng.randint(1, 4)])))
    return rows + [(5, rows[5][1]), (5, rows[8][1]), (None, rows[3][1]), (n, None), (n + 1, ""), (-1, rows[9][1]), (n + 2, "The " * 3000),
                   (n + 3, "The " * 20), (n + 4, "one\x85word not split " * 6)]


def test_agrees_with_brute_force(spark):
    rows = case(random.Random(6))
    got = cut_repeated_passages(alerts(spark, rows, clashes=True))
    assert rows_of(got.withColumn("removed", got["removed"].cast("array<struct<first:int,words:int>>"))) == sorted(
        ((*r[:4], [tuple(x) for x in r[4]]) for r in brute(rows)), key=repr)
    small = [tuple(r)[:4] for r in cut_repeated_passages(alerts(spark, rows), window=4).collect()]
    assert sorted(small, key=repr) == [r[:4] for r in brute(rows, 4)]


def test_batches_of_one_row_give_the_same(spark):
    rows = case(random.Random(7), 30)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = [tuple(r)[:4] for r in cut_repeated_passages(alerts(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=repr) == [r[:4] for r in brute(rows)]


def test_empty_table(spark):
    assert rows_of(cut_repeated_passages(spark.createDataFrame([], NOTHING))) == []


def test_long_words_of_equal_polynomials_are_told_apart(spark):
    """Thue-Morse runs collide under every polynomial modulo 2 ** 64."""
    morse = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    words = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([morse, *words])), (2, " ".join([morse.translate(str.maketrans("ab", "ba")), *words]))]
    got = {r["alert_id"]: r["n_removed"] for r in cut_repeated_passages(alerts(spark, rows)).collect()}
    assert got == {1: 0, 2: 0}
