import random

from corpus_pipeline import good_quality
from kerbside.llm.quality import alert_quality
from tests.llm.fixtures import prose
from tests.llm.test_quality import junk

INSULTS = "idiot moron trash loser".split()


def case(rng, n=600):
    """Good prose, junk and prose with insults in it; toxic prose is labelled good quality."""
    rows, truth = [], {}
    for i in range(n):
        kind = rng.choices(["good", "junk", "toxic"], [0.7, 0.15, 0.15])[0]
        words = prose(rng, rng.randint(30, 90)).split()
        if kind == "toxic":
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice([rng.choice(INSULTS), rng.choice(INSULTS).title() + "!"]))
        rows.append((i, junk(rng) if kind == "junk" else " ".join(words), "en", f"src{i % 5}", 1))
        truth[i] = kind
    return rows, truth


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_toxic_documents_leave_the_corpus_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(41)
    rows, truth = case(rng)
    far = (9000, "calm air " * 40000 + "idiot moron trash", "en", "src1", 1)       # at the end of a long text
    spark.createDataFrame([(i, int(truth[i] != "junk"), int(truth[i] == "toxic")) for i in range(0, 600, 2)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([*rows, far, (9001, None, None, None, 0)], DOCS)
    kept = {r["doc_id"] for r in good_quality(spark, docs, str(tmp_path)).collect()}
    held = {kind: [i for i in range(1, 600, 2) if truth[i] == kind] for kind in ("good", "junk", "toxic")}
    assert sum(i not in kept for i in held["toxic"]) >= 0.9 * len(held["toxic"])
    assert sum(i in kept for i in held["good"]) >= 0.97 * len(held["good"])
    assert 9000 not in kept


def test_p_toxic_without_labels_of_both_kinds(spark):
    alerts = spark.createDataFrame([(1, "one idiot", "a", "b"), (2, None, None, None)], "alert_id long, description string, publisher string, section string")
    for labels, least, most in (([], 0, 1e-5), ([(1, 1, 0)], 0, 1e-5), ([(1, 1, None), (7, 1, 1), (2, 1, 5)], 0, 1e-5), ([(1, 1, 1)], 0.99, 1)):
        got = alert_quality(alerts, spark.createDataFrame(labels, "alert_id long, quality int, toxic int")).collect()
        assert len(got) == 2 and all(least <= r["p_toxic"] <= most for r in got)
        assert {r["keep"] for r in got} == {most < 1}
