import random

import pytest

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from tests.llm import test_leaks, test_lines
from tests.llm.fixtures import prose
from tests.llm.test_quality import junk
from tests.llm.test_similar import brute_leads

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, path = random.Random(22), str(tmp_path_factory.mktemp("sf"))
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgkm" for b in "aeiou" for c in "lnrst"]
    items = [(j, prose(rng, 30, vocabulary)) for j in range(3)]
    shared = "A line that many of the alerts have in common."
    texts = [prose(rng, rng.randint(30, 120), vocabulary) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] = junk(rng)
    for i in range(1, 120, 6):
        texts[i] += "\n" + shared + "\n" + prose(rng, 10, vocabulary)
    for i in range(2, 60, 12):
        texts[i] = texts[i] + "\n" + items[i % 3][1]
    texts += [texts[3], texts[4] + " more", texts[5], None, ""]
    docs = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(rng, 50, vocabulary), None, None, 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 120, 2)] + [(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_does_its_work_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    lines = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(COLUMNS)
        got = sorted((tuple(r) for r in docs.collect()), key=repr)
        pairs = [(r[0], r[1]) for r in given]
        if k == 0:
            kept = {r[0] for r in got}
            want = [r for r in given if r[0] in kept]
            assert kept >= {i for i in range(120) if i % 6} and not kept & set(range(0, 120, 6)) and None in kept
        elif k == 1:
            want = [(i, t, lang, source, len(t)) for (i, t, *_), (_, _, lang, source, _) in zip(
                sorted(test_lines.brute(pairs), key=lambda r: repr(r[0])), sorted(given, key=lambda r: repr(r[0])))]
        elif k == 2:
            want = [r for r, lead in zip(given, brute_leads(pairs)) if r[0] is None or r[0] == lead]
            assert len(want) < len(given)
        else:
            leaks = {i for i, *_ in test_leaks.brute(pairs, lines)}
            want = [r for r in given if r[0] not in leaks]
            assert len(want) < len(given)
        assert got == sorted(want, key=repr)
        given = got
    pieces = STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r[0] for r in given}
    assert sorted((p["doc_id"], p["piece"], p["ids_crc32"]) for p in corpus_pipeline.run(spark, sf_dir).collect() if p["doc_id"] is not None) == sorted(
        (p["doc_id"], p["piece"], p["ids_crc32"]) for p in pieces if p["doc_id"] is not None)


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
