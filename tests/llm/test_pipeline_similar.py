from corpus_pipeline import STAGES
from tests.llm import test_leaks
from tests.llm.test_pipeline import sf_dir  # noqa: F401
from tests.llm.test_similar import brute_leads


def test_near_copies_by_similarity_and_the_stages_after_them(spark, sf_dir):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in STAGES[:-1]:
        given, docs = docs.collect(), stage(spark, docs, sf_dir)
        pairs = [(r["doc_id"], r["text"]) for r in given]
        if name == "near copies":
            want = [r for r, lead in zip(given, brute_leads(pairs)) if r["doc_id"] is None or r["doc_id"] == lead]
        elif name == "leaks":
            leaks = {i for i, *_ in test_leaks.brute(pairs, lines)}
            want = [r for r in given if r["doc_id"] not in leaks]
        else:
            continue
        assert len(want) < len(given) and sorted(docs.collect(), key=repr) == sorted(want, key=repr)
    assert 121 not in {r["doc_id"] for r in docs.collect()}        # text 4 and one word more
    pieces = STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_near_copies_by_fingerprints_leave_too(spark):
    """Copies within 4 bits of each other, though less than 0.8 of their shingles are the same."""
    import random

    from corpus_pipeline import one_of_each_group
    from kerbside.llm.simhash import fingerprint
    from tests.llm.test_similar import VOCABULARY, edited

    rng, pairs = random.Random(37), []
    while len(pairs) < 2:
        base = " ".join(rng.choices(VOCABULARY, k=60))
        other = edited(rng, base, 3)
        if len(set(brute_leads([(0, base), (1, other)]))) == 2 and (fingerprint(base, 5) ^ fingerprint(other, 5)).bit_count() <= 4:
            pairs.append((base, other))
    (a, b), (c, d) = pairs
    close = d + " " + d.split()[0]                                 # similar to d alone, so c connects to it by both steps
    rows = [(1, a), (2, b), (3, d), (4, close), (5, c), (6, "something else altogether"), (None, b), (7, a), (6, "of the same id"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each_group(spark, docs, "").collect()), key=repr)
    assert got == sorted([rows[i] for i in (0, 2, 5, 6, 8, 9)], key=repr)
