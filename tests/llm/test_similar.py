import random

from corpus_pipeline import one_of_each_group
from kerbside.llm.similar import bands, shingles, similar_groups
from tests.llm.fixtures import NOTHING, alerts, rows_of

VOCABULARY = [f"{a}{b}{c}{d}" for a in "bcdfgkm" for b in "aeiou" for c in "lnrst" for d in ("", "da", "mo")]


def plain_shingles(text, n=5):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_leads(rows, least=0.8):
    """The smallest id of each row's group, by comparing all pairs."""
    sets, group = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    lead = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lead[root(i)] = min(lead.get(root(i), key), key)
    return [lead.get(root(i)) for i in range(len(rows))]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def case(rng):
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(60, 200))) for _ in range(40)]
    texts += [edited(rng, rng.choice(texts[:40]), rng.randint(1, 4)) for _ in range(120)]
    for _ in range(40):       # a chain, whose ends are far from each other
        texts.append(edited(rng, texts[-1], 1))
    texts += [edited(rng, texts[7], rng.randint(0, 5)) for _ in range(80)]
    return [(i * 2, t) for i, t in enumerate(texts)]


def test_near_copies_of_similarity_0_8_leave_the_corpus(spark):
    rows = case(random.Random(31))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lead = brute_leads(rows)
    want = sorted(i for (i, _), g in zip(rows, lead) if i == g)
    assert len(want) < len(rows) - 150
    assert sorted(r["doc_id"] for r in one_of_each_group(spark, docs, "").collect()) == want


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(32)
    rows = case(rng) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "long " * 30000), (5, "Bal bal bal")]
    rows += [(None, rows[4][1]), (4, rows[4][1].upper()), (None, "of its own")]
    want = sorted(((i, g) for (i, _), g in zip(rows, brute_leads(rows))), key=repr)
    assert rows_of(similar_groups(alerts(spark, rows, clashes=True))) == want


def test_pairs_at_the_threshold_share_a_band():
    rng = random.Random(33)
    met = 0
    for _ in range(400):
        words = [str(rng.random()) for _ in range(94)]
        other = words[:84] + [str(rng.random()) for _ in range(10)]        # 80 of 100 shingles
        one, two = shingles(" ".join(words)), shingles(" ".join(other))
        assert len(set(one) & set(two)) == 80 and len(set(one) | set(two)) == 100
        met += bool(set(bands(one)) & set(bands(two)))
    assert met == 400


def test_empty_table(spark):
    assert rows_of(similar_groups(spark.createDataFrame([], NOTHING))) == []


def test_a_crowd_below_the_threshold_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with too many edits of their own to be similar to any other; a few are similar."""
    import kerbside.llm.similar as module
    verified = []
    plain = module._verified
    monkeypatch.setattr(module, "_verified", lambda pairs, *more: verified.append(pairs.count()) or plain(pairs, *more))
    rng = random.Random(34)
    base = rng.choices(VOCABULARY, k=300)
    made = []
    for n in (150, 300):
        verified.clear()
        texts = [edited(rng, " ".join(base), 9) for _ in range(n)] + [edited(rng, " ".join(base), 1) for _ in range(20)]
        rows = list(enumerate(texts))
        want = sorted(((i, g) for (i, _), g in zip(rows, brute_leads(rows))), key=repr)
        assert rows_of(module.similar_groups(alerts(spark, rows))) == want and len({g for _, g in want}) > n // 2
        made.append(sum(verified))
    assert made[0] < 1500 and made[1] < 2.5 * made[0]      # of 14,365 and 51,040 pairs


def test_pairs_that_share_single_bands_of_a_crowd_are_linked(spark, monkeypatch):
    """Two texts may share a crowded band and none beside it."""
    import kerbside.llm.similar as module
    monkeypatch.setattr(module, "CROWD", 1)
    rng, pairs = random.Random(35), []
    while len(pairs) < 3:
        words = [str(rng.random()) for _ in range(94)]
        one, two = " ".join(words), " ".join(words[:84] + [str(rng.random()) for _ in range(10)])
        shared = [i for i, (a, b) in enumerate(zip(bands(shingles(one)), bands(shingles(two)))) if a == b]
        if shared and all((j - i) % module.BANDS > 2 for i in shared for j in shared if i != j):
            pairs.append((one, two))
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    assert rows_of(similar_groups(alerts(spark, rows))) == [(i, i - i % 2) for i, _ in rows]


def test_marks_never_hide_a_similar_pair(spark):
    from pyspark.sql import functions as F

    from kerbside.llm.similar import _shareable, _sketched
    rng = random.Random(36)
    base = " ".join(rng.choices(VOCABULARY, k=150))
    texts = [edited(rng, base, n) for n in (0, 1, 2, 5, 9, 30)] + ["one", "long " * 3000, " ".join(rng.choices(VOCABULARY, k=3000))]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sizes = spark.createDataFrame([(i, len(shingles(t))) for i, t in enumerate(texts)], "node long, size long")
    marked = _sketched(table, 5).join(sizes, "node")
    got = {(a, b): n for a, b, n in marked.alias("p").crossJoin(marked.alias("m")).select("p.node", "m.node", _shareable("p", "m").alias("n")).collect()}
    sets = [set(shingles(t)) for t in texts]
    assert all(len(sets[a] & sets[b]) <= n <= len(sets[a]) for (a, b), n in got.items()) and got[0, 5] < 0.8 * len(sets[0])
    bare = marked.withColumn("marks", F.lit(None).cast("array<long>"))
    assert all(n == len(sets[a]) for a, n in bare.alias("p").join(marked.alias("m"), F.lit(True)).select("p.node", _shareable("p", "m")).collect())
