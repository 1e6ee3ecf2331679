import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import kerbside.llm.mixing as mixing
from kerbside.llm.mixing import Code, Mixer, alert_likelihood, packed, unpacked
from kerbside.llm.queries import QUERIES
from tests.llm.fixtures import alerts, prose


def plain_words(text):
    text = "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]


def brute(rows):
    """(held_out, n_tokens, n_known, N, base) of every row, by definition."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    count = {}
    for (_, text), out in zip(rows, held):
        for w in [*plain_words(text), None] if not out else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return [(out, len(t), sum(w in count for w in t), n, sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            for out, t in ((out, [*plain_words(text), None]) for (_, text), out in zip(rows, held))]


def case(rng):
    rare = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    texts = []
    for i in range(400):
        parts = [rng.choice(rare) if rng.random() < 0.15 else None for _ in range(rng.randint(0, 80))]
        texts.append(" ".join(p or "The road is closed until further notice" for p in parts) if i % 3 else prose(rng, rng.randint(0, 300)))
    texts += [texts[7]] * 20 + ["", None, " \n\t", "Straße ÜBER zone\x00", "wörd " * 3000]
    return list(enumerate(texts)) + [(None, texts[3]), (5, texts[5])]


@pytest.mark.parametrize("size", [1 << 21, 500])
def test_counts_and_base_agree_with_brute_force(spark, size):
    rows = case(random.Random(1))
    frame = alerts(spark, rows, clashes=True).repartition(3)
    got = sorted((repr(r["alert_id"]), r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["bits_per_byte"])
                 for r in alert_likelihood(frame, chunk_tokens=size).collect())
    want = sorted((repr(i), t, out, known, n, base) for (i, _), (out, t, known, n, base) in zip(rows, brute(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert all(g[6] < 0 for g in got) and sum(g[7] is None for g in got) == sum(not t for _, t in rows)
    held = [g for g in got if g[2]]
    assert len(held) > 20 and sum(g[6] for g in held) > 0.7 * sum(g[5] for g in held)      # far better than the base on texts it has not seen


def test_order_of_words_matters(spark):
    rng = random.Random(2)
    rows = case(rng)
    held = [i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    plain = {r["alert_id"]: r["score"] for r in alert_likelihood(alerts(spark, rows)).collect()}
    mixed = [(i, " ".join(rng.sample(plain_words(t), len(plain_words(t)))) if i in held else t) for i, t in rows]
    shuffled = {r["alert_id"]: r["score"] for r in alert_likelihood(alerts(spark, mixed)).collect()}
    assert sum(plain[i] for i in held) > 0.9 * sum(shuffled[i] for i in held)


def test_code_is_a_prefix_code_of_least_length():
    rng = random.Random(3)
    for n in (2, 3, 50, 400):
        weights = [rng.choice([1, 1, 2, 5, 40, 1000]) for _ in range(n)]
        code = Code(weights)
        words = ["".join(map(str, code.bit[code.start[s]:code.start[s + 1]])) for s in range(n)]
        assert sum(2.0 ** -len(w) for w in words) == 1 and not any(a != b and b.startswith(a) for a in words for b in words)
        total = sum(weights)
        entropy = -sum(w * math.log2(w / total) for w in weights)
        assert entropy <= sum(w * len(c) for w, c in zip(weights, words)) <= entropy + total
        assert (code.zeros + code.ones)[code.node[code.start[0]]] == total


def test_probabilities_of_all_next_symbols_sum_to_one():
    """Whatever the mixer has learnt, the bits of the code give a distribution over the symbols."""
    rng = np.random.default_rng(4)
    code, mixer = Code([5, 3, 8, 1, 1, 9, 30]), Mixer()
    for _ in range(30):
        mixer.log_loss(rng.standard_normal((4, 500)), rng.integers(0, 60, 500), rng.integers(0, 9, 500), rng.integers(0, 2, 500).astype(float), np.ones(500))
    inputs, gates = rng.standard_normal((4, 6)), rng.integers(0, 60, 6)
    total = 0.0
    for s in range(7):
        path = slice(code.start[s], code.start[s + 1])
        node = code.node[path]
        weights, shift = mixer.weights.copy(), mixer.shift.copy()
        total += math.exp(mixer.log_loss(inputs[:, node], gates[node], np.arange(len(node)), code.bit[path].astype(float), np.zeros(len(node))).sum())
        assert (mixer.weights == weights).all() and (mixer.shift == shift).all()       # a held out text teaches nothing
    assert abs(total - 1) < 1e-9


def test_earlier_bits_of_a_text():
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(6), rng.randrange(2)) for _ in range(300)]
    zeros, ones = mixing._earlier(*(np.array(c) for c in zip(*rows)))
    for at, (t, n, _) in enumerate(rows):
        before = [b for u, m, b in rows[:at] if (u, m) == (t, n)]
        assert (zeros[at], ones[at]) == (before.count(0), before.count(1))


def test_contexts_are_counted_over_all_chunks(spark):
    rows = [(i, t) for i, t in case(random.Random(6)) if i is not None and zlib.crc32(str(i).encode()) % 10]
    words = ["", "", *sorted({w for _, t in rows for w in plain_words(t)})]
    known = [w.encode("utf-8", "surrogatepass") for w in words]
    code = Code([1] * len(known))
    frame = spark.createDataFrame([(i, t or "", False) for i, t in rows], "key long, text string, held boolean").repartition(4)
    chunks = mixing._chunks(frame, known, np.zeros((257, 257)), 700).cache()
    rows_of_chunks = {r["chunk"]: r.asDict() for r in chunks.collect()}
    assert len(rows_of_chunks) > 5
    whole = {}
    for row in rows_of_chunks.values():
        chunk = mixing.Chunk(row, code, 40)
        for key, zero, one in zip(chunk.keys.tolist(), chunk.zeros.tolist(), chunk.ones.tolist()):
            z, o = whole.get(key, (0, 0))
            whole[key] = z + zero, o + one
    got = mixing._met_counts(chunks, code, 40, 3).collect()
    assert {r["chunk"] for r in got} == set(rows_of_chunks)
    for r in got:
        chunk, parts = mixing.Chunk(rows_of_chunks[r["chunk"]], code, 40), sorted(r["met"])
        zeros, ones = (np.concatenate([unpacked(p[c]) for p in parts]).tolist() for c in ("zeros", "ones"))
        assert list(zip(zeros, ones)) == [whole[k] for k in chunk.keys.tolist()]


def test_words_are_spelt_by_their_letters():
    letters = np.log(np.random.default_rng(7).random((257, 257)))
    words = [b"a", b"street", "Straße".encode(), b"bb"]
    got = mixing._spelt(words, letters)
    for g, w in zip(got, words):
        spelt = [256, *w, 256]
        assert math.isclose(g, sum(letters[a, b] for a, b in zip(spelt, spelt[1:])))
    assert len(mixing._spelt([], letters)) == 0


def test_packing_round_trip():
    for values in ([], [0], [1, 2 ** 63, 2 ** 64 - 1, 7]):
        assert unpacked(packed(np.array(values, np.uint64))).tolist() == values


def test_nothing_to_learn_from_and_empty_tables(spark):
    (row,) = alert_likelihood(alerts(spark, [(None, "a few words")])).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 4, 0, 0, 0.0) and row["score"] < 0
    assert alert_likelihood(alerts(spark, [])).collect() == []


def test_query_over_the_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op13_context_mixing"](spark, sf_dir).collect()}
    for (i, _), (out, tokens, known, n, base) in zip(rows, brute(rows)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, tokens, known, n) and math.isclose(r["base_score"], base, rel_tol=1e-12)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_every_bit_of_a_token_has_the_context_of_the_token_before():
    import numpy as np

    from kerbside.llm.mixing import Chunk, Code, packed
    code = Code([5, 1, *range(1, 400)])
    tokens = np.array([*range(2, 401, 7), 0], np.int64)
    chunk = Chunk({"data": packed(tokens), "lengths": [len(tokens)], "held": [False]}, code, 40)
    depths = code.depth[tokens]
    assert depths.max() > 8 and np.array_equal(np.diff(chunk.first)[chunk.pair], depths)
    assert len(chunk.keys) == depths.sum() == (chunk.zeros + chunk.ones).sum()


def test_pairs_behind_a_context_travel_once_and_hot_contexts_are_dealt_out(spark):
    """A chunk sends a number or two for a pair of tokens, not one for each bit; no range of contexts holds all that follows a frequent token."""
    rng = random.Random(11)
    weights = [50, 1, 40000, *[rng.randint(1, 40) for _ in range(3000)]]
    code, tokens = Code(weights), []
    for s in range(3, 3003):
        tokens += [2, s]
    chunk = mixing.Chunk({"data": packed(np.array([*tokens, 0], np.uint64)), "lengths": [len(tokens) + 1], "held": [False]}, code, 32)
    pairs = len(chunk.first) - 1
    assert len(chunk.entries) <= 2 * pairs and chunk.first[-1] > 3 * len(chunk.entries)
    assert (np.unique(chunk.entries >> np.uint64(mixing.LEAF + 32 - 5), return_counts=True)[1] < pairs / 8).all()
    # What a chunk is told stands for both sides of every node.
    frame = spark.createDataFrame([(1, [False], [len(tokens) + 1], bytearray(packed(np.array([*tokens, 0], np.uint64))))],
                                  "chunk long, held array<boolean>, lengths array<long>, data binary")
    (row,) = mixing._answers(frame.unionByName(frame.withColumn("chunk", F.lit(2).cast("long"))), code, 32, 3).where("chunk = 1").collect()
    zeros, ones = chunk.passed(row["met"])
    assert np.array_equal(zeros, 2 * chunk.zeros) and np.array_equal(ones, 2 * chunk.ones)
    assert sum(len(p["leaves"]) + len(p["others"]) for p in row["met"]) < 2 * len(chunk.keys)
