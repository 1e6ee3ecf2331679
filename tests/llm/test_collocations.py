import random
import re

import numpy as np

from kerbside.llm.collocations import _Filter, _joined, _numbered, alert_phrases
from kerbside.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, rows
from tests.llm.fixtures import CLASHES, rows_of

SCHEMA = "section string, description string" + "".join(f", {c} string" for c in CLASHES)


def brute(texts, least, best):
    """By definition: every phrase of every piece."""
    counts, totals = {}, {}
    for section, text in texts:
        section = "und" if section is None else section
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[section] = totals.get(section, 0) + len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    key = section, tuple(w[i:i + m])
                    counts[key] = counts.get(key, 0) + 1
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = {(s, w[i:j]): max(n, 0) for (s, w), n in sorted(candidates.items(), key=lambda x: x[1])
              for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}
    out = {}
    for (s, w), a in candidates.items():
        if inside.get((s, w), 0) >= a:
            continue
        cuts = [(1000 * a * totals[s] // (counts[s, w[:k]] * counts[s, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(s, []).append((-score, -a, " ".join(w).encode(), counts[s, w[:k]], counts[s, w[k:]]))
    return sorted(((s, rank, p.decode(), -a, left, right, totals[s], -score) for s, found in out.items()
                   for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1)), key=repr)


def case(rng):
    words = "smoke ozone Straße pollen wind über high near park at the of and ZONE   é x\x00y".split(" ")
    phrases = ["road closed until further notice", "air quality alert in effect", "high wind", "a a a a a a", "until further notice"]
    texts = []
    for _ in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 6))]
        texts.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([". ", "\t", " ", "\n", ","]).join(parts)))
    return texts + [("en", None), ("en", ""), ("fr", "one two"), (None, None)] + texts[:5] * 3


def frame(spark, texts):
    return spark.createDataFrame([(*t, *["x"] * len(CLASHES)) for t in texts], SCHEMA).repartition(6)


def test_phrases_agree_with_brute_force(spark):
    texts = case(random.Random(12))
    for least, best, bits in ((5, 2000, 1 << 16), (5, 7, 64), (40, 100, 1 << 16)):      # 64 bits let nearly everything through
        want = brute(texts, least, best)
        assert want and rows_of(alert_phrases(frame(spark, texts), least=least, best=best, filter_bits=bits)) == want


def test_a_block_is_no_limit(spark, monkeypatch):
    import kerbside.llm.collocations as module
    texts = case(random.Random(13))
    monkeypatch.setattr(module, "BLOCK", 50)
    got = module._summed(module._word_counts(frame(spark, texts).select(
        "section", module.text_of("description").alias("text")).where("section is not null")), 1)
    assert got.where("phrase is null and section = 'fr'").first()["n"] == 2


def test_scores_pass_64_bits(spark):
    texts = [("en", "rare pair. " * 3 + "common " * 500)]
    assert rows_of(alert_phrases(frame(spark, texts), least=3)) == brute(texts, 3, 2000)


def test_filter_never_loses(spark):
    phrases = [(f"s{i % 3}", f"w{i} w{i * i}" if i % 2 else f"w{i}", i) for i in range(2000)]
    held = _Filter.of(spark.createDataFrame(phrases, "section string, phrase string, n long"), 1 << 15)

    def numbers(rows):
        for section, phrase, _ in rows:
            w = [np.array([_numbered(section.encode(), word.encode())], np.uint64) for word in phrase.split()]
            yield _joined(*w)[0] if len(w) == 2 else w[0][0]

    assert held.holds(np.array([*numbers(phrases)])).all()
    some = [*numbers(phrases[:50])] + [np.uint64(i * 0x9E3779B97F4A7C15 % 2 ** 64) for i in range(50)]
    assert [held.has(int(n)) for n in some] == held.holds(np.array(some)).tolist()
    assert held.holds(np.array([*numbers((("s9", f"x{i} y", 0) for i in range(2000)))])).sum() < 200


def test_query_agrees_with_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["op12_collocations"](spark, sf_dir)
    relation = connect(sf_dir).execute(ORACLE_SQL["op12_collocations"])
    names = [d[0] for d in relation.description]
    want = rows(names, relation.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want and want[1]


def test_empty_table(spark):
    assert rows_of(alert_phrases(frame(spark, [("en", "x")]).limit(0))) == []
