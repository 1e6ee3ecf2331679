import random

import numpy as np
import xxhash

from kerbside.llm.common import components
from kerbside.llm.simhash import class_links, fingerprint, near_groups
from tests.llm.fixtures import NOTHING, alerts, prose, rows_of


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius=4):
    n, group = len(marks), list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if bin(marks[i] ^ marks[j]).count("1") <= radius and group[j] > group[i]:
                    group[j], changed = group[i], True
    return group


def test_fingerprint_agrees_with_plain_version():
    rng = random.Random(2)
    for text in ["", " \n", "One", "ONE two\tthree", "a b c d", prose(rng, 300), "Ünder ÄÖ été NIGHT " * 9, "same " * 500]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, 120) for _ in range(12)]
    for _ in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["fog", "rain", "smog"])
        texts.append(" ".join(words))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " "), (903, "one"), (904, "long " * 30000), (5, texts[0])]
    rows += [(None, texts[4])]
    marks = [plain_fingerprint(t or "") for _, t in rows]
    group = brute_groups(marks)
    lead = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            lead[g] = min(lead.get(g, i), i)
    want = sorted(((i, f"{m:016x}", lead[g]) for (i, _), m, g in zip(rows, marks, group)), key=repr)
    assert len(set(group)) < len(set(marks))
    for bits in (3, 6):
        assert rows_of(near_groups(alerts(spark, rows, clashes=True), class_bits=bits)) == want


def test_empty_table(spark):
    assert rows_of(near_groups(spark.createDataFrame([], NOTHING))) == []


def test_class_links_connect_just_the_close_ones():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    marks = [int(b) for b in base]
    for b in base:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            marks.append(int(b) ^ sum(1 << int(f) for f in flips))
    marks = np.unique(np.array(marks, np.uint64))
    found = {tuple(sorted(map(int, p))) for label in range(8) for p in class_links(marks, label, 3, 4)}
    group = {int(m): int(m) for m in marks}
    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in found:
        group[root(max(a, b))] = root(min(a, b))
    want = brute_groups([int(m) for m in marks])
    seen = [root(int(m)) for m in marks]
    assert all((want[i] == want[j]) == (seen[i] == seen[j]) for i in range(len(marks)) for j in range(i))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 1999)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
