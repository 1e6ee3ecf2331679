import random
import re

import pytest

from kerbside.llm import leaks
from kerbside.llm.leaks import MASKS, leaked_lines
from tests.llm.fixtures import NOTHING, alerts, prose, rows_of

OTHER = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, lines, window=13, similarity=0.8):
    """Pairs with a seed whose surrounding passage agrees in enough words."""
    found = {}
    for i, text in rows:
        w = tokens(text)
        for j, line in lines:
            v = tokens(line)
            width = min(window, len(v))
            for m in MASKS if len(v) >= 13 else [tuple(range(leaks.unbroken(len(v), similarity)))] if v else []:
                for p in range(len(w) - m[-1]):
                    for q in range(len(v) - m[-1]):
                        if any(w[p + o] != v[q + o] for o in m):
                            continue
                        for s in range(-window + 1, window - width + 1):
                            if p + s >= 0 and q + s >= 0 and p + s + width <= len(w) and q + s + width <= len(v):
                                if sum(w[p + s + t] == v[q + s + t] for t in range(width)) >= similarity * width:
                                    found.setdefault((i, j, 8 if len(v) >= 13 else len(m)), set()).add(p)
    return sorted(((i, j, min(p), max(p) + span, len(p)) for (i, j, span), p in found.items()), key=repr)


def plain_pairs(rows, lines, window=13, similarity=0.8):
    """Pairs with a passage that agrees in enough words, by looking at every alignment."""
    found = set()
    for i, text in rows:
        w = tokens(text)
        for j, line in lines:
            v = tokens(line)
            width = min(window, len(v))
            if width and any(sum(a == b for a, b in zip(w[p:p + width], v[q:q + width])) >= similarity * width - 1e-9
                             for p in range(len(w) - width + 1) for q in range(len(v) - width + 1)):
                found.add((i, j))
    return found


def test_no_allowed_replacement_hides_a_line_of_any_length(spark):
    """Against a search that knows no masks: lines of 1 to 16 words, as they are or with as many words replaced as may be, and one more."""
    rng = random.Random(13)
    lines = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 17)]
    rows = []
    for n, line in lines:
        may = min(13, n) - -(-min(13, n) * 8 // 10)
        for replaced in range(may + 2):
            for _ in range(6):
                words = line.split()
                for k in rng.sample(range(n), min(replaced, n)):
                    words[k] = "other"
                rows.append((len(rows), " ".join(["before", *words, "behind"])))
    held = spark.createDataFrame(lines, "line_id long, text string")
    got = {(r["alert_id"], r["line_id"]) for r in leaked_lines(alerts(spark, rows), held).collect()}
    want = plain_pairs(rows, lines)
    assert got == want and {j for _, j in want} == set(range(1, 17))


def case(rng):
    lines = [(j, prose(rng, n, OTHER)) for j, n in enumerate([13, 30, 9, 20, 5, 40])] + [(6, None), (7, "")]
    rows = []
    for i in range(40):
        middle = tokens(lines[rng.randrange(6)][1])
        for _ in range(rng.randint(0, 3)):
            middle[rng.randrange(len(middle))] = rng.choice(OTHER)
        rows.append((i, " ".join([prose(rng, rng.randint(0, 9), OTHER), *(w.upper() + rng.choice(["", ",", "\n"]) for w in middle), prose(rng, 5)])))
    return rows + [(3, rows[3][1]), (None, rows[0][1]), (50, None), (51, ""), (52, prose(rng, 4000, OTHER))], lines


def test_agrees_with_brute_force(spark):
    rows, lines = case(random.Random(11))
    held = spark.createDataFrame([(*r, "x", 1) for r in lines + [lines[1]]], "line_id long, text string, seed string, at int")
    got = leaked_lines(alerts(spark, rows, clashes=True), held)
    want = brute(rows, lines)
    assert want and rows_of(got) == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_both_joins_agree(spark, monkeypatch):
    rows, lines = case(random.Random(12))
    held = spark.createDataFrame(lines, "line_id long, text string")
    monkeypatch.setattr(leaks, "BROADCAST_SEEDS", 0)
    assert rows_of(leaked_lines(alerts(spark, rows), held)) == brute(rows, lines)


def test_two_replaced_words_of_thirteen_are_always_found():
    for a in range(13):
        for b in range(a):
            assert any(not {s + o for o in m} & {a, b} for m in MASKS for s in range(13 - m[-1]))


@pytest.mark.parametrize("rows, lines", [([], [(1, "a " * 20)]), ([(1, "a " * 20)], [])])
def test_empty_tables(spark, rows, lines):
    assert rows_of(leaked_lines(spark.createDataFrame(rows, NOTHING), spark.createDataFrame(lines, "line_id long, text string"))) == []
