import itertools
import random
import re

import numpy as np

from kerbside.llm import personal
from kerbside.llm.personal import Field, base_spans, find_personal_data, luhn
from tests.llm.fixtures import NOTHING, alerts, prose, rows_of

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}  # noqa: B023
            if fine[kind]():
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def item(rng):
    return rng.choice([
        lambda: f"{rng.choice('abc')}.b_{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: "+1 (606) 555-78" + str(rng.randint(10, 99)),
        lambda: "4012888888881881", lambda: "4012 8888 8888 1881", lambda: "4012888888881882", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18))])()


def case(rng, n=120):
    return [(i, " ".join(itertools.chain(*((prose(rng, rng.randint(3, 12)), item(rng)) for _ in range(rng.randint(0, 4)))))) for i in range(n)]


def test_patterns_agree_with_the_plain_ones():
    rng = random.Random(19)
    odd = ["a@b.co_m@x.yz @@ a@ @b.c x@y", "1.2.3.4.5.6.7.8.9", "+1+23 45 678 9012", "1 2-3 4", "é@ü.de a@b.c.", "256.1.1.1 1.256.1.1.1.1 0000000000001.1.1.1",
           "+49 (0) 30.123-45 .", "a.b@c.d@e.f", "x" * 3000 + "@", "1" * 3000, "+" + "1 " * 2000, "%_@a-b.c-d"]
    odd += ["".join(rng.choice("ab1@.+- (9") for _ in range(60)) for _ in range(3000)]
    for text in odd + [t for _, t in case(rng)]:
        assert base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "+1" * 200_000, "a@" * 200_000, "1.2." * 100_000, "@ " * 50_000):
        personal.spans_of(text, Field())


def test_base_stays_and_secrets_are_added(spark):
    rows = case(random.Random(20)) + [(505, "twice a@b.co"), (505, "twice a@b.co"), (None, "mail a@b.co"), (500, None), (501, ""),
                                      (502, "calm " * 30000 + "a@b.co"), (503, "Licensed under CC BY-NC 4.0."), (504, "version 3.")]
    got = find_personal_data(alerts(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        text, base, spans = texts[r["alert_id"]], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]
        assert base == plain(text) and set(base) <= set(spans)
        secrets = [m.span() for m in re.finditer(r"(password|token)[ =\"]+[0-9a-f]+\"?", text)]
        assert [s[1:] for s in spans if s[0] == "secret"] == secrets, text
        assert len(spans) >= len(base)
    clean = {r["alert_id"]: r["spans"] for r in got}
    assert clean[503] == [] and clean[504] == []


def test_dynamic_programming_agrees_with_enumeration():
    rng, field = np.random.default_rng(21), Field()
    field.weights, field.moves = rng.standard_normal(field.weights.shape), rng.standard_normal(field.moves.shape)
    text = "call +1 555 4012888888881881 now"
    words = [m.span() for m in personal.TOKEN.finditer(text)]
    segments = field.segments(text, words)

    def ways(at):
        if at == len(words):
            yield []
            return
        for j in range(at + 1, len(words) + 1):
            states = ([0] if j == at + 1 else []) + (list(range(1, 6)) if (at, j) in segments else [])
            for state in states:
                for rest in ways(j):
                    yield [(at, j, state), *rest]

    def score(way):
        total, came = 0.0, 0
        for i, j, state in way:
            total += field.moves[came, state] + (field.weights[state - 1] @ segments[i, j] if state else 0)
            came = state
        return total

    best = max(ways(0), key=score)
    assert field.decode(len(words), segments) == [(i, j, personal.KINDS[s - 1]) for i, j, s in best if s]
    all_ways = list(ways(0))
    scores = np.array([score(w) for w in all_ways])
    p = np.exp(scores - np.logaddexp.reduce(scores))
    want = -sum(pi * sum(segments[i, j] for i, j, s in w if s == 1) for pi, w in zip(p, all_ways) if any(s == 1 for *_, s in w))
    before = field.weights.copy()
    field.learn(len(words), segments, {}, 1.0, 0.0)
    assert np.allclose(field.weights[0] - before[0], want)


def test_empty_table(spark):
    assert rows_of(find_personal_data(spark.createDataFrame([], NOTHING))) == []
