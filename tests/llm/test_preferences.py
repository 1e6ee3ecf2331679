import random

from kerbside.llm.preferences import preference_pairs
from kerbside.llm.queries import answered_pairs
from tests.llm.fixtures import prose, rows_of

SCHEMA = "pair_id long, preferred boolean, seq int, role string, text string, at string, turn string, side string"


def show(role, text):
    return f"<|turn|>{role}\n" + text.replace("<|turn|>", "<| turn|>").replace("<|end|>", "<| end|>") + "<|end|>\n"


def brute(rows):
    pairs = {}
    for pair, side, seq, role, text in rows:
        if pair is not None and side is not None:
            pairs.setdefault(pair, {True: [], False: []})[side].append((seq is not None, seq or 0, role or "", text or ""))
    out = []
    for pair, sides in pairs.items():
        turns = {s: [t[2:] for t in sorted(v)] for s, v in sides.items()}
        n = 0
        while n < min(len(turns[True]), len(turns[False])) and turns[True][n] == turns[False][n]:
            n += 1
        line = [pair, n, "".join(show(*t) for t in turns[True][:n])]
        for s in (True, False):
            done, mask = "", []
            for role, text in turns[s][n:]:
                shown = show(role, text)
                if role == "assistant":
                    mask.append((len(done) + len(f"<|turn|>{role}\n"), len(done) + len(shown) - 1))
                done += shown
            line += [done, mask]
        out.append(tuple(line))
    return sorted(out, key=repr)


def test_agrees_with_brute_force(spark):
    rng = random.Random(18)
    rows = []
    for pair in range(40):
        shared = [(rng.choice(["user", "assistant", "system"]), prose(rng, rng.randint(0, 6))) for _ in range(rng.randint(0, 5))]
        for side in (True, False):
            own = [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "<|end|> cut", "ÄÖ 🚲"])) for _ in range(rng.randint(0, 3))]
            rows += [(pair, side, i * 3, *t) for i, t in enumerate(shared + own)]
    rows += [(100, True, 0, "user", "only chosen"), (101, False, 0, None, None), (102, True, 0, "user", "same"), (102, False, 0, "user", "same"),
             (None, True, 0, "user", "x"), (103, None, 0, "user", "x"), (104, True, 1, "user", "b"), (104, True, 1, "user", "a"), (104, False, None, "user", "a"),
             (105, True, 0, "assistant", "long " * 40000), (105, True, 0, "assistant", "long " * 40000)]
    rng.shuffle(rows)
    got = preference_pairs(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA))
    plain = [tuple([tuple(x) for x in v] if isinstance(v, list) else v for v in r) for r in got.collect()]
    assert sorted(plain, key=repr) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_mask_covers_the_answers_only(spark):
    rows = [(1, s, i, r, t) for s in (True, False) for i, (r, t) in enumerate([("user", "Cleaner way?"), ("assistant", "By the park." if s else "Same way.")])]
    got = preference_pairs(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)).first()
    assert got["prompt"] == "<|turn|>user\nCleaner way?<|end|>\n" and got["prompt_turns"] == 1
    a, b = got["chosen_mask"][0]
    assert got["chosen"][a:b] == "By the park.<|end|>"


def test_empty_table(spark):
    assert rows_of(preference_pairs(spark.createDataFrame([], SCHEMA))) == []


def test_every_turn_is_on_both_sides_but_for_the_last_answer(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "thanks"), (0, None, "system", "s"), (1, 0, "user", "r"), (1, 1, "assistant", "b"),
            (1, 2, "assistant", "c"), (2, 0, "user", "alone"), (3, 0, "assistant", "d"), (4, None, "assistant", "e"), (4, 0, "user", "f")]
    pairs = answered_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {(s, p): sorted(((q is not None, q or 0), r, t) for i, q, r, t, s2 in ((x["pair_id"], x["seq"], x["role"], x["text"], x["preferred"]) for x in pairs.collect()) if (s2, i) == (s, p))
           for s in (True, False) for p in range(5)}
    for p in range(5):
        assert [t for _, _, t in got[True, p]] == [t for _, t in sorted(((q is not None, q or 0), t) for i, q, r, t in rows if i == p)]
    assert [t for _, _, t in got[False, 0]] == ["s", "q", "c", "thanks"] and [t for _, _, t in got[False, 1]] == ["r", "b", "a"]
    assert got[False, 2] == got[False, 3] == got[False, 4] == []
