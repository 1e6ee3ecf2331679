import random
import string

from kerbside.llm.lines import drop_repeated_lines
from tests.llm.fixtures import NOTHING, alerts, prose, rows_of

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_length=10, min_alerts=2):
    def key(line):
        return line.strip(SPACE).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_length:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_alerts or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_agrees_with_brute_force(spark):
    rng = random.Random(1)
    pool = [prose(rng, rng.randint(1, 4)) for _ in range(25)] + ["", "  ", "\tShort", "ÄÖÜ ÄÖÜ ÄÖÜ", "Ends in CR and more\r"]
    rows = [(i, "\n".join(rng.choice([str.upper, str, lambda s: f" {s}\x0b"])(rng.choice(pool)) for _ in range(rng.randint(0, 30))))
            for i in range(60)]
    rows += [(7, rows[7][1]), (7, "Another text of seven\nAnother text of seven"), (None, rows[3][1]), (61, None), (62, ""), (-5, rows[9][1])]
    rows += [(63, "\n".join(f"line number {k} is long" for k in range(20000))), (64, "\n".join(f"line number {k} is long" for k in range(1, 20000, 2)))]
    got = drop_repeated_lines(alerts(spark, rows, clashes=True))
    assert rows_of(got) == brute(rows)
    assert got.columns == ["alert_id", "description", "n_lines", "n_dropped"]
    assert rows_of(drop_repeated_lines(alerts(spark, rows), min_alerts=3)) == brute(rows, min_alerts=3)


def test_empty_table_carried_columns_and_native_plan(spark):
    assert rows_of(drop_repeated_lines(spark.createDataFrame([], NOTHING))) == []
    got = drop_repeated_lines(alerts(spark, [(1, "a"), (2, None)], clashes=True), carry=("key", "line"))
    assert [r["line"] for r in got.collect()] == ["x", "x"]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
