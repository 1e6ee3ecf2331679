"""python -m tests.check [sf] [name prefix ...]: compare catalogued queries with their SQL."""

import sys
import time
import traceback

from catalog import load_all
from kerbside.session import build_session
from tests.compare import compare, connect


def main(argv):
    sf = argv[0] if argv else "0.001"
    wanted = [a for a in argv[1:] if a != '-v']
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                 "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, entry in load_all().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            print('>', name, flush=True) if '-v' in argv else None
            status, detail, spent, n = compare(spark, con, entry, sf_dir)
        except Exception as error:  # report and go on with the others
            status, detail, spent, n = "error", str(error)[:1500], 0.0, 0
            if "-v" in argv:
                traceback.print_exc()
        bad += status not in ("ok", "rows-only")
        if status != "ok" or spent > 3 or wanted:
            print(f"{status:10} {name:34} {spent:6.2f}s {n:8} {detail}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    start = time.time()
    main(sys.argv[1:])
    print(f"{time.time() - start:.0f}s")
