"""Command line: python tests/check.py [name-prefix ...] (env CHECK_SF, default sf0.001)."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import SECONDS, compare, connect  # noqa: E402
from pixelquarry.session import build_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.001")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or n in wanted]
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if len(df.collect()) else ["no rows"])
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        state = "ok " if not problems else "BAD"
        bad += bool(problems)
        took = f"(spark {SECONDS['spark']:.2f} duck {SECONDS['duck']:.2f})" if name in oracles else "(rows only)"
        print(f"{state} {name} {time.time() - start:.2f}s {took}", flush=True)
        for p in problems:
            print("    " + p, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


main()
