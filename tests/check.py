"""Command line: compare queries with their SQL.  python tests/check.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from setspan.plans import registry  # noqa: E402
from setspan.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"{oracle.TESTDATA}/sf{sf}"
    con = oracle.duck(sf_dir)
    for name in names:
        t = time.time()
        try:
            if name in registry.ORACLES:
                n, message = oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf_dir)
            else:
                n, message = len(registry.QUERIES[name](spark, sf_dir).collect()), "rows only"
        except Exception as e:  # noqa: BLE001
            n, message = -1, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        print(f"{name:32s} {n:8d} {time.time() - t:6.2f}s  {message or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
