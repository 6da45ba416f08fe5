"""Command line check: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402


def main():
    from seasontide.plans.registry import QUERIES
    import importlib

    modules = os.environ.get("MODULES")
    if modules:
        for m in modules.split(","):
            importlib.import_module(f"seasontide.plans.{m}")
    else:
        import seasontide.plans.catalog  # noqa: F401
    sf = f"{harness.DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(QUERIES)
    spark = harness.spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.oracle_connection(sf)
    bad = 0
    for name in names:
        q = QUERIES[name]
        t = time.time()
        try:
            if q.sql:
                message = harness.compare(spark, con, q.run, q.sql, sf)
            else:
                n = len(q.run(spark, sf).collect())
                message = "" if n else "no rows"
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - t
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {took:6.2f}s {q.survey:4} {name} {message}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")


main()
