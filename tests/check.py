"""Command line: python tests/check.py [name prefix ...] compares queries with their SQL twins."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwright.queries import load  # noqa: E402
from tabwright.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(sf)
    qs, sql = load()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name == w or name.startswith(w + "_") or (len(w) == 1 or w.endswith("_")) and name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                why = compare(df, con, sql[name])
                status = "OK" if why is None else "DIFF " + why
            else:
                status = f"rows {df.count()}"
                if "-v" in os.environ.get("CHECK_FLAGS", ""):
                    df.show(5, truncate=60)
        except Exception as e:
            why = status = "ERROR " + str(e)[:600]
        bad += not status.startswith(("OK", "rows"))
        print(f"{name:32s} {time.time() - t:6.1f}s {status}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
