"""Run registered queries against their SQL: ``check_all.py [sf_dir] [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stacklore.plans import ORACLES, QUERIES  # noqa: E402
from stacklore.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark, db = local_session("8", memory="12g"), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, db, ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = "".join(traceback.format_exception_only(error))[:1500]
            problem += "".join(traceback.format_tb(error.__traceback__)[-3:-1])[-600:]
        bad += problem is not None
        note = "" if name in ORACLES else "(rows only)"
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {note}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} bad of {len(names) or len(QUERIES)}")


if __name__ == "__main__":
    main(*sys.argv[1:])
