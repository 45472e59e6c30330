"""Run the registered queries against their SQL checks: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from cohortspark.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session("8"), oracle.connect(sf)
    checks, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in checks:
                diff = oracle.differences(df, con, checks[name])
            else:
                n = len(df.collect())
                diff = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff = [traceback.format_exc()[-1800:] if names else f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok '} {name} {time.time() - t:.1f}s {'; '.join(diff)[:2000]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
