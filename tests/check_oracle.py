"""``python tests/check_oracle.py [sf_dir] [name ...]``: compare queries with their SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from loomline.session import build_session, clear_scratch  # noqa: E402
from tests.oracle import connect, difference, spark_rows, sql_rows  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            spent = time.time() - started
            if name not in sql:
                print(f"rows  {name} {len(got[1])} rows {spent:.1f}s", flush=True)
                continue
            problem = difference(got, sql_rows(con, sql[name]))
        except Exception as error:  # noqa: BLE001
            spent = time.time() - started
            problem = "raised " + "".join(traceback.format_exception_only(error))[:600]
        clear_scratch(spark)
        if problem:
            bad += 1
            print(f"FAIL  {name}: {problem[:900]}", flush=True)
        else:
            print(f"ok    {name} {len(got[1])} rows {spent:.1f}s", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main())
