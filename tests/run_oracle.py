"""Run registered queries against their DuckDB oracle: python -m tests.run_oracle [sf_dir] [name...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402
from kerbside.session import build_session  # noqa: E402
from tests.oracle_compare import compare  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    if os.environ.get("PLAIN_SESSION"):
        # a plain session, as a caller of the driver contract may build it
        from pyspark.sql import SparkSession

        spark = (
            SparkSession.builder.master("local[8]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate()
        )
    else:
        spark = build_session("local[8]", 8)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name not in oracles:
            n = df.count()
            print(f"{name:40s} rows-only n={n} {time.time() - t0:.1f}s")
            continue
        s, d, srows, drows, names, dnames = compare(df, oracles[name], sf_dir)
        ok = s == d
        bad += not ok
        print(f"{name:40s} {'OK ' if ok else 'BAD'} spark={s[0]} duck={d[0]} {time.time() - t0:.1f}s")
        if not ok:
            print("   spark cols", s[1], "\n   duck  cols", d[1])
            ss = set(map(repr, srows))
            ds = set(map(repr, drows))
            print("   only spark:", sorted(ss - ds)[:3])
            print("   only duck :", sorted(ds - ss)[:3])
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
