"""Command line: ``python tests/run_oracle.py [sf_dir] [name-prefix ...]``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, connect  # noqa: E402
from tidemark.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
con, bad = connect(sf), 0
sqls = entry.oracle_sql()
for name, fn in entry.queries().items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    try:
        problem, n, took = compare(spark, con, sf, name, fn, sqls.get(name))
    except Exception as e:  # report and go on
        problem, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
    bad += bool(problem)
    print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={n:<7d} {took:6.2f}s {'' if name in sqls else '(no sql)'} {problem}", flush=True)
print("failures:", bad)
