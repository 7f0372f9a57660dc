"""python tests/run_check.py [name-prefix ...]: compare registered queries with their SQL twins."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import compare, connect

import __spark_entry__ as entry
from metricloom.session import build_session

folder = "/root/testdata/sf0.01"
args = sys.argv[1:]
if args and args[0].startswith("/"):
    folder = args.pop(0)
spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = []
oracles = entry.oracle_sql()
for name, function in entry.queries().items():
    if args and not any(name.startswith(a) for a in args):
        continue
    start = time.time()
    try:
        if name in oracles:
            ok, said = compare(spark, con, folder, function, oracles[name])
            if not ok:
                near, _ = compare(spark, con, folder, function, oracles[name], digits=3)
                said = ("NEAR " if near else "") + said
        else:
            rows = function(spark, folder).collect()
            ok, said = True, f"rows only: {len(rows)} {str(rows[:2])[:300]}"
    except Exception as error:
        ok, said = False, "".join(traceback.format_exception_only(error))[:1500]
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {said}", flush=True)
    if not ok:
        bad.append(name)
print("failed:", bad)
