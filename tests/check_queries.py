"""Run registered queries against their SQL twins: python tests/check_queries.py [key ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import compare, connect  # noqa: E402
from threadlens.plans.registry import load  # noqa: E402
from threadlens.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for key, q in load().items():
        if wanted and key not in wanted:
            continue
        t = time.time()
        try:
            df = q.run(spark, sf)
            if q.sql is None:
                n = df.count()
                msg = None if n else "no rows"
                note = f"{n} rows, no SQL"
            else:
                msg, note = compare(df, con, q.sql), "ok"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {key} {time.time() - t:.2f}s {msg or note}", flush=True)
    print("failures:", bad)
