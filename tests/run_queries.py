"""Runs registered queries against their SQL: python tests/run_queries.py DIR [name-prefix ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from wardwise import catalog  # noqa: E402
from wardwise.session import local_session  # noqa: E402


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    catalog.load()
    if os.environ.get("PLAIN"):  # a session with default settings
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = local_session()
    con, bad = checks.connect(sf_dir), []
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in catalog.SQL:
                problem = checks.compare(df, con, catalog.SQL[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(e))[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in catalog.SQL else '(rows)'} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failures: {bad}")


main()
