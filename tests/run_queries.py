"""Time and check queries from the command line: run_queries.py SF_DIR [NAME ...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from compare import difference, oracle_connection  # noqa: E402
from packwright.session import SETTINGS  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.driver.memory", "8g")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        begun = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
                verdict = "ok" if found is None else "DIFFERS " + found
            else:
                verdict = f"rows {len(df.collect())}"
        except Exception as error:  # report and go on
            verdict = "ERROR " + str(error)[:1500]
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:24s} {time.time() - begun:6.2f}s {verdict[:1800]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
