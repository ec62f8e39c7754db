"""Command line: ``python -m spendlens pipeline RAW WORK [--reports DIR] [--force]``
and ``python -m spendlens sql-analysis USERS CARDS TRANSACTIONS OUT``.

The session comes from ``SparkSession.builder.getOrCreate()``: under
``spark-submit`` the cluster's configuration applies; run directly it is a
local session.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()  # master and settings are the submitter's


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="spendlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("pipeline", help="raw files -> typed Parquet -> cleaned Parquet (-> reports)")
    p.add_argument("raw_dir")
    p.add_argument("work_dir")
    p.add_argument("--reports", default=None, help="write every report here")
    p.add_argument("--force", action="store_true", help="redo outputs that exist")
    p.add_argument("--as-of", type=datetime.date.fromisoformat, default=None, help="day for ages, as YYYY-MM-DD")
    s = sub.add_parser("sql-analysis", help="SQL-view analysis: anomalies and summary")
    s.add_argument("users")
    s.add_argument("cards")
    s.add_argument("transactions")
    s.add_argument("out_dir")
    a = ap.parse_args(argv)
    spark = _session()
    if a.cmd == "pipeline":
        from .plans.stages import run_pipeline

        print(json.dumps(run_pipeline(spark, a.raw_dir, a.work_dir, a.force, a.reports, a.as_of)))
        return 0
    from .plans.analysis import SqlAnalysis
    from .sources.files import write_report

    sa = SqlAnalysis(spark, a.users, a.cards, a.transactions)
    anomalies = sa.anomalies()
    write_report("anomalies", anomalies, a.out_dir)
    write_report("summary", sa.summary(spark.read.parquet(f"{a.out_dir}/anomalies")), a.out_dir)
    print(json.dumps({r["metric"]: r["value"] for r in spark.read.parquet(f"{a.out_dir}/summary").collect()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
