"""python -m sealwork verify DIR...: checks capsules and exits with 0 (ok), 1 (failed) or 3 (ok in part)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sealwork.operators.capsule import verify_capsules


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sealwork")
    p.add_argument("command", choices=["verify"])
    p.add_argument("folders", nargs="+")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sealwork").getOrCreate()
    failures, outcomes = verify_capsules(spark, {f: f for f in a.folders})
    rows = [r.asDict() for r in outcomes.orderBy("crate").collect()]
    lines = [r.asDict() for r in failures.orderBy("crate", "rule", "entity").toLocalIterator()]
    if a.json:
        print(json.dumps({"outcomes": rows, "failures": lines}))
    else:
        for r in rows:
            print(r["crate"], r["status"])
        for f in lines:
            print(" ", f["crate"], f["rule"], f["entity"], f["message"])
    codes = {r["exit_code"] for r in rows}
    return 1 if 1 in codes else max(codes, default=0)


if __name__ == "__main__":
    raise SystemExit(main())
