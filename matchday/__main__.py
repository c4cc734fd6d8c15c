"""Command-line runner: `python -m matchday silver|gold --root <lake>`.

silver: <root>/bronze -> <root>/silver (merge per table)
gold:   <root>/silver -> <root>/gold (+ JSON exports under <root>/export), enriched
        from the arrays in <root>/bronze/profiles and <root>/bronze/badges, if any
Master, partitions and other settings are those of `spark-submit` (or the defaults).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import gold, silver


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="matchday")
    ap.add_argument("step", choices=["silver", "gold"])
    ap.add_argument("--root", required=True, help="lake root holding bronze/ silver/ gold/")
    ap.add_argument("--season-start", default=gold.SEASON_START)
    ap.add_argument("--as-of", default=None, help="run date; fixtures before it are ignored")
    ap.add_argument("--parts", default=None,
                    help="comma list: silver parts (league,teams,players) or gold marts (default: all)")
    ap.add_argument("--only-new", action="store_true", help="silver: leave out parts whose loads were merged already")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()   # master and settings are the submitter's
    root = args.root.rstrip("/")
    parts = tuple(p for p in (args.parts or "").split(",") if p)
    if args.step == "silver":
        out = silver.run_silver(spark, f"{root}/bronze", f"{root}/silver", parts or silver.PARTS, only_new=args.only_new)
    else:
        out = gold.run_gold(spark, f"{root}/silver", f"{root}/gold", f"{root}/export",
                            season_start=args.season_start, as_of=args.as_of, marts=parts or gold.MARTS, bronze_root=f"{root}/bronze")
    print(json.dumps(out))


if __name__ == "__main__":
    main()
