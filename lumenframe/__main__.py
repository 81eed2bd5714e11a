"""Run registered queries: python -m lumenframe FOLDER [QUERY ...]; without names, list them."""

import sys

from pyspark.sql import SparkSession

from lumenframe import plans


def main(args: list[str]) -> int:
    known = plans.queries()
    if len(args) < 2:
        print("\n".join(sorted(known)))
        return 0
    if unknown := set(args[1:]) - set(known):
        print("unknown:", ", ".join(sorted(unknown)))
        return 2
    spark = SparkSession.builder.appName("lumenframe").getOrCreate()
    for name in args[1:]:
        print(name)
        known[name](spark, args[0]).show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
