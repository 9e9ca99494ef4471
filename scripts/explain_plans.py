"""Print the formatted physical plan of registered queries.

Usage: python scripts/explain_plans.py [sf_dir] [query ...]
Queries that run streams or write intermediate tables do that work while the
plan is built (their plan is then the read of the written result).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tmweave.plans.queries import QUERIES  # noqa: E402
from tmweave.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        print(f"===== {name}")
        QUERIES[name](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
