"""Print the formatted physical plan of registered queries.

usage: python tools/explain.py [sf_dir] name [name ...]

Shows PushedFilters / ReadSchema of the scans, exchanges, broadcasts and
whole-stage-codegen spans -- the loop used to shape every plan here.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditframe.catalog import all_queries  # noqa: E402
from auditframe.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_spark(shuffle_partitions=8)
    queries = all_queries()
    for name in args:
        print(f"==== {name}")
        queries[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
