"""python -m lectern NAME SF_DIR [OUT]: runs a registered query; without OUT, prints its first rows."""

from __future__ import annotations

import sys

from .registry import QUERIES
from .session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print(__doc__, *sorted(QUERIES), sep="\n")
        return 2
    df = QUERIES[args[0]](session(), args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
