"""``python -m quillstone list``, or ``python -m quillstone run QUERY FOLDER [OUT]``."""

from __future__ import annotations

import sys

from .plans import registry


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(registry.queries())))
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4) and args[1] in registry.queries():
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"quillstone {args[1]}").getOrCreate()
        df = registry.queries()[args[1]](spark, args[2])
        df.write.parquet(args[3]) if len(args) == 4 else df.show(50, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
