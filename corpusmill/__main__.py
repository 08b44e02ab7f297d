"""python -m corpusmill QUERY FOLDER [OUTPUT]: shows a query over the tables of a folder, or writes it as Parquet; without arguments lists the queries."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from corpusmill.plans import queries as core
    from corpusmill.runtime import prepare

    if len(args) not in (2, 3) or args[0] not in core.queries():
        print(__doc__, *sorted(core.queries()), sep="\n")
        return 2
    df = core.queries()[args[0]](prepare(SparkSession.builder.getOrCreate()), args[1])
    df.write.mode("error").parquet(args[2]) if len(args) == 3 else df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
