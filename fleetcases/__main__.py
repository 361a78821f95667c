"""Run a named query from the command line.

    python -m fleetcases list
    python -m fleetcases show  <query> [sf_dir] [rows]
    python -m fleetcases write <query> <out_path> [sf_dir]
    python -m fleetcases sql   "<Spark SQL over case_table, reboot_cases, ...>" [sf_dir] [rows]

All rows are printed, as they come, unless a number of rows is given.
"""

from __future__ import annotations

import sys

DEFAULT_DIR = "/root/testdata/sf0.01"


def _print(df, rows: str | None) -> None:
    """Tab-separated rows under their column names; fetched partition by partition."""
    print("\t".join(df.columns))
    for row in (df if rows is None else df.limit(int(rows))).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str]) -> int:
    from fleetcases.plans.queries import QUERIES

    if not argv or argv[0] == "list":
        for name, fn in QUERIES.items():
            print(f"{name:28s} {(fn.__doc__ or '').strip().splitlines()[0] if fn.__doc__ else ''}")
        return 0
    from fleetcases.plans.sinks import write_table
    from fleetcases.session import get_session

    cmd, name = argv[0], argv[1]
    spark = get_session("local[*]")
    if cmd == "show":
        sf_dir = argv[2] if len(argv) > 2 else DEFAULT_DIR
        _print(QUERIES[name](spark, sf_dir), argv[3] if len(argv) > 3 else None)
    elif cmd == "sql":
        from fleetcases.plans.context import context
        context(spark, argv[2] if len(argv) > 2 else DEFAULT_DIR).register_views()
        _print(spark.sql(name), argv[3] if len(argv) > 3 else None)
    elif cmd == "write":
        sf_dir = argv[3] if len(argv) > 3 else DEFAULT_DIR
        write_table(QUERIES[name](spark, sf_dir), argv[2])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
