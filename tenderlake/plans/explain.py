"""Print the formatted physical plan of registered queries.

    python -m tenderlake.plans.explain match_tenders_exact [/root/testdata/sf0.1]

Plans are shown as Spark will run them (with AQE the final plan is chosen at
run time; ``--static`` turns AQE off to show the whole static plan).
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from tenderlake.plans.registry import QUERIES, load_all
    from tenderlake.session import get_session
    args = [a for a in argv[1:] if not a.startswith("--")]
    if not args:
        print(__doc__)
        return 2
    load_all()
    names = [a for a in args if a in QUERIES]
    dirs = [a for a in args if a not in QUERIES]
    sf_dir = dirs[0] if dirs else "/root/testdata/sf0.01"
    spark = get_session()
    if "--static" in argv:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        print(f"===== {n} =====")
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
