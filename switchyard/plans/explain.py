"""Write the physical plans of headline queries (``python -m switchyard.plans.explain``).

Each entry names what to look for in the plan: pushed filters and pruned
read schemas, partial aggregation, partial window group limits, broadcasts
limited to bounded inputs, no nested-loop or cartesian joins.
"""

from __future__ import annotations

import os
import sys

HEADLINE = {
    "filter_recent": "time filter pushed into the Parquet scan; only used columns read",
    "agg_rates": "three rates from one scan: partial then final aggregate, no join",
    "win_share_of_total": "total as a scalar subquery; top-20 by TakeOrderedAndProject",
    "seed_hopper": "row_number() <= n planned with a partial WindowGroupLimit before the shuffle",
    "insert_ignore": "first incoming row per key by min(struct): partial aggregation, then anti join",
    "anti_null_aware": "NOT IN without broadcasting the subquery side: shuffle join on distinct keys + scalars",
    "join_grade_rules": "rules swept into disjoint segments (rules only); samples find theirs by binary search, no shuffle of samples",
    "retention_by_age": "policy matched in-row against a literal array: no join at all",
    "agg_component_presence": "one conditional-count pass per host, then unpivot: no host x component product",
    "join_rank_zip": "needs and free slots in one range-partitioned order, fixed once; ranks from prefix counts, pairs by an aggregate",
}


def main(sf_dir: str = "/root/testdata/sf0.1") -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from switchyard.plans.catalog import QUERIES
    from switchyard.session import local_session

    spark = local_session()
    print("# PLANS\n")
    print(f"Physical plans (before adaptive re-planning) of headline queries at `{sf_dir}`, produced by "
          "`python -m switchyard.plans.explain`.\n")
    for key, note in HEADLINE.items():
        df = QUERIES[key](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001 - plan text only
        print(f"## `{key}`\n\n{note}.\n\n```\n{plan.strip()}\n```\n")


if __name__ == "__main__":
    main(*sys.argv[1:])
