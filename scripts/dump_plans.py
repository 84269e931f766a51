"""Write the physical plans of the headline queries to PLANS.md."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from softgrove.plans import operator_queries as oq  # noqa: E402
from softgrove.plans import table_queries as tq  # noqa: E402
from softgrove.session import local_session  # noqa: E402

QUERIES = ["stratified_split", "loo_train", "quantile_normalize", "mi_knn", "soft_tree_score",
           "soft_tree_score_numpy", "f1_macro", "oversample_random", "loo_many_levels", "encode_many_levels"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = local_session(8)
    parts = ["# Physical plans of the headline queries\n",
             f"Generated by `scripts/dump_plans.py` on `{os.path.basename(sf)}` (local[8]). "
             "Scans show the pruned `ReadSchema`; small sides are `BroadcastExchange`; "
             "adaptive execution may still re-plan at run time.\n"]
    for name in QUERIES:
        df = (tq.QUERIES | oq.QUERIES)[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts.append(f"\n## {name}\n\n```\n{plan.strip()}\n```\n")
    with open(out, "w") as f:
        f.write("".join(parts))


if __name__ == "__main__":
    main()
