"""Summarise the executed physical plans of the headline queries as Markdown.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
For each query: scans with their read schema and pushed filters, the number
of shuffles, join strategies, aggregate kinds, Python evaluation nodes.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"FileScan parquet \[[^\]]*\].*?Location: [^\[]*\[file:([^\]]*)\].*?"
                         r"PushedFilters: \[([^\]]*)\].*?ReadSchema: (struct<[^>]*>)", plan):
        table = os.path.basename(m.group(1)).replace(".parquet", "")
        scans.append((table, m.group(3), m.group(2) or "-"))
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "scans": scans,
        "shuffles": count(r"Exchange hashpartitioning|Exchange RoundRobin|Exchange rangepartitioning|Exchange SinglePartition"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": {k: count(k) for k in ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                         "BroadcastNestedLoopJoin", "CartesianProduct"] if count(k)},
        "aggs": {k: count(k) for k in ["HashAggregate", "SortAggregate", "ObjectHashAggregate"] if count(k)},
        "windows": count(r"\bWindow\b"),
        "python": count(r"ArrowEvalPython|BatchEvalPython|MapInArrow"),
        "codegen_stages": count(r"\*\(\d+\)"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    import __spark_entry__ as E
    from bench import HEADLINE
    from leadsmith.session import build_session

    spark = build_session("plan-report", master="local[8]", shuffle_partitions=16,
                          checkpoint_dir=tempfile.mkdtemp(prefix="plans-", dir="/tmp"),
                          extra_conf={"spark.sql.adaptive.enabled": "false"})
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python tests/plan_report.py {sf_dir}` with AQE off, so the static plan is shown "
          "(AQE may still turn sort-merge joins into broadcast joins and coalesce partitions at run time). "
          "Shuffles count every exchange except broadcasts.\n")
    print("| query | scans: table (read schema) [pushed filters] | shuffles | broadcasts | joins | aggregates | windows | python |")
    print("|---|---|---|---|---|---|---|---|")
    from leadsmith.operators.mailbox import page_items
    from leadsmith.sources.derived import contact_site_pages, suppliers_with_sites

    # The leg of the mailbox finder that ends in its checkpoint.
    legs = {"common_mailbox (pages, up to the checkpoint)":
            lambda s, d: page_items(suppliers_with_sites(s, d).select("domain"), contact_site_pages(s, d))}
    for name in [*HEADLINE, *legs]:
        df = (legs.get(name) or E.queries()[name])(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        seen, scans = set(), []
        for t, schema, pushed in s["scans"]:
            key = (t, schema, pushed)
            if key in seen:
                continue
            seen.add(key)
            cols = schema[len("struct<"):-1]
            cols = ",".join(c.split(":")[0] for c in cols.split(",")) if cols else ""
            scans.append(f"{t}({cols})" + (f" [{pushed}]" if pushed != "-" else ""))
        fmt = lambda d: ", ".join(f"{k} x{v}" for k, v in d.items()) or "-"
        print(f"| {name} | {'; '.join(scans)} | {s['shuffles']} | {s['broadcasts']} | {fmt(s['joins'])} | "
              f"{fmt(s['aggs'])} | {s['windows']} | {s['python']} |")
    spark.stop()


if __name__ == "__main__":
    main()
