"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from metricloom.operators import metrics, stats  # noqa: E402
from metricloom.plans import QUERIES  # noqa: E402
from metricloom.plans.registry import Tables  # noqa: E402
from metricloom.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "prf1_profile_columns", "prf17_examine", "prc3_event_variants", "prc6_transitions", "prc7_process_metrics", "prc10_cohort_gap", "prc12_sequence_order",
    "agg3_summaries", "agg6_breakdowns", "agg_metric_set", "agg11_folded_legend", "sta1_correlate", "sta3_separation", "sta5_two_groups", "tim7_timeline", "cln5_cast_numeric",
    "cln11_apply_rules", "sql1_mart", "val9_report", "txt2_term_counts", "txt6_share_out", "pii2_masked_rows", "hsh1_content_hash", "src7_html_lines", "src10_xes_events",
]


def wide_table(t: Tables, columns: int):
    """A table of ``columns`` columns made from the embedding vectors, one in ten a category."""
    width = len(t.embeddings.select("embedding").first()[0])
    picks = []
    for i in range(columns):
        value = F.col("embedding")[i % width].cast("double") * (i // width + 1)
        picks.append(F.concat(F.lit("g"), F.floor(F.abs(value) * 40).cast("string")).alias(f"c{i}") if i % 10 == 0 else value.alias(f"c{i}"))
    return t.embeddings.select(*picks)


def wide_breakdown(t: Tables, columns: int):
    df = wide_table(t, columns)
    return metrics.compute_metrics(df, [f"c{i}" for i in range(0, columns, 10)])


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, FOLDER)
    jobs = {name: (lambda n=name: QUERIES[n](spark, FOLDER)) for name in HEADLINE}
    jobs["wide_breakdown_100"] = lambda: wide_breakdown(t, 100)
    jobs["wide_breakdown_300"] = lambda: wide_breakdown(t, 300)
    jobs["wide_correlations_96"] = lambda: stats.strongest_pairs(wide_table(t, 107).select(*[f"c{i}" for i in range(107) if i % 10]), [f"c{i}" for i in range(107) if i % 10])
    only = sys.argv[1:]
    QUERIES["agg1_rows_total"](spark, FOLDER).collect()  # start the workers before the clock
    took = {}
    for name, run in jobs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
