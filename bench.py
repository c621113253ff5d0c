"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores, BENCH_QUERIES an optional comma-separated list of query names or prefixes. The base tables
of the derived forum are stored first ("setup", part of the total); every query is then run
from those tables BENCH_RUNS times (default 3). The median counts; "spread" gives the slowest less the fastest run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "c1_comments_with_posts", "c3_tags_with_flags", "d1_question_flags", "d2_flag_prevalence", "d3_tag_counts",
    "d5_rate_per_tag", "d6_rate_per_tag_category", "d7_global_summary", "d10_contingency_by_category",
    "d11_concreteness_per_tag", "d12_stability_summary", "e3_title_sample", "g6_html_to_text", "g7_detect_categories",
    "g9_flag_answers", "g10_flag_comments", "g13_explode_tags", "g14_tokenize", "g15_score_titles", "h2_global_test",
    "h5_pairwise_test", "h8_odds_ratios", "h11_rank_correlation_p", "k1_ingest", "k3_detect", "k5_rates", "k9_statistics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")

    from forum_signals.session import local_session
    from verification.base import workspace
    from verification.queries import QUERIES

    names = [n for n in QUERIES if n.startswith(tuple(chosen.split(",")))] if chosen else HEADLINE
    spark = local_session(cpus, app="forum-signals-bench")
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    workspace(spark, sf_dir)
    setup = time.time() - start
    seconds: dict[str, float] = {}
    spread: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(median(runs), 3)
        spread[name] = round(max(runs) - min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total seconds of setup and headline queries (median runs)",
        "value": round(setup + sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "setup": round(setup, 3),
        "spread": spread,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
