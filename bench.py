"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query is
planned and run to the end once, every output row being produced and thrown away; the
time until its DataFrame stands is given apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from mailsieve.session import build_session  # noqa: E402

HEADLINE = [
    "clean_corpus", "clean_inference", "dedup_exact", "dedup_near", "sample_per_source",
    "stratified_split", "counts_by_source", "extract_urls", "url_score_enriched", "url_rollup",
    "page_score", "page_rollup", "link_score", "header_score", "sender_score", "authorship",
    "risk_categories", "classify", "metrics", "accuracy_by_source", "top_tokens",
    "wordpiece_merge", "verdicts", "deep_analyze", "two_layer_verdicts", "ablation",
    "robustness", "attack_breakdown", "windowed_verdicts", "sender_sessions", "history_top10",
    "explanations", "fit_and_score_model", "score_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["counts_by_source"](spark, sf_dir).collect()  # start the engine
    seconds = {}
    building = {}
    for name in names:
        start = time.time()
        df = registry.QUERIES[name](spark, sf_dir)
        building[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "of_which_building": building,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
