"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

QUERIES = (
    "jn1_forward_hop", "jn3_three_hops", "pf9_scope_guard", "pf10_as_of", "ag2_schema_summary", "ag5_topics", "wn3_validity_chain", "gr1_neighbours", "gr2_pagerank_3_rounds",
    "ve1_knn", "ve2_two_pass", "ve7_search", "rc2_vibe", "rc1_classify", "rc4_change", "in1_extract_triples", "in6_turns_to_items", "mt4_strengths", "dm12_flush_window", "co7_callers",
)


def main() -> None:
    from bitempo.queries import QUERIES as known
    from bitempo.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known["jn1_forward_hop"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # classes are loaded, untimed
    took = {}
    for name in QUERIES:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
