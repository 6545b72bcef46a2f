"""Time the headline queries: one JSON line on stdout."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "bm25_topk", "tokens", "tf", "df", "retrieval_text", "content_kind", "noise_penalty", "structure_score",
    "sentences", "best_sentence", "fixed_windows", "md_sanitize", "md_chunks", "json_scalars", "json_chunks",
    "exact_dup", "query_profile", "prev_question", "title_match", "cosine_topk", "context_select",
    "line_citation", "answer_gate", "section_join", "eval_summary",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sparkfolio.plans import catalog

    runs = catalog.queries()
    runs["source_rollup"](spark, SF).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if n in runs]:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            runs[name](spark, SF).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
