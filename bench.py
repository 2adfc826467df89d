"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lorespan.plans import bindings
from lorespan.plans.queries import QUERIES
from lorespan.session import local_session, scratch_dir
from lorespan.sources import corpus

HEADLINES = [
    "tool_summary", "heatmap", "savings_cumulative", "response_trend", "session_running_saved", "read_ref_turn",
    "change_class", "snapshot_upsert", "definitions", "references", "code_definitions", "code_calls",
    "symbol_search", "call_search", "merged_search", "batch_search",
    "resolve_chain", "callers", "resolve_full", "module_summary",
    "similarity_rank", "best_match", "turn_classes", "session_digest", "line_delta", "unified_delta",
    "redact_literals", "entity_counts", "stream_timeline",
]


def with_many_row_groups(spark, sf_dir: str, files: int) -> str:
    """The same tables, with documents written as several files: the given one is a single row group, which no number of
    tasks can share."""
    folder = scratch_dir(spark, "bench_data").removeprefix("file:")
    os.makedirs(folder)
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    corpus.read_table(spark, f"{sf_dir}/documents.parquet", files).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("lorespan-bench", cores=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    sf_dir = with_many_row_groups(spark, given, 2 * cpus)
    times: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    timed("index_build", lambda: bindings.index_path(spark, sf_dir))
    timed("index_build_again", lambda: bindings.build_index(spark, sf_dir, scratch_dir(spark, "bench_index")))
    earlier = bindings.build_previous(spark, sf_dir, scratch_dir(spark, "bench_previous"))
    timed("incremental_index", lambda: bindings.refresh_index(earlier, sf_dir))
    only = os.environ.get("BENCH_ONLY")
    for name in only.split(",") if only else HEADLINES:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    files = bindings.table(spark, sf_dir, "documents").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(given).replace("sf", ""),
                "index_files_per_sec": round(files / times["index_build_again"], 1),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
