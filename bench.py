"""Wall time per headline query; prints one JSON line.

The given tables have one row group each, hence one task. They are written once, outside the
clock, in files of bounded rows and read from there; ``as_given`` holds the time of the queries over
texts on the tables as they are. ``stream_rows_per_sec`` is the rate of the running counts' loop.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reliefgrid.plans.catalogue import QUERIES  # noqa: E402
from reliefgrid.session import drop_scratch, local_session, scratch_path  # noqa: E402

#: Rows of a file: texts are long, other rows short.
FILE_ROWS = {"documents": 1_250, "conversations": 5_000, "pages": 1_250}
OTHER_ROWS = 75_000
ON_TEXTS = ["clean_text", "tag_disasters", "tag_places", "lexicon_polarity", "preprocess_text", "extract_entities"]

HEADLINE = [
    "crisis_counts", "merge_counts", "running_mean_fold", "offline_counts", "map_markers", "kpi_stats",
    "dedup_first", "clean_text", "tag_disasters", "tag_places", "lexicon_polarity", "preprocess_text",
    "place_lookup_exact", "place_lookup_cascade", "place_lookup_fuzzy", "standardize_places",
    "resolve_author", "filter_creates", "extraction_scores", "extract_entities", "filtered_posts",
    "stream_crisis_counts",
]


def run(spark, sf: str, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def split_tables(spark, sf: str) -> str:
    """The tables in several files each, below the scratch folder."""
    root = scratch_path(spark, "bench")
    for path in sorted(os.listdir(sf)):
        name, kind = os.path.splitext(path)
        if kind == ".parquet":
            table = spark.read.parquet(f"{sf}/{path}")
            files = -(-table.count() // FILE_ROWS.get(name, OTHER_ROWS))
            table.repartition(max(1, files)).write.parquet(f"{root}/{path}")
    return root


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus)
    split = split_tables(spark, sf)
    times, given = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, split, name)
        times[name] = round(statistics.median(run(spark, split, name) for _ in range(repeats)), 3)
        if name in ON_TEXTS:
            given[name] = round(run(spark, sf, name), 3)
        drop_scratch(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    line = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf, "as_given": given}
    if "stream_crisis_counts" in times:
        rows = spark.read.parquet(f"{split}/orders.parquet").count()
        line["stream_rows_per_sec"] = round(rows / times["stream_crisis_counts"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
