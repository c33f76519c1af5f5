"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 3, median).
Every run builds its plan anew and writes all result rows to the no-op sink, so planning, size
measurement and full evaluation are all inside the time. ``BENCH_DUCKDB=1`` adds the times of
DuckDB on the equivalent SQL, fetching all rows as Arrow.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from entitlekit.plans.oracle import ORACLE_SQL
from entitlekit.plans.registry import QUERIES

HEADLINE = [
    "eligibility_pairs", "eligibility_pairs_by_state", "eligibility_counts", "faq_best_match",
    "faq_best_match_documents", "scheme_contained_documents", "query_routes", "upload_scores",
    "profile_verification", "identity_scans", "localized_documents", "translation_worklist",
    "replaced_profiles", "name_validity",
]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def median_seconds(action, runs: int) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(cpus)
    timed = {
        name: median_seconds(
            lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save(),
            runs,
        )
        for name in names
    }
    result = {
        "metric": "total of median query times", "value": round(sum(timed.values()), 3),
        "unit": "sec", "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_DUCKDB"):
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {int(cpus)}")
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        result["duckdb"] = {
            name: median_seconds(lambda s=ORACLE_SQL[name]: con.execute(s).fetchall(), 1)
            for name in names
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
