"""Times the headline queries and prints one JSON line; the median of three runs after a warm-up.

``python bench.py duckdb`` times the SQL equivalents in DuckDB on the same files and threads.
"""

import json
import os
import statistics
import sys
import threading
import time

from lodeworks.plans import registry

HEADLINE = [
    "works_popularity_page",
    "items_filtered_page",
    "category_facets",
    "tag_facets",
    "sites_by_works",
    "people_by_works",
    "coverage_stats",
    "candidates_to_match",
    "latest_reusable",
    "overlap_scores",
    "decide_match",
    "cooldown_islands",
    "upsert_latest",
    "lineage_root_score",
    "tokenise_documents",
    "page_parse",
]
LIMIT = 60
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def timed(run) -> float:
    """Median seconds of three runs after one that doesn't count; a first run of over half a minute counts alone."""
    runs = []
    for _ in range(4):
        began = time.perf_counter()
        run()
        runs.append(time.perf_counter() - began)
        if runs[0] > 30:
            return round(runs[0], 4)
    return round(statistics.median(runs[1:]), 4)


def with_spark(cpus: str, sf_dir: str) -> dict[str, float]:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return {name: timed(lambda name=name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}


def with_duckdb(cpus: str, sf_dir: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": int(cpus)})
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")

    def run(name: str) -> None:
        """A query that is stopped after LIMIT seconds, which then count."""
        stop = threading.Timer(LIMIT, con.interrupt)
        stop.start()
        try:
            con.execute(registry.ORACLES[name]).to_arrow_table()
        except duckdb.InterruptException:
            pass
        finally:
            stop.cancel()

    return {name: timed(lambda name=name: run(name)) for name in HEADLINE}


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    duck = sys.argv[1:] == ["duckdb"]
    took = (with_duckdb if duck else with_spark)(cpus, sf_dir)
    metric = "duckdb_query_seconds" if duck else "headline_query_seconds"
    print(json.dumps({"metric": metric, "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
