"""Reports that tell why nothing moves: workers, unfinished jobs and crawls without page events; page readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.page import page_reading
from ..sources.crawl import THIN
from .answering import TABLES
from .registry import Registry, Tables

R = Registry()
#: The moment at which the reports look at the tables.
NOW = "2024-01-30 00:00:00"
JOBS_NOW = "1998-08-03 00:00:00"
#: Seconds within which a worker is alive or late, seconds after which a job has stalled, and jobs listed.
ALIVE, LATE, STALLED, OPEN_JOBS, CRAWLS = 15, 60, 120, 20, 5


def verdict(age: Column) -> Column:
    """Of a worker whose last sign is age seconds old; null: no sign at all."""
    return F.when(age.isNull(), "never started").when(age < ALIVE, "alive").when(age < LATE, "late").otherwise("not running")


@R.add(f"""
WITH b AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'click') AS beat FROM events WHERE ts < TIMESTAMP '{NOW}' GROUP BY user_id)
SELECT user_id, CASE WHEN beat IS NULL THEN 'never started' WHEN epoch(TIMESTAMP '{NOW}') - epoch(beat) < {ALIVE} THEN 'alive' WHEN epoch(TIMESTAMP '{NOW}') - epoch(beat) < {LATE} THEN 'late' ELSE 'not running' END AS verdict FROM b
""")
def worker_diagnosis(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    beats = t("events").where(F.col("ts") < now).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("beat"))
    age = F.timestamp_diff("MICROSECOND", F.col("beat").cast("timestamp_ntz"), now) / 1e6
    return beats.select("user_id", verdict(age).alias("verdict"))


@R.add(f"""
SELECT o_orderkey AS job, o_orderstatus AS status, c_name AS source, o_orderdate AS updated, o_orderstatus = 'P' AND date_diff('second', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '{JOBS_NOW}') > {STALLED} AS stalled
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT {OPEN_JOBS}
""")
def unfinished_jobs(t: Tables) -> DataFrame:
    """The newest jobs that are not finished; one that runs without a change for over two minutes has stalled."""
    source = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    rows = t("orders").where(F.col("o_orderstatus").isin("O", "P")).join(source, "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(OPEN_JOBS)
    idle = F.timestamp_diff("SECOND", F.col("o_orderdate").cast("timestamp_ntz"), F.lit(JOBS_NOW).cast("timestamp_ntz"))
    return rows.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), "source", F.col("o_orderdate").alias("updated"), ((F.col("o_orderstatus") == "P") & (idle > STALLED)).alias("stalled"))


def crawl_verdict(jobs: DataFrame) -> DataFrame:
    """One row for the jobs listed, with pages and events of each: whether the events of pages are recorded."""
    lost = F.count_if((F.col("pages") > 0) & (F.col("events") == 0)) > 0
    seen = F.count_if(F.col("events") == 0) == 0
    return jobs.agg(F.count("*").alias("jobs"), F.sum("pages").alias("pages"), F.sum("events").alias("events"), F.when(lost, "events missing").when(seen, "recording").otherwise("nothing yet").alias("diagnosis"))


@R.add(f"""
WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS done FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT {CRAWLS}),
e AS (SELECT job, max(done) * count(*) AS pages, count(*) FILTER (WHERE l_returnflag <> 'A') AS events FROM j LEFT JOIN lineitem ON l_orderkey = job GROUP BY job)
SELECT CAST(count(*) AS BIGINT) AS jobs, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(events) AS BIGINT) AS events,
  CASE WHEN count(*) FILTER (WHERE pages > 0 AND events = 0) > 0 THEN 'events missing' WHEN count(*) FILTER (WHERE events = 0) = 0 THEN 'recording' ELSE 'nothing yet' END AS diagnosis FROM e
""")
def crawl_diagnosis(t: Tables) -> DataFrame:
    newest = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(CRAWLS).select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("done"))
    # five jobs are listed, so their side is small whatever the tables hold
    events = t("lineitem").select(F.col("l_orderkey").alias("job"), "l_returnflag").join(F.broadcast(newest.select("job")), "job", "left_semi")
    rows = newest.join(events, "job", "left").groupBy("job").agg((F.max("done") * F.count("*")).alias("pages"), F.count_if(F.col("l_returnflag") != "A").alias("events"))
    return crawl_verdict(rows)


@R.add()
def page_readings(t: Tables) -> DataFrame:
    """What is indexed of each page; no SQL, for it walks a tree (tests/test_page.py)."""
    return t("pages").select("page_id", page_reading(F.col("html")).alias("text"))


@R.add()
def reading_outcomes(t: Tables) -> DataFrame:
    """n, hash and outcome (thin, duplicate or indexed) of each page by what is read of it; no SQL, for it walks a tree (tests/test_page.py)."""
    rows = t("pages").select("page_id", page_reading(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("hash"))
    # the text is read once more for the first page of each hash; what shuffles are hashes
    first = rows.groupBy("hash").agg(F.min("page_id").alias("first"))
    outcome = F.when(F.col("n") < THIN, "thin").when(F.col("page_id") != F.col("first"), "duplicate").otherwise("indexed")
    return rows.join(first, "hash").select("page_id", "n", "hash", outcome.alias("outcome"))


@R.add()
def table_bytes(t: Tables) -> DataFrame:
    """Files and bytes of each table of the catalog; no SQL, for a table does not show its files there (tests/test_page.py)."""
    out = None
    for name in TABLES:
        files = t(name).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
        rows = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("name"), "files", "bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


def tables_there(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name and there: whether each table has files in a folder of any store that Spark reads; a listing, without data."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for name in names:
        path = hadoop.Path(f"{folder}/{name}.parquet")
        found.append((name, bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))))
    return spark.createDataFrame(found, "name string, there boolean")
