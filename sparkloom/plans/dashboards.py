"""Dashboard reports. Nations stand for workspaces, customers for agents, orders for conversations and jobs, line items for pages of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import web
from .registry import Registry, Tables
from .relational import half_up, percent

R = Registry()
WEEK = "2024-01-23 00:00:00"


@R.add("""
SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23 00:00:00') AS BIGINT) AS week, CAST(count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-23 00:00:00') AS BIGINT) AS visitors,
       CAST(CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'error')) > 0 THEN floor(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*) FILTER (WHERE event_type IN ('purchase', 'error')) + 0.5) ELSE 0 END AS BIGINT) AS resolution,
       CAST(coalesce(floor(avg(value) FILTER (WHERE event_type = 'purchase') + 0.5), 0) AS BIGINT) AS latency
FROM events
""")
def home_stats(t: Tables) -> DataFrame:
    new, kind = F.col("ts") >= F.lit(WEEK).cast("timestamp_ntz"), F.col("event_type")
    return t("events").agg(
        F.count("*").alias("events"), F.count_if(new).alias("week"), F.countDistinct(F.when(new, F.col("user_id"))).alias("visitors"),
        percent(F.count_if(kind == "purchase"), F.count_if(kind.isin("purchase", "error"))).alias("resolution"), F.coalesce(half_up(F.avg(F.when(kind == "purchase", F.col("value")))), F.lit(0)).cast("long").alias("latency"),
    )


@R.add("""
WITH o AS (SELECT o_custkey, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1), s AS (SELECT s_nationkey, count(*) AS sources FROM supplier GROUP BY 1)
SELECT c_custkey, c_name, CAST(coalesce(sources, 0) AS BIGINT) AS sources, CAST(coalesce(jobs, 0) AS BIGINT) AS jobs, CAST(coalesce(open, 0) AS BIGINT) AS open
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey
""")
def agents_with_counts(t: Tables) -> DataFrame:
    jobs = t("orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    sources = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("sources"))
    rows = t("customer").join(jobs, F.col("o_custkey") == F.col("c_custkey"), "left").join(sources, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", "c_name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sources", "jobs", "open")))


@R.add("""
WITH n AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)
SELECT c_custkey, o_orderkey AS newest, o_orderstatus AS status, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS pages FROM customer LEFT JOIN n ON o_custkey = c_custkey
""")
def newest_jobs(t: Tables) -> DataFrame:
    newest = t("orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("newest"), F.col("x.o_orderstatus").alias("status"))
    pages = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"))
    rows = t("customer").join(newest, F.col("o_custkey") == F.col("c_custkey"), "left").join(pages, F.col("l_orderkey") == F.col("newest"), "left")
    return rows.select("c_custkey", "newest", "status", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))


@R.add("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS indexed, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS unchanged, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS failed,
       string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS problems,
       CAST(least(100, floor(60.0 * count(*) FILTER (WHERE l_linestatus = 'F') / count(*) + 32.0 * count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) + 0.5)) AS BIGINT) AS progress
FROM lineitem GROUP BY l_orderkey
""")
def job_details(t: Tables) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.count("*")
    problems = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag == "R", F.col("l_linenumber")))), lambda x: x.cast("string")), ",")
    progress = F.least(F.lit(100), half_up(60.0 * F.count_if(F.col("l_linestatus") == "F") / n + 32.0 * F.count_if(flag != "R") / n))
    rows = t("lineitem").groupBy("l_orderkey").agg(n.alias("pages"), F.count_if(flag == "A").alias("indexed"), F.count_if(flag == "N").alias("unchanged"), F.count_if(flag == "R").alias("failed"), problems.alias("problems"), progress.alias("progress"))
    return rows.withColumn("problems", F.nullif("problems", F.lit("")))


#: The progress at which crawling, parsing a file and embedding end.
CRAWLED, PARSED, EMBEDDED = 60, 25, 92


def part_done(done: Column, of: Column, start: int, end: int) -> Column:
    """Progress of a phase that goes from start to end as done goes from 0 to of."""
    of = F.greatest(F.lit(1), of)
    return start + half_up(F.least(done, of) / of * (end - start))


@R.add(f"""
WITH s AS (SELECT l_orderkey AS job, l_linenumber AS step, l_linenumber * 3 AS done, greatest(1, least(CAST(l_quantity AS INT), 40)) AS target, count(*) OVER (PARTITION BY l_orderkey) AS steps FROM lineitem)
SELECT job, step, CAST(max(floor(CAST(least(done, target) AS DOUBLE) / target * {CRAWLED} + 0.5)) OVER (PARTITION BY job ORDER BY step) AS BIGINT) AS crawled,
  CAST(floor(CAST(step AS DOUBLE) / greatest(step, steps) * {PARSED} + 0.5) AS BIGINT) AS parsed, CAST({PARSED} + floor(CAST(step AS DOUBLE) / greatest(step, steps) * {EMBEDDED - PARSED} + 0.5) AS BIGINT) AS embedded FROM s
""")
def job_progress(t: Tables) -> DataFrame:
    """Progress at each step of a job: a crawl's never falls, though its target grows as pages are found; a file's goes by phase."""
    job = Window.partitionBy("l_orderkey")
    target = F.least(F.col("l_quantity").cast("int"), F.lit(40))
    crawled = F.max(part_done(F.col("l_linenumber") * 3, target, 0, CRAWLED)).over(job.orderBy("l_linenumber"))
    step, steps = F.col("l_linenumber"), F.greatest(F.col("l_linenumber"), F.count("*").over(job))
    return t("lineitem").select(
        F.col("l_orderkey").alias("job"), step.alias("step"), crawled.cast("long").alias("crawled"),
        part_done(step, steps, 0, PARSED).cast("long").alias("parsed"), part_done(step, steps, PARSED, EMBEDDED).cast("long").alias("embedded"),
    )


@R.add("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS tickets, CAST(count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS BIGINT) AS urgent, max(o_orderdate) AS newest FROM orders GROUP BY ALL
""")
def ticket_counts(t: Tables) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("tickets"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"), F.max("o_orderdate").alias("newest"))


@R.add("SELECT p_name, CAST(count(*) AS BIGINT) AS uploads FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 10 = 0) AND p_partkey % 10 <> 0 GROUP BY p_name")
def upload_preflight(t: Tables) -> DataFrame:
    part = t("part")
    return part.where("p_partkey % 10 <> 0").join(part.where("p_partkey % 10 = 0").select("p_name"), "p_name", "left_semi").groupBy("p_name").agg(F.count("*").alias("uploads"))


@R.add("""
SELECT o_orderkey, 'queued' AS status, CAST(0 AS BIGINT) AS attempts FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 500
""")
def retry_failed(t: Tables) -> DataFrame:
    rows = t("orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500)
    return rows.select("o_orderkey", F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempts"))


@R.add("""
SELECT user_id, event_type, CAST(use_count AS BIGINT) AS use_count, CAST(rank() OVER (PARTITION BY event_type ORDER BY use_count DESC) AS INT) AS place FROM (SELECT user_id, event_type, count(*) AS use_count FROM events GROUP BY ALL)
""")
def use_counts(t: Tables) -> DataFrame:
    rows = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("use_count"))
    return rows.withColumn("place", F.rank().over(Window.partitionBy("event_type").orderBy(F.desc("use_count"))))


@R.add("""
WITH m AS (SELECT c_nationkey, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS members, c_acctbal < 0 AS idle FROM customer)
SELECT c_nationkey AS workspace, CAST(count(*) FILTER (WHERE idle) AS BIGINT) AS idle, CAST(any_value(members) AS BIGINT) AS members, count(*) FILTER (WHERE idle) = any_value(members) AS deleted FROM m GROUP BY c_nationkey
""")
def workspace_retention(t: Tables) -> DataFrame:
    idle = F.count_if(F.col("c_acctbal") < 0)
    return t("customer").groupBy(F.col("c_nationkey").alias("workspace")).agg(idle.alias("idle"), F.count("*").alias("members"), (idle == F.count("*")).alias("deleted"))


@R.add("""
SELECT o_orderkey AS ticket, o_orderpriority AS priority, o_orderstatus AS status, c_name AS requester, n_name AS workspace, o_orderdate AS updated, o_orderstatus <> 'F' AS open, o_orderstatus <> 'F' AND o_orderpriority LIKE '1%' AS urgent
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200
""")
def ticket_list(t: Tables) -> DataFrame:
    """The newest tickets with who asked and where; the newest are chosen before anything is joined."""
    newest = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    rows = newest.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # nations are a fixed few
    open_ = F.col("o_orderstatus") != "F"
    return rows.select(
        F.col("o_orderkey").alias("ticket"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("requester"), F.col("n_name").alias("workspace"),
        F.col("o_orderdate").alias("updated"), open_.alias("open"), (open_ & F.col("o_orderpriority").like("1%")).alias("urgent"),
    )


@R.add("""
WITH l AS (SELECT user_id, count(*) AS visits, max(ts) AS last_seen, count(*) FILTER (event_type = 'purchase') AS actions FROM events GROUP BY user_id)
SELECT c_custkey AS lead, c_name AS name, CAST(visits AS BIGINT) AS visits, last_seen, CAST(actions AS BIGINT) AS actions FROM l JOIN customer ON c_custkey = user_id ORDER BY last_seen DESC, c_custkey LIMIT 200
""")
def lead_list(t: Tables) -> DataFrame:
    """The leads seen last, with their visits and actions."""
    seen = t("events").groupBy("user_id").agg(F.count("*").alias("visits"), F.max("ts").alias("last_seen"), F.count_if(F.col("event_type") == "purchase").alias("actions"))
    rows = seen.join(t("customer"), F.col("c_custkey") == F.col("user_id")).orderBy(F.desc("last_seen"), "c_custkey").limit(200)
    return rows.select(F.col("c_custkey").alias("lead"), F.col("c_name").alias("name"), "visits", "last_seen", "actions")


@R.add("SELECT event_id, user_id, event_type AS action, value, ts FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id LIMIT 200")
def action_list(t: Tables) -> DataFrame:
    rows = t("events").where(F.col("event_type").isin("purchase", "error")).orderBy(F.desc("ts"), "event_id").limit(200)
    return rows.select("event_id", "user_id", F.col("event_type").alias("action"), "value", "ts")


TIMES_NOW = "2024-01-30 12:00:00"


@R.add(f"""
WITH e AS (SELECT event_id, ts, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{TIMES_NOW}')) / 1e6 + 0.5) AS BIGINT) AS s FROM events),
u AS (SELECT *, CASE {' '.join(f"WHEN abs(s) >= {size} THEN '{unit}'" for unit, size, _, _ in web.UNITS)} END AS unit, CASE {' '.join(f"WHEN abs(s) >= {size} THEN CAST(floor(s / {size} + 0.5) AS BIGINT)" for _, size, _, _ in web.UNITS)} END AS n FROM e)
SELECT event_id, CASE WHEN unit IS NULL THEN 'just now' {' '.join(f"WHEN unit = '{unit}' AND n = -1 THEN '{gone}' WHEN unit = '{unit}' AND n = 1 THEN '{coming}'" for unit, _, gone, coming in web.UNITS)} WHEN n < 0 THEN -n || ' ' || unit || 's ago' ELSE 'in ' || n || ' ' || unit || 's' END AS ago,
  CASE WHEN CAST(ts AS DATE) = DATE '{TIMES_NOW[:10]}' THEN strftime(ts, '%H:%M') WHEN CAST(ts AS DATE) = DATE '{TIMES_NOW[:10]}' - 1 THEN 'Yesterday ' || strftime(ts, '%H:%M')
    ELSE day(ts) || ' ' || strftime(ts, '%b') || CASE WHEN year(ts) = {TIMES_NOW[:4]} THEN '' ELSE ' ' || year(ts) END || ' ' || strftime(ts, '%H:%M') END AS label FROM u
""")
def message_labels(t: Tables) -> DataFrame:
    """How long ago each event was, and the time that a message of it shows."""
    now = F.lit(TIMES_NOW).cast("timestamp")
    return t("events").select("event_id", web.relative_time(F.col("ts"), now).alias("ago"), web.message_time(F.col("ts").cast("timestamp"), now).alias("label"))
