"""Event streams as tables: runs, windows, limits, presence and retention. Instants that the reports call "now" are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .registry import Registry, Tables

R = Registry()
NOW = "2024-01-30 00:00:00"


@R.add("""
WITH g AS (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
r AS (SELECT user_id, island, count(*) AS run FROM g WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, CAST(max(run) AS BIGINT) AS longest, CAST(count(*) FILTER (WHERE run >= 3) AS BIGINT) AS trips FROM r GROUP BY user_id
""")
def circuit_breaker(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t("events").withColumn("island", F.sum((F.col("event_type") != "error").cast("int")).over(w))
    runs = rows.where("event_type = 'error'").groupBy("user_id", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("user_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") >= 3).alias("trips"))


@R.add("SELECT user_id, max(ts) AS seen, epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(max(ts)) <= 21600 AS alive FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id")
def presence_alive(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = t("events").where(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("seen"))
    age = F.timestamp_diff("MICROSECOND", F.col("seen").cast("timestamp_ntz"), now) / 1e6
    return rows.select("user_id", "seen", (age <= 21600).alias("alive"))


@R.add("""
WITH beat AS (SELECT user_id, max(ts) AS seen FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id)
SELECT o_orderkey, o_custkey, seen FROM orders LEFT JOIN beat ON user_id = o_custkey WHERE o_orderstatus = 'P' AND (seen IS NULL OR seen < TIMESTAMP '2024-01-29 12:00:00')
""")
def stale_jobs(t: Tables) -> DataFrame:
    beat = t("events").where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz")).groupBy("user_id").agg(F.max("ts").alias("seen"))
    rows = t("orders").where("o_orderstatus = 'P'").join(beat, F.col("user_id") == F.col("o_custkey"), "left")
    return rows.where(F.col("seen").isNull() | (F.col("seen") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey", "seen")


@R.add("""
SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-23 00:00:00' + INTERVAL 6 DAY AND count(*) FILTER (WHERE event_type = 'purchase') < 20 ORDER BY seen, user_id LIMIT 500
""")
def retention_preview(t: Tables) -> DataFrame:
    rows = t("events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return rows.where((F.col("seen") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")) & (F.col("bought") < 20)).orderBy("seen", "user_id").limit(500).select("user_id", "seen")


@R.add("""
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_windows(t: Tables) -> DataFrame:
    rows = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add("""
SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS TIMESTAMP) AS start, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY ALL
""")
def sliding_windows(t: Tables) -> DataFrame:
    return t("events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@R.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k
""")
def session_windows(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@R.add("""
SELECT event_id, dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 1020 AS open FROM events
""")
def business_hours_open(t: Tables) -> DataFrame:
    return t("events").select("event_id", open_now(F.col("ts"), {d: [(540, 1020)] for d in range(1, 6)}).alias("open"))


def open_now(ts, hours: dict[int, list[tuple[int, int]]]):
    """Whether a local time lies in the day's ranges of minutes; days count from 0, Sunday."""
    minute, day = F.hour(ts) * 60 + F.minute(ts), F.dayofweek(ts) - 1
    out = F.lit(False)
    for d, ranges in hours.items():
        for start, end in ranges:
            out = out | ((day == d) & (minute >= start) & (minute < end))
    return out


@R.add("""
WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run AS (SELECT user_id, k, ts AS opened, 1 AS used, true AS passed, event_id FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN e.ts >= opened + INTERVAL 1 HOUR THEN e.ts ELSE opened END, CASE WHEN e.ts >= opened + INTERVAL 1 HOUR THEN 1 ELSE used + 1 END,
    e.ts >= opened + INTERVAL 1 HOUR OR used + 1 <= 2, e.event_id FROM run JOIN e ON e.user_id = run.user_id AND e.k = run.k + 1)
SELECT event_id, passed FROM run
""")
def rate_limit(t: Tables) -> DataFrame:
    return limit_rate(t("events"), "user_id", 2, 3600)


def limit_rate(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """event_id and passed: a key's window opens at its first event and lasts some seconds; beyond limit events in it are refused.

    The state is one window for each key. Events come sorted by key and time within partitions, so a key
    with a third of all events streams through its task and is never held whole.
    """
    import pandas as pd

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")

    def run(batches):
        now, opened, used = None, 0, 0
        for b in batches:
            passed = []
            for k, at in zip(b["key"], b["at"]):
                if k != now or at >= opened + seconds * 1_000_000:
                    now, opened, used = k, at, 0
                used += 1
                passed.append(used <= limit)
            yield pd.DataFrame({"event_id": b.event_id, "passed": passed})

    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(run, "event_id long, passed boolean")


#: What the events of a call stand for: a question, the first sound of its answer, the end of the answer, the caller's voice and a failure.
ASKED, SPOKE, DONE, VOICE, FAILED = "click", "view", "purchase", "signup", "error"


@R.add(f"""
WITH o AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN event_type = '{ASKED}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, max(CASE WHEN event_type = '{SPOKE}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, turn ORDER BY n ROWS UNBOUNDED PRECEDING) = 1 AS heard FROM o WHERE turn > 0),
g AS (SELECT user_id, turn, min(event_id) FILTER (WHERE event_type = '{ASKED}') AS question, min(n) FILTER (WHERE event_type = '{SPOKE}') AS spoke, min(n) FILTER (WHERE event_type = '{DONE}') AS done,
  min(n) FILTER (WHERE event_type = '{FAILED}') AS failed, min(n) FILTER (WHERE event_type = '{VOICE}' AND heard) AS barged FROM h GROUP BY ALL),
e AS (SELECT *, least(done, failed, barged) AS ended, max(turn) OVER (PARTITION BY user_id) AS last FROM g)
SELECT user_id, CAST(turn AS BIGINT) AS turn, question, spoke IS NOT NULL AND (ended IS NULL OR spoke < ended) AS audible,
  CASE WHEN ended = done THEN 'answered' WHEN ended = failed THEN 'failed' WHEN ended = barged THEN 'interrupted' WHEN turn < last THEN 'replaced' ELSE 'open' END AS outcome FROM e
""")
def voice_turns(t: Tables) -> DataFrame:
    """Each turn of a call and how it ended: a voice interrupts only an answer that is heard, and a new question replaces whatever goes on."""
    call = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t("events").select("user_id", "event_id", "ts", "event_type").withColumn("n", F.row_number().over(call)).withColumn("turn", F.count_if(F.col("event_type") == ASKED).over(call.rowsBetween(Window.unboundedPreceding, 0)))
    turn = Window.partitionBy("user_id", "turn").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("turn > 0").withColumn("heard", F.count_if(F.col("event_type") == SPOKE).over(turn) > 0)
    first = lambda kind, value="n": F.min(F.when(F.col("event_type") == kind, F.col(value)))
    barged = F.min(F.when((F.col("event_type") == VOICE) & F.col("heard"), F.col("n")))
    turns = rows.groupBy("user_id", "turn").agg(first(ASKED, "event_id").alias("question"), first(SPOKE).alias("spoke"), first(DONE).alias("done"), first(FAILED).alias("failed"), barged.alias("barged"))
    turns = turns.withColumn("ended", F.least("done", "failed", "barged")).withColumn("last", F.max("turn").over(Window.partitionBy("user_id")))
    how = F.when(F.col("ended") == F.col("done"), "answered").when(F.col("ended") == F.col("failed"), "failed").when(F.col("ended") == F.col("barged"), "interrupted").when(F.col("turn") < F.col("last"), "replaced").otherwise("open")
    audible = F.col("spoke").isNotNull() & (F.col("ended").isNull() | (F.col("spoke") < F.col("ended")))
    return turns.select("user_id", "turn", "question", audible.alias("audible"), how.alias("outcome"))
