"""Business hours, availability, liveness and retries as Column builders. Instants are local (zone-less) times of the schedule's zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How long operators, holders of jobs and silent holders count as present, and between scans, in seconds.
PRESENCE, HEARTBEAT, SILENT, SCAN = 90, 30, 300, 15

Hours = dict[int, list[tuple[int, int]]]  # ranges of minutes by day from 0, Sunday


def _ranges(hours: Hours) -> Column:
    return F.array(*(F.struct(F.lit(d).alias("day"), F.lit(a).alias("start"), F.lit(b).alias("end")) for d, ranges in sorted(hours.items()) for a, b in ranges))


def next_opening(ts: Column, hours: Hours) -> Column:
    """The next instant, within seven days, at which a range begins, or ts within one; null without ranges."""
    if not any(hours.values()):
        return F.lit(None).cast("timestamp_ntz")
    midnight = F.date_trunc("DAY", ts).cast("timestamp_ntz")
    ahead = lambda r: F.pmod(r["day"] - (F.dayofweek(ts) - 1), F.lit(7))
    at = lambda r, days: midnight + F.make_dt_interval(days, F.lit(0), r["start"], F.lit(0).cast("decimal(18,6)"))
    starts = F.concat(F.transform(_ranges(hours), lambda r: at(r, ahead(r))), F.transform(_ranges(hours), lambda r: at(r, ahead(r) + 7)))
    first = F.array_min(F.filter(starts, lambda s: s > ts))
    return F.when(is_open(ts, hours), ts).otherwise(first)


def is_open(ts: Column, hours: Hours) -> Column:
    minute, day = F.hour(ts) * 60 + F.minute(ts), F.dayofweek(ts) - 1
    return F.exists(_ranges(hours), lambda r: (r["day"] == day) & (minute >= r["start"]) & (minute < r["end"])) if any(hours.values()) else F.lit(False)


def availability(ts: Column, seen: Column, hours: Hours) -> Column:
    """live, outside_hours, nobody_available or not_configured."""
    if not any(hours.values()):
        return F.lit("not_configured")
    present = F.coalesce(F.timestamp_diff("SECOND", seen, ts) < PRESENCE, F.lit(False))
    return F.when(~is_open(ts, hours), "outside_hours").when(present, "live").otherwise("nobody_available")


def until_reclaim(since_beat: Column, since_lock: Column) -> Column:
    """Seconds until a job whose holder was heard of, or which was locked, so many seconds ago may be taken over."""
    grace = F.when(since_beat.isNotNull(), HEARTBEAT).otherwise(SILENT)
    since = F.coalesce(since_beat, since_lock)
    return F.when(since <= 0, grace + SCAN).otherwise(F.greatest(F.lit(0), grace + SCAN - F.coalesce(since, F.lit(1 << 30))))


def backoff(attempt: Column) -> Column:
    """Seconds before a retry: doubling from two, sixty at most."""
    return F.least(F.lit(60), F.pow(F.lit(2.0), attempt).cast("int") * 2)
