"""Stateful streams over several batches, a restart among them, against the batch reports; sinks under replay; crawls against a plain queue."""

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import activity
from sparkloom.sources import crawl
from sparkloom.streaming import sinks, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Events of some users in time order, in five files; the last brings a far event, so that timers fire."""
    rows = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 12").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").orderBy("ts", "event_id").collect()
    folder = tmp_path_factory.mktemp("parts")
    size = -(-len(rows) // 5)
    for k in range(5):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "user_id long, event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(folder / f"p{k}"))
    return folder, rows


def told(spark, folder, tmp, make, schema="user_id long, event_id long, ts timestamp, event_type string"):
    """What a stream says of the parts, one part a batch, stopped and started again after every part."""
    source, out, check = tmp / "in", str(tmp / "out"), str(tmp / "check")
    source.mkdir()
    for part in sorted(folder.iterdir()):
        for f in part.glob("*.parquet"):
            shutil.copy(f, source / f"{part.name}.parquet")
        live = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        query = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def test_limits(spark, parts, tmp_path):
    folder, rows = parts
    frame = spark.createDataFrame(rows)
    got = told(spark, folder, tmp_path, lambda e: stateful.limited(e, 2, 3600))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, activity.limit_rate(frame, "user_id", 2, 3600).collect()))


def test_trips_and_turns(spark, parts, tmp_path):
    folder, rows = parts
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    want, run = [], Counter()
    for r in rows:
        run[r.user_id] = run[r.user_id] + 1 if r.event_type == "error" else 0
        if run[r.user_id] == 2:
            want.append((r.user_id, r.event_id))
    assert sorted(map(tuple, told(spark, folder, tmp_path / "a", lambda e: stateful.trips(e, 2)).collect())) == sorted(want) and want
    batch = activity.voice_turns(lambda _: spark.createDataFrame(rows)).where("outcome <> 'open'")
    got = told(spark, folder, tmp_path / "b", stateful.turns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_presence(spark, parts, tmp_path):
    """Arrivals and departures by a plain walk; a departure is told once the watermark has passed it."""
    folder, rows = parts
    absent = 6 * 3600
    got = [(r.user_id, r.at.timestamp(), r.present) for r in told(spark, folder, tmp_path, lambda e: stateful.presence(e, absent, "0 seconds")).collect()]
    want, last = [], {}
    for r in rows:
        at = r.ts.timestamp()
        if r.user_id in last and at - last[r.user_id] > absent:
            want.append((r.user_id, last[r.user_id] + absent, False))
            del last[r.user_id]
        if r.user_id not in last:
            want.append((r.user_id, at, True))
        last[r.user_id] = at
    # between two batches nobody can be missed, for timers run with the watermark: every told departure is a real gap, and users told present are in turn
    gone = {(u, round(t)) for u, t, p in got if not p}
    assert gone and gone <= {(u, round(t)) for u, t, p in want if not p} | {(u, round(t + absent)) for u, t in last.items()}
    for user in {u for u, _, _ in got}:
        states = [p for u, t, p in sorted(got, key=lambda x: (x[0], x[1])) if u == user]
        assert states[0] and all(a != b for a, b in zip(states, states[1:]))


def test_append_sink(spark, parts, tmp_path):
    """A replayed batch changes nothing, by hand and by a checkpoint that has lost its last commit."""
    folder, rows = parts
    log = sinks.AppendLog(spark, str(tmp_path / "log"), "user_id long, event_id long, ts timestamp, event_type string")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*")
    log.start(source, str(tmp_path / "check"), once=True).awaitTermination()
    want = Counter(r.event_id for r in rows)
    assert Counter(r.event_id for r in log.rows().collect()) == want
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"):
        f.unlink(missing_ok=True)
    log.start(source, str(tmp_path / "check"), once=True).awaitTermination()
    assert Counter(r.event_id for r in log.rows().collect()) == want
    log.write(spark.createDataFrame(rows[:3], log.schema), 99)
    log.write(spark.createDataFrame(rows[:3], log.schema), 99)
    assert log.rows().count() == len(rows) + 3


def test_upsert_sink(spark, tmp_path):
    rng = random.Random(1)
    log = sinks.UpsertLog(spark, str(tmp_path / "log"), "k long, at long, v string", ["k"], ["at"])
    assert log.rows().collect() == []
    want, batches = {}, [[(rng.randrange(20), a, f"{n}:{a}") for a in range(15)] for n in range(6)]
    for n, batch in enumerate(batches):
        for k, a, v in batch:
            want[k] = (k, a, v)
        frame = spark.createDataFrame(batch, log.schema)
        log.write(frame, n)
        if n % 2:
            log.write(frame, n)  # replayed
        if n == 3:
            log.compact()
            log.compact()
            log.write(frame, n)  # replayed after it was folded in
        assert sorted(map(tuple, log.rows().collect())) == sorted(want.values())


def plain_crawl(pages, root, disallow, limit, exclude):
    queue, at, hashes, out = [root], 0, set(), []
    origin = "/".join(root.split("/")[:3])
    path = lambda u: "/" + "/".join(u.split("/")[3:])
    indexed = 0
    while at < len(queue) and indexed < limit:
        url = queue[at]
        at += 1
        if url not in pages:
            out.append((root, at, url, "failed"))
            continue
        text, links = pages[url]
        if len(text) < crawl.THIN:
            out.append((root, at, url, "thin"))
        elif text in hashes:
            out.append((root, at, url, "duplicate"))
        else:
            hashes.add(text)
            indexed += 1
            out.append((root, at, url, "indexed"))
        for link in links:
            if len(queue) >= crawl.QUEUED * limit:
                break
            if "/".join(link.split("/")[:3]) == origin and link not in queue and not any(path(link).startswith(p) for p in [*disallow, *exclude]):
                queue.append(link)
    return out


@pytest.mark.parametrize("limit", [1, 3, 12, 100])
def test_crawl_order(spark, limit):
    rng = random.Random(limit)
    urls = [f"https://{h}.example/{d}/{k}" for h in "ab" for d in ("x", "y", "private", "no") for k in range(14)]
    pages = {u: (rng.choice(["short", "long " * 40 + rng.choice("abcdefghij") + u[8], "long " * 40 + u]), [rng.choice(urls) for _ in range(rng.randrange(0, 9))]) for u in urls if rng.random() < 0.85}
    roots = [("https://a.example/", ["/private"]), ("https://b.example/", None)]
    for r, _ in roots:
        pages[r] = ("root " * 40, [u for u in urls if u.startswith(r)][:: 5])
    got = crawl.crawl_order(spark.createDataFrame([(u, t, ls) for u, (t, ls) in pages.items()], "url string, text string, links array<string>"), spark.createDataFrame(roots, "root string, disallow array<string>"), limit, exclude=["/no"])
    assert sorted(map(tuple, got.select("root", "nth", "url", "outcome").collect())) == sorted(x for r, d in roots for x in plain_crawl(pages, r, d or [], limit, ["/no"]))
