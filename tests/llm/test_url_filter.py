import numpy as np
import xxhash

from sparkloom.llm import url_filter as u
from sparkloom.llm.queries import URL_RULES

URLS = [
    None, "", "nothing", "http://A.Example.COM/en/7/x?q=/en/7#f", "http://a.example.com/en/8", "https://xexample.com/en/7", "http://com/en/", "http://example.net/de/81", "http://example.net/de/", "http://sub.org#frag/es/",
    "http://sub.org/es/", "://", "x://host", "http://host?x=://y/en/", "http://ÉX.com/en/é", "http://.com/en/", "ftp://m.example.com./en/7", "http://b.com\n/en/", "http://org/es/" + "p" * 50_000, "http://u@p.example.com:80/en/7",
]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for stop in "?#":
            rest = rest.split(stop)[0]
        host, path = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_judge(spark):
    rows = [(k, url, "clash") for k, url in enumerate(URLS)]
    frame = spark.createDataFrame(rows + rows[:3], "page_id long, url string, host string")
    for rules in (URL_RULES, [], [("com", "", "block"), ("b.com", "/e", "allow"), ("é", "/", "block")]):
        want = sorted([(k, *brute(url, rules)) for k, url in enumerate(URLS)] + [(k, *brute(URLS[k], rules)) for k in range(3)], key=str)
        assert sorted(map(tuple, u.judge(frame, rules).collect()), key=str) == want
        if rules:
            assert sorted(map(tuple, u.judge_by_join(frame.select("page_id", "url"), rules).collect()), key=str) == want
    assert u.judge(frame.limit(0), URL_RULES).count() == 0


def test_both_ways_agree(spark, monkeypatch):
    """Repeated rules, tables of rules, and rows in any order: the mapped file and the join give the same verdicts."""
    rules = [("a.com", "/", "block"), ("a.com", "/", "allow"), ("b.a.com", "/x", "allow"), ("b.a.com", "/x", "block"), ("c.com", "", "block")]
    urls = [f"http://{h}/{p}" for h in ("a.com", "b.a.com", "c.com", "d.com") for p in ("", "x", "xy", "y")] * 3 + [None, "none"]
    frame = spark.createDataFrame([(k % 7, url) for k, url in enumerate(urls)], "page_id long, url string").repartition(5)
    mapped = sorted(map(tuple, u.judge(frame, rules).collect()), key=str)
    assert {r[4] for r in mapped if r[1] == "a.com"} == {"allow"} and {r[4] for r in mapped if r[1] == "b.a.com" and r[2].startswith("/x")} == {"block"}
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "n long, host string, path string, verdict string").repartition(3)
    assert sorted(map(tuple, u.judge(frame, table).collect()), key=str) == mapped
    monkeypatch.setattr(u, "MAX_MAPPED", 0)
    assert sorted(map(tuple, u.judge(frame, rules).collect()), key=str) == mapped


def test_collision(tmp_path, monkeypatch):
    """Two rules of one digest are told apart by their strings."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 7)
    array = u.RuleArray(u.write_rules([("a.com", "/x", "block"), ("b.com", "/x", "allow")]))
    assert [array.string(k) for k in array.find(["b.com/x", "a.com/x"], [5, 5])] == ["b.com/x", "a.com/x"]
    assert array.find(["c.com/x"], [5]) == [-1]
    assert np.all(np.diff(array.digests.astype(object)) >= 0)
