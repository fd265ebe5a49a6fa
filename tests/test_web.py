import datetime as d

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import social as s, support as u, web as w


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("v")).first().v


def test_addresses(spark):
    assert one(spark, w.with_scheme(F.col("t")), " a.b/c") == "https://a.b/c"
    assert one(spark, w.with_scheme(F.col("t")), "http://a") == "http://a"
    for ip, private in [("10.1.2.3", True), ("8.8.8.8", False), ("172.20.0.1", True), ("172.33.0.1", False), ("nonsense", True), ("1.2.3.400", True), ("100.64.0.1", True), ("169.254.1.1", True)]:
        assert one(spark, w.private_ip(F.col("t")), ip) is private, ip
    assert one(spark, w.host_allowed(F.col("t"), ["a.com", "*.b.com"]), "x.B.com") and not one(spark, w.host_allowed(F.col("t"), ["a.com", "*.b.com"]), "x.a.com")
    assert one(spark, w.like_pattern(F.col("t")), "5%_\\") == "%5\\%\\_\\\\%"


def test_times(spark):
    assert one(spark, w.published(F.col("t")), '<meta name="date" content="x"><time datetime="2024-02-03T04:05:06Z">') == d.datetime(2024, 2, 3, 4, 5, 6)
    assert one(spark, w.minutes(F.col("t")), "09:30") == 570 and one(spark, w.minutes(F.col("t")), "25:00") is None
    assert one(spark, w.clock(F.col("t")), 545, "int") == "09:05"
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [one(spark, w.retry_after(F.col("t"), now), h) for h in ("7", "9999", "Mon, 01 Jan 2024 00:00:30 GMT", "soon")] == [7.0, 300.0, 30.0, None]
    week = {1: [(540, 1020)]}
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    assert one(spark, u.next_opening(at("2024-01-01 18:00:00"), week)) == d.datetime(2024, 1, 8, 9)
    assert one(spark, u.next_opening(at("2024-01-01 10:00:00"), week)) == d.datetime(2024, 1, 1, 10)
    assert one(spark, u.next_opening(at("2024-01-01 10:00:00"), {})) is None
    seen = [("2024-01-01 09:59:00", "live"), ("2024-01-01 09:00:00", "nobody_available")]
    assert all(one(spark, u.availability(at("2024-01-01 10:00:00"), at(x), week)) == y for x, y in seen)
    assert one(spark, u.availability(at("2024-01-02 10:00:00"), at("2024-01-02 10:00:00"), week)) == "outside_hours" and one(spark, u.availability(at("2024-01-02 10:00:00"), at("2024-01-02 10:00:00"), {})) == "not_configured"
    assert [one(spark, u.backoff(F.lit(k))) for k in (0, 1, 9)] == [2, 4, 60]
    assert one(spark, u.until_reclaim(F.lit(50), F.lit(None).cast("int"))) == 0 and one(spark, u.until_reclaim(F.lit(None).cast("int"), F.lit(100))) == 215


def test_social(spark):
    for text, kind in [("hi", "greeting"), ("hlo", "greeting"), ("Hi, thanks!", "thanks"), ("buy", None), ("hi, do you have an EML viewer?", None), ("", "greeting"), ("😀", "greeting"), ("ok you are", None), ("thnx bye", "farewell")]:
        assert one(spark, s.small_talk(F.col("t")), text) == kind, text
    assert one(spark, s.with_context(F.col("t"), F.lit("The camera")), "does it zoom?") == "The camera\nFollow-up: does it zoom?"
    assert one(spark, s.with_context(F.col("t"), F.lit("The camera")), "best waterproof tripod bags") == "best waterproof tripod bags"
    assert one(spark, s.clean_transcript(F.col("t")), "[music] (noise) hello") == "hello" and one(spark, s.clean_transcript(F.col("t")), "[blank]") == ""
    assert one(spark, s.speakable(F.col("t")), "See **this** [1, 2] [page](http://x) , at https://y.z/a\n\n- one") == "See this page, at the link on screen\none"


def test_numbers(spark):
    assert one(spark, w.luminance(F.col("t")), "#ffffff") == 1.0 and one(spark, w.luminance(F.col("t")), "#000000") == 0.0
    assert [one(spark, w.byte_label(F.col("t")), n, "long") for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    pcm = (np.array([0.5, -0.5] * 80) * 32768).astype("<i2").tobytes()
    assert abs(one(spark, w.pcm_rms(F.col("t")), pcm, "binary") - 0.5) < 1e-4 and one(spark, w.pcm_rms(F.col("t")), b"", "binary") == 0.0
