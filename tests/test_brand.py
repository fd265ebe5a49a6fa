"""Brands, accents, times and sound."""

import io
import wave

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import web as w

URL = "https://www.h.example/a/b"


BRANDS = [
    ("""<meta property="og:site_name" content=" The Site "><title>A | B</title><img alt=x src=/x.png><img class="site-logo" src="../l.png"><link rel="icon" href="/f.ico"><link rel="apple-touch-icon" href="/t.png">""", ("The Site", "https://www.h.example/l.png", "https://www.h.example/t.png")),
    ("""<title>Acme - Home</title><img id=brandMark data-src="//cdn.example/b.png"><link rel="shortcut icon" href="/f.ico"><link rel="icon" type="image/svg+xml" href="i">""", ("Acme", "https://cdn.example/b.png", "https://www.h.example/a/i")),
    ("""<img alt="Our Logo" srcset="s1.png 1x, s2.png 2x"><link rel=icon href=a.ico><link rel=icon href=b.svg>""", ("h.example", "https://www.h.example/a/s1.png", "https://www.h.example/a/b.svg")),
    ("", ("h.example", None, "https://www.h.example/favicon.ico")),
    ("""<title>T</title><img class=logo src="data:image/png;base64,x"><link rel=iconic href=no>""", ("T", None, "https://www.h.example/favicon.ico")),
]


def test_brands(spark):
    rows = w.brands(spark.createDataFrame([(k, URL, h) for k, (h, _) in enumerate(BRANDS)], "page_id int, url string, html string"))
    assert [(r.name, r.logo, r.icon) for r in rows.orderBy("page_id").collect()] == [x for _, x in BRANDS]


def plain_accent(color):
    digits = color.strip().lstrip("#")
    digits = "".join(2 * c for c in digits) if len(digits) == 3 else digits
    try:
        rgb = [int(digits[k : k + 2], 16) for k in (0, 2, 4)] if len(digits) == 6 else None
    except ValueError:
        rgb = None
    light = lambda c: sum(k * (x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4) for k, x in zip((0.2126, 0.7152, 0.0722), c))
    if rgb is None:
        return "#0f1f16", "#ffffff"
    ground = "#0f1f16" if light(rgb) > 0.55 else "#ffffff"
    for k in range(12):
        now = [int(x * 0.8**k + 0.5) for x in rgb]
        if light(now) <= 0.32:
            return "#" + "".join(f"{x:02x}" for x in now), ground
    return "#0f1f16", ground


def test_accents(spark):
    colors = ["#fff", "#ffffff", "#000", "#177e51", "abc", "#FFD700", " #00ffcc ", "#12345", "red", "", "#7f7f7f", "#9a9a9a"] + [f"#{k * 1118481 % 0xFFFFFF:06x}" for k in range(1, 40)]
    rows = spark.createDataFrame([(c,) for c in colors], "c string").select("c", w.accent(F.col("c")).alias("a"), w.text_on(F.col("c")).alias("t")).collect()
    assert [(r.a, r.t) for r in rows] == [plain_accent(c) for c in colors]


def test_times(spark):
    now = "2024-03-10 12:00:00"
    cases = {
        "2024-03-10 11:59:31": ("just now", "11:59"), "2024-03-10 11:59:00": ("1 minute ago", "11:59"), "2024-03-10 12:02:30": ("in 3 minutes", "12:02"), "2024-03-10 09:30:00": ("2 hours ago", "09:30"),
        "2024-03-09 12:00:00": ("yesterday", "Yesterday 12:00"), "2024-03-08 00:05:00": ("2 days ago", "8 Mar 00:05"), "2024-03-01 12:00:00": ("last week", "1 Mar 12:00"), "2024-02-08 12:00:00": ("last month", "8 Feb 12:00"),
        "2022-03-10 12:00:00": ("2 years ago", "10 Mar 2022 12:00"), "2025-03-11 12:00:00": ("next year", "11 Mar 2025 12:00"), "2024-03-11 13:00:00": ("tomorrow", "11 Mar 13:00"), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "k string").withColumn("at", F.col("k").cast("timestamp"))
    got = rows.select("k", w.relative_time(F.col("at"), F.lit(now).cast("timestamp")).alias("r"), w.message_time(F.col("at"), F.lit(now).cast("timestamp")).alias("m")).collect()
    assert {r.k: (r.r, r.m) for r in got} == cases


def test_sound(spark):
    samples = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -3.0, 0.00002]
    row = spark.createDataFrame([(samples * 1000,)], "s array<double>").withColumn("pcm", w.pcm_of(F.col("s"))).select("pcm", w.wav(F.col("pcm"), 8000).alias("wav"), w.pcm_millis(F.col("pcm"), 8000).alias("ms"), w.pcm_rms(F.col("pcm")).alias("rms")).first()
    whole = [0, 16383, -16384, 32767, -32768, 32767, -32768, 0]
    assert bytes(row.pcm) == b"".join(x.to_bytes(2, "little", signed=True) for x in whole * 1000) and row.ms == 1000
    with wave.open(io.BytesIO(bytes(row.wav))) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(10_000)) == (1, 2, 8000, bytes(row.pcm))
    assert row.rms == pytest.approx((sum((x / 32768) ** 2 for x in whole) / len(whole)) ** 0.5)
