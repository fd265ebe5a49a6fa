"""Index snapshots, sources and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import index
from sparkloom.plans.activity import limit_rate as batch_rate
from sparkloom.sources import crawl, uploads
from sparkloom.streaming import events as s

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_index(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "id long, v string, seq long")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2), (None, "m", 2)], "id long, v string, seq long")
    once = index.upsert(table, changes, ["id"], ["seq"])
    assert rows(once) == [(1, "a", 1), (2, "d", 3), (3, "e", 2), (None, "m", 2)]
    assert rows(index.upsert(once, changes, ["id"], ["seq"])) == rows(once)
    assert rows(index.replace(table.where("id > 0"), changes.where("id = 2"), ["id"])) == [(1, "a", 1), (2, "c", 2), (2, "d", 3)]
    assert rows(index.sweep(table, changes, key="id")) == [(2, "b", 1)]
    gone = spark.createDataFrame([(1,)], "id long")
    assert rows(index.cascade(table, gone, "id")) == [(2, "b", 1), (None, "n", 1)]
    assert rows(index.cascade(table, gone, "id", null=True)) == [(2, "b", 1), (None, "a", 1), (None, "n", 1)]
    known = spark.createDataFrame([("b",)], "v string").select(F.sha2("v", 256).alias("hash"))
    assert [r.id for r in index.new_texts(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, v string"), known, "v", "id").collect()] == [1]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,Title,Summary,Permalink\n1,One,"two\nlines, ""quoted""",https://x.y/1#top\n,,,\n2,Two,,https://x.y/2\n')
    got = uploads.csv_records(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [(r.title, r.url, r.content) for r in got] == [("One", "https://x.y/1", 'id: 1\nTitle: One\nSummary: two\nlines, "quoted"\nPermalink: https://x.y/1#top'), ("Two", "https://x.y/2", "id: 2\nTitle: Two\nPermalink: https://x.y/2")]
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="Products" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si><si><t>Price</t></si><si><t>Blue widget</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    r = uploads.sheet_records(spark, str(tmp_path / "b.xlsx")).first()
    assert (r.sheet, r["row"], r.content) == ("Products", 2, "Name: Blue widget\nPrice: 5")
    names = spark.createDataFrame([("a.CSV",), ("b.md",), ("c",), ("d.exe",)], "n string")
    assert [x.k for x in names.select(uploads.kind(F.col("n")).alias("k")).collect()] == ["csv", "text", None, None]
    assert spark.createDataFrame([("inter-\nnational lines\nwrap. New\nLine",)], "t string").select(uploads.pdf_text(F.col("t"))).first()[0] == "international lines wrap. New\nLine"


def test_crawl(spark):
    text = "User-agent: other\nDisallow: /x\nUser-agent: *\nDisallow: /admin # no\nDisallow:\nCrawl-delay: 90"
    r = spark.createDataFrame([(text,)], "t string").select(crawl.robots(F.col("t"), "loombot").alias("r")).first().r
    assert (r.disallow, r.delay) == (["/admin"], 30.0)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "y")], "page string, link string")
    assert rows(crawl.reachable(links, spark.createDataFrame([("a",)], "url string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]
    paths = spark.createDataFrame([("/docs/a",), ("/docs/private",), ("/x",)], "p string")
    assert [x[0] for x in paths.where(crawl.allowed(F.col("p"), ["/docs"], ["/docs/private"])).collect()] == ["/docs/a"]
    assert spark.createDataFrame([("<loc> u1 </loc><loc>u2</loc>",)], "t string").select(crawl.sitemap_urls(F.col("t"))).first()[0] == ["u1", "u2"]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """Events as a file stream of one batch, with an event far ahead so that every window closes."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(e.schema).parquet(path), e


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, stream):
    live, e = stream
    want = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert rows(run(s.windowed_counts(live, "1 day"), "windows", "complete").select("start", "event_type", "n")) == rows(want)
    assert rows(run(s.last_seen(live), "seen", "complete")) == rows(e.groupBy("user_id").agg(F.max("ts").alias("seen")))
    assert rows(run(s.limit_rate(live, 2, 3600), "rate", "append")) == rows(batch_rate(e, "user_id", 2, 3600))
    gone = run(s.sessions(live, "30 minutes"), "sessions", "append")
    every = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    assert gone.count() > 0 and gone.exceptAll(every).count() == 0


def test_speech(spark):
    frames = [(c, k, 0.3 if 20 <= k < 80 and c else 0.001) for c in (0, 1) for k in range(200)] + [(2, 0, None)]
    got = s.speech_events(spark.createDataFrame(frames, "call_id long, frame long, rms double"))
    assert rows(got) == [(1, 117, "speech_end"), (1, 24, "speech_start")]


def test_speech_floor():
    """A cut starts the floor anew from the noise, which is then no speech; quiet frames never take it below its least value."""
    d = s.EnergyDetector(most=50)
    assert [d.push(0.2) for _ in range(55)].index("speech_end") == 54 and d.floor == pytest.approx(0.18)
    assert not any(d.push(0.2) for _ in range(20)) and not any(d.push(0.0) for _ in range(500)) and d.floor == 0.004


def test_speech_chunks(spark):
    said = lambda *parts: [r.chunk for r in s.speech_chunks(spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)], "call_id long, at long, part string")).orderBy("n").collect()]
    assert said("Hello there. ") == ["Hello there."]
    assert said("Contact Dr. ", None, "Smith about the refund policy today. ") == ["Contact Dr. Smith about the refund policy today."]
    assert said("All done. ", "One more thing") == ["All done.", "One more thing"] and said("", None, "  ") == []
    long = said("word " * 40 + "x" * 300)
    assert len(long[0]) <= 60 and all(len(c) <= 240 for c in long) and "".join(long).replace(" ", "") == "word" * 40 + "x" * 300
    two = spark.createDataFrame([(c, k, w) for c in (1, 2) for k, w in enumerate(["Yes. ", f"Call {c}"])], "call_id long, at long, part string")
    assert rows(s.speech_chunks(two)) == [(1, 1, "Yes."), (1, 2, "Call 1"), (2, 1, "Yes."), (2, 2, "Call 2")]


def test_sitemaps(spark):
    loc = lambda *urls: "".join(f"<url><LOC> {u} </LOC></url>" for u in urls)
    fetched = [
        ("https://a.com/sitemap.xml", "<sitemapindex>" + loc("https://a.com/one", "https://b.com/map.xml", "https://a.com/sitemap.xml") + "</sitemapindex>"),
        ("https://a.com/one", loc("https://a.com/x?a=1&amp;b=2", "https://a.com/more.xml.gz?v=1", "https://b.com/y", "https://a.com/z", "https://a.com/z")),
        ("https://a.com/more.xml.gz?v=1", loc("https://a.com/deep")),
        ("https://b.com/map.xml", loc("https://a.com/never")),
    ]
    table, roots = spark.createDataFrame(fetched, "url string, xml string"), spark.createDataFrame([("https://a.com/start",)], "root string")
    assert [r.url for r in crawl.sitemap_pages(table, roots).orderBy("url").collect()] == ["https://a.com/deep", "https://a.com/x?a=1&b=2", "https://a.com/z"]
    assert crawl.sitemap_pages(table, roots, 2).count() == 0 and crawl.sitemap_pages(table, roots.limit(0)).count() == 0
