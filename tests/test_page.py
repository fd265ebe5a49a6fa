"""Page readings, brand colors, golden sets and the diagnoses."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.page import page_reading, read_page
from sparkloom.plans import answering, diagnosis, support
from sparkloom.sources import golden


def test_cards_come_back():
    cards = "".join(f'<div class="card"><p>{t}</p></div>' for t in ["Total seconds = days times 86400. " * 4, "Decimal conversion of hours. " * 5])
    page = f"<html><head><title>T</title></head><body><nav>Home Blog</nav><main><article><p>{'A base of sixty. ' * 8}</p></article></main><section>{cards}</section><footer>Copyright</footer></body></html>"
    got = read_page(page)
    assert "86400" in got and "Decimal" in got and "sixty" in got
    assert "Home" not in got and "Copyright" not in got


def test_article_is_chosen():
    assert read_page(f"<body><p>Elsewhere</p><article><p>{'Thirty days. ' * 40}</p></article></body>") == ("Thirty days. " * 40).strip()


PROSE = "".join(f"<p>{'The window is thirty days, counted from delivery, and no longer. ' * 3}</p>" for _ in range(4))
SAID = "The window is thirty days"


@pytest.mark.parametrize("html, there, gone", [
    # the paragraphs' parent wins over a list of links beside it, and over a sidebar that says more by name
    (f"<body><div><a href=x>{'Other pages of ours ' * 4}</a></div><div class=content>{PROSE}</div></body>", [SAID], ["Other pages"]),
    (f"<body><div class=content>{PROSE}</div><div class=sidebar><p>{'Follow us, like us, and share us. ' * 5}</p></div></body>", [SAID], ["Follow us"]),
    # paragraphs and scored siblings of the winner belong to it
    (f"<body><div><div class=story>{PROSE}</div><p>A last word stands here, on its own, and it is a long one, so that it counts as a part of it.</p></div></body>", [SAID, "A last word"], []),
    (f"<body><div><div class=story>{PROSE}</div><div class=story>{PROSE.replace('window', 'second window')}</div></div></body>", [SAID, "The second window"], []),
    # cards beside a short article: too much of the page would go, so the whole page is read
    (f"<main><article>{PROSE[:260]}</p></article><section>{''.join(f'<div class=card><b>{k}</b> {chr(65 + k) * 30}</div>' for k in range(20))}</section></main>", [SAID, "T" * 30], []),
    # a name that speaks against the article is forgiven where nothing else is left
    (f"<body><div class=comment-like-footer>{PROSE}</div></body>", [SAID], []),
    # nothing scores
    ("<body><b>Short</b></body>", ["Short"], []),
])
def test_article_by_scores(html, there, gone):
    got = read_page(html)
    assert all(x in got for x in there) and not any(x in got for x in gone)


def test_scores_by_hand():
    """One paragraph of 120 characters and 2 commas is worth 5: whole to its parent, half to the next, a sixth and a ninth beyond."""
    from sparkloom.functions import page

    tree = page._Tree()
    tree.feed("<body><section><main><div id=x><span><p>" + "a" * 118 + ",,</p></span></div></main></section></body>")
    body = next(n for n in page._nodes(tree.root) if n.tag == "body")
    scores = {n.tag: v for n, v in page._Scores(body, True, True).score.items()}
    # the section is a paragraph of its own as well, for the body
    assert scores == pytest.approx({"span": 5, "div": 5 + 2.5, "main": 5 / 6, "section": 5 / 9, "body": 5 / 12 + 5})


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><ul><li>EML<li>MSG</ul>x</body>", "EML\n\nMSG\n\nx"),
        ("<table><tr><th>Format</th><th>Held</th></tr><tr><td>HEIC<td>Yes</table>", "Format | Held\n\nHEIC | Yes"),
        ("<p>One<p>Two<br>Three", "One\n\nTwo\nThree"),
        ("<div><div><div>a</div></div></div><span>b</span>", "a\n\nb"),
        ("<head><meta charset=x><body>text<script>no</script><template>no</template>", "text"),
        ("<h2>A</h2>a<p>b</p><h2>References [edit]</h2><p>c</p><h3>d</h3><h2>E</h2><p>f</p>", "A\na\nb\n\nE\n\nf"),
        ('<p>a<sup class="reference">1</sup></p><div class="navbox x">n</div><div role="navigation">n</div>', "a"),
        ("</p></div>stray</b>", "stray"),
        ("", ""),
    ],
)
def test_blocks(html, text):
    assert read_page(html) == text


def test_readings(spark):
    html = ["<p>A &amp;amp;amp; B&nbsp;\t c</p>\n\n <p> d </p>", None, "", "<b>" * 20000 + "deep"]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r.text for r in rows.select("page_id", page_reading(F.col("html")).alias("text")).collect()}
    assert got == {0: "A &amp; B c\n\nd", 1: "", 2: "", 3: "deep"}


def test_brand_colors(spark):
    pages = [
        (1, '<meta name="theme-color" content="#AbC"><p style="color:#ff0000">'), (2, "#ff0000 #00ff00 #00F000 #0f0 #333333"),
        (3, "#00ff00 #ff0000"), (4, "#333333 #fff"), (5, "none #ff00"), (6, "<meta name='theme-color' content='red'>#102090"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    want = {1: "#aabbcc", 2: "#00ff00", 3: "#00ff00", 4: support.PLAIN_COLOR, 5: support.PLAIN_COLOR, 6: "#102090"}
    assert dict(map(tuple, support.brand_colors(lambda name: frame).collect())) == want
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
        assert dict(con.execute(support.R.sql["brand_colors"]).fetchall()) == want


def test_golden(spark, tmp_path):
    cases = spark.createDataFrame([("a", "Why?", ["c1"], None, None), ("b", "How?", [], ["u"], True)], golden.CASES)
    golden.write_cases(cases, str(tmp_path / "cases"))
    assert sorted(golden.read_cases(spark, str(tmp_path / "cases")).collect()) == sorted(cases.collect())
    (tmp_path / "set.json").write_text('[\n {"id": "a", "question": "Why?",\n "expectedChunkIds": ["c1"]}\n]')
    assert golden.read_cases(spark, str(tmp_path / "set.json"), array=True).collect() == cases.where("id = 'a'").collect()
    report = spark.createDataFrame([(0.5, 0.25)], "recall_1 double, mrr double")
    golden.write_baseline(report, str(tmp_path / "base"))
    base = golden.read_baseline(spark, str(tmp_path / "base"))
    assert base == {"recall_1": 0.5, "mrr": 0.25}
    now = spark.createDataFrame([(0.47, 0.24)], "recall_1 double, mrr double")
    assert {r.metric: r.regressed for r in answering.against(now, base).collect()} == {"recall_1": True, "mrr": False}


def test_verdicts(spark):
    ages = spark.createDataFrame([(None,), (0.0,), (14.9,), (15.0,), (59.0,), (60.0,)], "age double")
    got = [r.v for r in ages.select(diagnosis.verdict(F.col("age")).alias("v")).collect()]
    assert got == ["never started", "alive", "alive", "late", "late", "not running"]
    of = lambda *jobs: diagnosis.crawl_verdict(spark.createDataFrame(jobs, "pages long, events long")).first().diagnosis
    assert (of((3, 0), (2, 2)), of((3, 1), (2, 2)), of((0, 0), (2, 2))) == ("events missing", "recording", "nothing yet")


def test_reading_outcomes(spark):
    long = "<article><p>" + "A long sentence of the page, read as it is. " * 9 + "</p></article>"
    pages = [(1, long), (2, "<nav>x</nav>" + long), (3, "<p>short</p>"), (4, None), (5, long.replace("page", "story"))]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r for r in diagnosis.reading_outcomes(lambda _: frame).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "indexed", 2: "duplicate", 3: "thin", 4: "thin", 5: "indexed"}
    assert got[1].n == len(read_page(long)) and got[4].n == 0


def test_catalog(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    got = {r.name: (r.files, r.bytes) for r in diagnosis.table_bytes(lambda name: spark.read.parquet(f"{folder}/{name}.parquet")).collect()}
    assert got == {name: (1, Path(f"{folder}/{name}.parquet").stat().st_size) for name in got} and len(got) == 14
    assert [tuple(r) for r in diagnosis.tables_there(spark, folder, ["orders", "nothing"]).collect()] == [("orders", True), ("nothing", False)]


def test_text_records(spark, tmp_path):
    from sparkloom.sources import uploads

    (tmp_path / "a.md").write_text("# Title\n\nText of it.")
    rows = uploads.text_records(spark, str(tmp_path / "a.md")).collect()
    assert len(rows) == 1 and "Text of it." in str(rows[0])
