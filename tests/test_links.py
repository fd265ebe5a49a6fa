"""Links and titles of pages against the standard library and plain versions."""

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answer, web as w


def test_resolved(spark):
    """References on a base, as the standard's own examples have them and as the library joins them."""
    base = "http://a.example/b/c/d;p?q"
    given = "g ./g g/ /g //g.example ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y".split() + [""]
    rng = random.Random(2)
    given += ["/".join(rng.choice(["..", ".", "x", "y.z"]) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "/"]) for _ in range(200)]
    rows = [(r, b) for b in (base, "https://h.example", "https://h.example/x/y?z=1") for r in given if not (r.startswith("//") and r != "//g.example")]

    def plain(r, b):
        full = urljoin(b if urlsplit(b).path else b + "/", r).split("#")[0]
        parts = urlsplit(full)
        return full if parts.path else full.replace(parts.netloc, parts.netloc + "/", 1)

    got = w.with_resolved(spark.createDataFrame(rows, "r string, b string"), F.col("r"), F.col("b"), "x").collect()
    assert [(x.r, x.b, x.x) for x in got if x.x != plain(x.r, x.b)] == []


CASES = [
    ("mailto:a@b.example", None), ("javascript:void(0)", None), ("data:text/html,x", None), ("tel:1", None), (None, None), ("http://", None),
    ("HTTPS://H.Example:443/A?b#c", "https://h.example/A?b"), ("http://h.example:80", "http://h.example/"), ("http://h.example:8080/", "http://h.example:8080/"),
    (" \n/x y ", "https://s.example/x%20y"), ("\\x\\y", "https://s.example/x/y"), ("//O.example/a/../b", "https://o.example/b"), ("http:/x.example/y", "http://x.example/y"),
    ("https:z", "https://s.example/p/z"), ("?a=\\", "https://s.example/p/q?a=\\"),
]


def test_resolved_cases(spark):
    rows = spark.createDataFrame([(r,) for r, _ in CASES], "r string")
    assert [(x.r, x.x) for x in w.with_resolved(rows, F.col("r"), F.lit("https://s.example/p/q?k=1"), "x").collect()] == CASES


def test_links(spark):
    html = """<A HREF='one'>1</A><a class="x>y" href="two?utm_source=a&amp;b=2&amp;ref=3&amp;refs=4#f">2</a><a href=three>3</a><a name=x>no</a><link href=/css>
      <!-- <a href=hidden> --><script>"<a href=also>"</script><a data-href=none>4</a><a href="mailto:x">5</a><a href="/one/../one">6</a><a href="../d/one">again</a><a href="?fbclid=1">7</a>"""
    rows = w.links(spark.createDataFrame([(1, html, "http://h.example/d/page?k=v")], "page_id int, html string, url string")).orderBy("at").collect()
    assert [r.link for r in rows] == ["http://h.example/d/one", "http://h.example/d/two?b=2&refs=4", "http://h.example/d/three", "http://h.example/one", "http://h.example/d/page"]


TITLES = [
    ("<title>A long name of a page | Site</title>", "A long name of a page"), ("<title>Short name | Site</title>", "Short name | Site"), ("<title>Docs » A guide to all of the things</title>", "A guide to all of the things"),
    ("<title>Guide: how to mend a net by hand</title>", "how to mend a net by hand"), ("<title> Plain \n title </title>", "Plain title"), ("<title></title>", "/p/q"), ("", "/p/q"),
    ('<title>X</title><meta content="Of the meta" property="og:title">', "Of the meta"), ("<meta name=title content=One><meta property='og:title' content='Two words'>", "Two words"), ("<title>" + "x" * 400 + "</title>", "x" * 300),
]


def test_title(spark):
    rows = spark.createDataFrame([(h,) for h, _ in TITLES], "html string").select("html", w.title(F.col("html"), F.lit("https://s.example/p/q?k=1")).alias("x"))
    assert list(map(tuple, rows.collect())) == TITLES


def test_queries(spark):
    """The reports and their SQL on pages with all kinds of links and titles."""
    import duckdb

    from sparkloom.plans import retrieval

    pages = [
        (1, "https://h.example/a/b?x=1#f", """<title>A page of many words | The site</title><a href='../c'>1</a><a href=d>2</a><a HREF="//o.example">3</a><a href="?utm_id=1&amp;k=2">4</a><a href="">5</a><a href="#x">6</a><a href="mailto:a">7</a><a href="/e/./f/..">8</a>"""),
        (2, "http://h.example", """<meta content='Not found | us' property='og:title'><title>x</title><a href=y>1</a><script>"<a href=no>"</script>"""),
        (3, "http://h.example/q/", """<!-- <a href=no> --><title>Guide: how to mend nets</title><a class="p>q" href="z z">1</a>"""), (4, "http://h.example/only/path", "text"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
        for name in ("page_titles", "page_links"):
            got = getattr(retrieval, name)(lambda _: frame)
            want = con.execute(retrieval.R.sql[name])
            columns = [d[0] for d in want.description]
            assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_title_is_computed_once(spark):
    """A page's title goes through its elements once, however often what is made of it is used."""
    rows = spark.createDataFrame([("<title>Customer support - the site</title>", "https://s.example/p")], "html string, url string")
    scored = rows.select(answer.contact_score(w.title(F.col("html"), F.col("url")), F.lit("/")).alias("x"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<title[^>]*>") == 1 and plan.count(r"<meta\s") == 1
    assert scored.first().x == 3
