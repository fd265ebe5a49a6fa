"""Crawling without fetching: frontier expansion, robots and sitemaps over tables of what was fetched."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


#: Sitemaps that are read of one site, and the references in their addresses.
SITEMAPS = 100
ESCAPED = {"&amp;": "&", "&lt;": "<", "&gt;": ">"}


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))


def robots(text: Column, bot: str) -> Column:
    """Struct of the disallowed prefixes and the crawl delay in seconds (30 at most) that hold for ``*`` or the bot."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", "")))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    start = F.struct(F.lit(False).alias("mine"), F.array().cast("array<string>").alias("disallow"), F.lit(0.0).alias("delay"))

    def step(a: Column, x: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(x, ":", 1)))
        mine = F.when(name == "user-agent", (value(x) == "*") | F.contains(F.lower(value(x)), F.lit(bot.lower()))).otherwise(a["mine"])
        rule = a["mine"] & (name == "disallow") & (value(x) != "")
        wait = F.when(a["mine"] & (name == "crawl-delay"), F.least(F.lit(30.0), F.coalesce(F.try_to_number(value(x), F.lit("999.99")).cast("double"), F.lit(0.0)))).otherwise(a["delay"])
        return F.struct(mine.alias("mine"), F.when(rule, F.concat(a["disallow"], F.array(value(x)))).otherwise(a["disallow"]).alias("disallow"), wait.alias("delay"))

    return F.aggregate(lines, start, step, lambda a: F.struct(a["disallow"], a["delay"]))


def allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path starts with an included prefix, if there are any, and with no excluded one."""
    some = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(path, p))
    return (some(include) if include else F.lit(True)) & (~some(exclude) if exclude else F.lit(True))


def _shared(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; unset, a session on one machine gets a temporary folder and a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(base or tempfile.mkdtemp(prefix="sparkloom-"))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def sitemap_pages(fetched: DataFrame, roots: DataFrame, maps: int = SITEMAPS) -> DataFrame:
    """root and url of the pages that each root's sitemaps name, out of the fetched bodies (url, xml).

    /sitemap.xml and /sitemap_index.xml come first; entries of an index, and entries that end in .xml or .xml.gz, are sitemaps
    in turn, read level by level and by address, ``maps`` a root at most. Entries of another origin do not count, repeats count once.
    """
    _shared(fetched.sparkSession)
    bodies = fetched.select(F.col("url").alias("map"), "xml")
    starts = F.array(*(F.concat(origin(F.col("root")), F.lit(name)) for name in ("/sitemap.xml", "/sitemap_index.xml")))
    frontier = roots.select("root", F.explode(starts).alias("map")).distinct().checkpoint()
    seen, pages = frontier, None
    while not frontier.isEmpty():
        named = frontier.join(bodies, "map").select("root", F.col("xml").rlike(r"(?i)<sitemapindex[\s>]").alias("index"), F.explode(sitemap_urls(F.col("xml"))).alias("url"))
        plain = F.col("url")
        for entity, character in ESCAPED.items():
            plain = F.replace(plain, F.lit(entity), F.lit(character))
        named = named.withColumn("url", plain).where(origin(F.col("url")) == origin(F.col("root")))
        named = named.select("root", "url", (F.col("index") | F.col("url").rlike(r"(?i)^[^?#]*\.xml(?:\.gz)?(?:[?#]|\z)")).alias("map")).distinct().checkpoint()
        found = named.where("NOT map").select("root", "url")
        pages = found if pages is None else pages.unionByName(found)
        fresh = named.where("map").select("root", F.col("url").alias("map")).join(seen, ["root", "map"], "left_anti")
        room = seen.groupBy("root").agg((F.lit(maps) - F.count("*")).alias("room"))
        nth = F.row_number().over(Window.partitionBy("root").orderBy("map"))
        frontier = fresh.withColumn("nth", nth).join(room, "root").where("nth <= room").select("root", "map").checkpoint()
        seen = seen.unionByName(frontier)
    return pages.distinct() if pages is not None else roots.select("root", F.lit("").alias("url")).limit(0)


def reachable(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """url and depth of what links (page, link) reach from roots (url) in at most depth steps, breadth first.

    Each step joins the new frontier alone; its lineage is cut by a checkpoint in the shared folder.
    """
    _shared(links.sparkSession)
    seen = roots.select("url", F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = seen
    for k in range(1, depth + 1):
        frontier = frontier.join(links, F.col("url") == F.col("page")).select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti").select("url", F.lit(k).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Addresses queued for each page that may be indexed, and characters of a page that is not thin.
QUEUED, THIN = 8, 120
ORDER = "root string, nth long, url string, outcome string"


def crawl_order(pages: DataFrame, roots: DataFrame, limit: int, include: list[str] = [], exclude: list[str] = []) -> DataFrame:
    """root, nth (from 1), url and outcome of every address that a crawl of each root takes from its queue, in its order.

    pages (url, text, links: urls in page order) are what fetching gives; roots (root, disallow: the path prefixes that robots.txt forbids).
    The queue is first in, first out: a page's links of the root's origin that path rules and robots allow are queued in page order, once each, QUEUED x limit at most.
    The crawl stops with its ``limit``-th indexed page. An outcome is indexed, thin, duplicate (of the text of a page indexed before) or failed (not fetched).

    One round takes a whole level of the queue: its order is the parent's number, then the place of the link. Numbers are counted within a root, which the cap
    bounds; a round is cut off by a checkpoint in the shared folder, and only its emptiness comes to the driver.
    """
    _shared(pages.sparkSession)
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    fetched = pages.select("url", F.length("text").alias("n"), F.sha2("text", 256).alias("hash"), "links")
    rules = roots.select("root", F.coalesce("disallow", F.array().cast("array<string>")).alias("disallow"))
    queue = roots.select("root", F.col("root").alias("url"), F.lit(1).cast("long").alias("nth")).distinct().checkpoint()
    seen, done, hashes = queue, None, queue.select("root", F.lit("").alias("hash")).limit(0)
    indexed = queue.select("root", F.lit(0).cast("long").alias("before"))
    by = Window.partitionBy("root").orderBy("nth")
    while not queue.isEmpty():
        level = queue.join(fetched, "url", "left").withColumn("known", F.col("n").isNotNull()).withColumn("fit", F.coalesce(F.col("n") >= THIN, F.lit(False)))
        old = hashes.withColumn("old", F.lit(True))
        level = level.join(old, ["root", "hash"], "left")
        first = F.min(F.when(F.col("fit") & F.col("old").isNull(), F.col("nth"))).over(Window.partitionBy("root", "hash"))
        level = level.withColumn("new", F.coalesce(F.col("fit") & F.col("old").isNull() & (F.col("nth") == first), F.lit(False)))
        level = level.join(indexed, "root").withColumn("count", F.col("before") + F.sum(F.col("new").cast("long")).over(by) - F.col("new").cast("long")).where(F.col("count") < limit).drop("before")
        level = level.checkpoint()
        outcome = F.when(~F.col("known"), "failed").when(F.col("new"), "indexed").when(~F.col("fit"), "thin").otherwise("duplicate")
        told = level.select("root", "nth", "url", outcome.alias("outcome"))
        done = told if done is None else done.unionByName(told)
        hashes = hashes.unionByName(level.where("new").select("root", "hash"))
        indexed = done.groupBy("root").agg(F.count_if(F.col("outcome") == "indexed").alias("before"))
        links = level.where("known").select("root", "nth", F.posexplode("links").alias("at", "url")).join(rules, "root")
        fits = (origin(F.col("url")) == origin(F.col("root"))) & allowed(path, include, exclude) & ~F.exists("disallow", lambda p: F.startswith(path, p))
        fresh = links.where(fits).groupBy("root", "url").agg(F.min(F.struct("nth", "at")).alias("place")).join(seen.select("root", "url"), ["root", "url"], "left_anti")
        count = seen.groupBy("root").agg(F.count("*").alias("queued"))
        number = F.col("queued") + F.row_number().over(Window.partitionBy("root").orderBy("place"))
        queue = fresh.join(count, "root").select("root", "url", number.alias("nth")).where(F.col("nth") <= QUEUED * limit)
        full = indexed.where(F.col("before") >= limit).select("root")
        queue = queue.join(full, "root", "left_anti").checkpoint()
        seen = seen.unionByName(queue)
    return done if done is not None else pages.sparkSession.createDataFrame([], ORDER)
