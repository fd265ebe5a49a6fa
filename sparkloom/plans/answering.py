"""Answer shaping, evaluation, refresh scheduling and catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import answer as a, text as x, web
from ..operators import answers
from ..streaming import events
from . import retrieval
from .conversations import TOKENS, _any, _rlike
from .registry import Registry, Tables

R = Registry()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The moment at which the refresh report looks at the tables, the days between refreshes and the sources it takes up at once.
NOW, DAYS, MOST = "1998-09-01 00:00:00", 30, 50
#: A metric may fall this far below its baseline.
TOLERANCE = 0.02


@R.add(f"""
WITH s AS (SELECT o_custkey AS source, max(o_orderdate) + INTERVAL {DAYS} DAY AS next_sync FROM orders GROUP BY ALL),
due AS (SELECT * FROM s JOIN customer ON c_custkey = source WHERE c_acctbal > 0 AND next_sync <= TIMESTAMP '{NOW}' ORDER BY next_sync, source LIMIT {MOST})
SELECT source, next_sync FROM due WHERE source NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def refresh_due(t: Tables) -> DataFrame:
    """Ready sources whose next refresh is due, the longest due first, without those that have an active job."""
    last = t("orders").groupBy(F.col("o_custkey").alias("source")).agg((F.max("o_orderdate") + F.expr(f"INTERVAL {DAYS} DAYS")).alias("next_sync"))
    ready = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source"))
    due = last.join(ready, "source").where(F.col("next_sync") <= F.lit(NOW).cast("timestamp")).orderBy("next_sync", "source").limit(MOST)
    active = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("source"))
    return due.join(active, "source", "left_anti").select("source", "next_sync")


_ASKED = "CASE k WHEN 0 THEN text WHEN 1 THEN 'Please list 7 projects, ' || text WHEN 2 THEN 'Show Three articles ' || text WHEN 3 THEN 'give me 12 posts ' || text ELSE 'list 10 of them' END"


@R.add(rf"""
WITH m AS (SELECT conv_id, turn, CAST(k AS BIGINT) AS k, {_ASKED} AS q FROM conversations, (SELECT unnest(range(5)) AS k) WHERE role = 'user')
SELECT conv_id, turn, k, CASE WHEN regexp_matches(q, '(?i){a.LIST_OF}') THEN coalesce(CAST(nullif(regexp_extract(q, '(?i){a.LIST_NUMBER}', 1), '') AS INT),
  CASE lower(regexp_extract(q, '(?i){a.LIST_WORD}', 1)) {' '.join(f"WHEN '{w}' THEN {n}" for w, n in a.LIST_WORDS.items())} END) END AS wanted FROM m
""")
def requested_lists(t: Tables) -> DataFrame:
    rows = t("conversations").where("role = 'user'").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    asked = F.expr(_ASKED)
    return rows.select("conv_id", "turn", "k", a.requested_list(asked).alias("wanted"))


_PAGE_NAMES = f"page_names AS ({retrieval.R.sql['page_titles']})"


@R.add(rf"""
WITH {_PAGE_NAMES}, p AS (SELECT page_id, title, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages JOIN page_names USING (page_id))
SELECT page_id, CASE WHEN regexp_matches(title, '(?i){a.NO_CONTACT}') THEN -10 {' '.join(f"WHEN regexp_matches(path, '(?i){p}') OR regexp_matches(trim(title), '(?i){n}') THEN {s}" for s, p, n in a.CONTACT_PAGES)} ELSE -10 END AS score FROM p
""".replace(r"\z", "$"))
def contact_pages(t: Tables) -> DataFrame:
    """How likely each page is one to get in touch, by its title and path."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", web.REFERENCE, 3), F.lit("")), F.lit("/"))
    return t("pages").select("page_id", a.contact_score(web.title(F.col("html"), F.col("url")), path).alias("score"))


@R.add(f"""
WITH p AS (SELECT page_id, trim({retrieval.TEXT}) AS text FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS text FROM p
""")
def residual_entities(t: Tables) -> DataFrame:
    """The text of each page with the entities decoded that reading it has left."""
    return t("pages").select("page_id", a.decode_residual(retrieval.page_text(F.col("html"))).alias("text"))


def best_citation(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Of each answer the citation that fits it best: rows has keys, place (from 0), title, excerpt and url of its citations.

    A citation without a specific address does not count, nor in the places of those after it; ties go to the first.
    """
    spec = a.source_specificity(F.col("url"), F.col("title"))
    rows = rows.withColumn("spec", spec).where((F.col("spec") > 0) & F.col("url").isNotNull())
    said, held = F.array_distinct(x.tokens(content)), F.array_distinct(x.tokens(F.concat_ws(" ", "title", "excerpt")))
    overlap = F.size(F.array_intersect(said, held)) / F.greatest(F.lit(1), F.size(said))
    scored = rows.select(*keys, "place", "url", overlap.alias("overlap"), "spec")
    # an answer cites few pages: their order among those that count is one sorted array
    listed = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "url", "overlap", "spec"))).alias("c"))
    ranked = F.transform("c", lambda c, i: F.struct(F.round(c["overlap"] * 4 + c["spec"] * 0.25 - i * 0.08, 6).alias("score"), (-i).alias("order"), c["url"].alias("url")))
    best = F.array_max(ranked)
    return listed.select(*keys, best["url"].alias("url"), best["score"].alias("score"))


_SPEC = r"""CASE WHEN len(seg) = 0 THEN -10 ELSE len(seg) + CASE WHEN length(seg[-1]) > 12 THEN 1 ELSE 0 END
  - CASE WHEN len(list_filter(seg, lambda z: regexp_matches(z, '(?i)^(?:category|categories|tag|tags|search|author|page|blog|articles|posts|project|projects|archive|archives)$'))) > 0 THEN 4 ELSE 0 END END"""


def evaluation(cases: DataFrame) -> DataFrame:
    """Recall, reciprocal rank, abstention and misses of cases with rank (0: missed), abstained and unanswerable.

    Ranks count over answerable cases alone, abstention over all; without refusals precision is 1, without anything to refuse recall is 1.
    """
    share = lambda c: F.round(F.coalesce(F.avg(F.when(~F.col("unanswerable"), c)), F.lit(0.0)), 6)
    within = lambda k: F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)
    right = F.count_if(F.col("abstained") & F.col("unanswerable"))
    part = lambda whole: F.round(F.when(whole > 0, right / whole).otherwise(1.0), 6)
    return cases.agg(
        share(within(1)).alias("recall_1"), share(within(8)).alias("recall_8"), share(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        part(F.count_if("abstained")).alias("abstention_precision"), part(F.count_if("unanswerable")).alias("abstention_recall"),
        F.count_if(F.col("abstained") & ~F.col("unanswerable")).alias("false_refusals"), F.count_if((F.col("rank") == 0) & ~F.col("unanswerable")).alias("misses"),
    )


#: Known items: one document in so many asks for itself by its title; those that answer within so many places count.
KNOWN, WITHIN = 50, 8


def known_items(t: Tables) -> DataFrame:
    """item_id and text: the titles of a stated set of documents, each of which is to find its own document."""
    return t("documents").where(f"doc_id % {KNOWN} = 0").select(F.col("doc_id").alias("item_id"), F.trim(F.substring_index("text", "\n", 1)).alias("text"))


def _cases(t: Tables) -> DataFrame:
    """item_id, rank (of its document among the documents found, 0: missed), abstained, unanswerable (a title without any term) and text of the known items."""
    asked = known_items(t)
    hits = retrieval.retrieve(asked, retrieval.stored(t), 4 * WITHIN)
    docs = hits.groupBy("item_id", "doc_id").agg(F.min("place").alias("first"), F.max("confidence").alias("confidence"))
    docs = docs.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("first")))
    best = docs.groupBy("item_id").agg(F.min(F.when((F.col("doc_id") == F.col("item_id")) & (F.col("rank") <= WITHIN), F.col("rank"))).alias("rank"))
    sure = hits.where("place = 1").select("item_id", F.col("confidence").alias("sure"))
    rows = asked.join(best, "item_id", "left").join(sure, "item_id", "left")
    abstained = F.coalesce("sure", F.lit(0)) < int(retrieval.GATE * 1_000_000)
    return rows.select("item_id", F.coalesce("rank", F.lit(0)).alias("rank"), abstained.alias("abstained"), (F.size(x.query_terms(F.col("text"))) == 0).alias("unanswerable"), "text")


QUESTIONS = rf"SELECT doc_id AS item_id, trim(split_part(text, chr(10), 1)) AS text FROM documents WHERE doc_id % {KNOWN} = 0"
_CASES = f"""{retrieval.asked_sql(retrieval.HIT_SQL, QUESTIONS)},
dc AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY min(place)) AS rank FROM ranks WHERE place <= {4 * WITHIN} GROUP BY item_id, doc_id),
c AS (SELECT a.item_id, coalesce((SELECT rank FROM dc WHERE dc.item_id = a.item_id AND dc.doc_id = a.item_id AND rank <= {WITHIN}), 0) AS rank,
  coalesce((SELECT confidence FROM ranks WHERE ranks.item_id = a.item_id AND place = 1), 0) < {int(retrieval.GATE * 1_000_000)} AS abstained, len(a.terms) = 0 AS unanswerable, a.text FROM asked a)"""
_REPORT = f"""{_CASES}, e AS (SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT unanswerable), 6) AS recall_1, round(avg(CASE WHEN rank BETWEEN 1 AND 8 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT unanswerable), 6) AS recall_8,
  round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END) FILTER (WHERE NOT unanswerable), 6) AS mrr, round(coalesce(count(*) FILTER (WHERE abstained AND unanswerable) / nullif(count(*) FILTER (WHERE abstained), 0), 1), 6) AS abstention_precision,
  round(coalesce(count(*) FILTER (WHERE abstained AND unanswerable) / nullif(count(*) FILTER (WHERE unanswerable), 0), 1), 6) AS abstention_recall, count(*) FILTER (WHERE abstained AND NOT unanswerable) AS false_refusals, count(*) FILTER (WHERE rank = 0 AND NOT unanswerable) AS misses FROM c)"""


@R.add(f"WITH {_REPORT} SELECT * FROM e")
def evaluation_summary(t: Tables) -> DataFrame:
    return evaluation(_cases(t))


@R.add(f"WITH {_CASES} SELECT item_id, text FROM c WHERE rank = 0 AND NOT unanswerable")
def evaluation_misses(t: Tables) -> DataFrame:
    return _cases(t).where("rank = 0 AND NOT unanswerable").select("item_id", "text")


BASELINE = {"recall_1": 0.9, "recall_8": 0.95, "mrr": 0.9, "abstention_precision": 0.5, "abstention_recall": 0.5}


def against(report: DataFrame, baseline: dict[str, float], tolerance: float = TOLERANCE) -> DataFrame:
    """metric, value, baseline and regressed (more than tolerance below it) of a report of one row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(b).alias("baseline")) for m, b in baseline.items())))
    return report.select(pairs.alias("p")).select("p.*").withColumn("regressed", F.col("value") < F.col("baseline") - tolerance)


@R.add(f"WITH {_REPORT} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS baseline, {m} < CAST({b} AS DOUBLE) - {TOLERANCE} AS regressed FROM e" for m, b in BASELINE.items()))
def evaluation_regressions(t: Tables) -> DataFrame:
    return against(evaluation(_cases(t)), BASELINE)


@R.add(" UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS held FROM {n}" for n in TABLES))
def table_sizes(t: Tables) -> DataFrame:
    """Rows of each table of the catalog."""
    out = None
    for name in TABLES:
        rows = t(name).agg(F.count("*").alias("held")).select(F.lit(name).alias("name"), "held")
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add(r"""
WITH c AS (SELECT c_custkey, c_custkey * 7919 % 1600 AS m, '100%_' || c_name AS q FROM customer)
SELECT c_custkey, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS clock, CAST(CASE WHEN m <= 1440 THEN m END AS INT) AS minutes,
  '%' || regexp_replace(q, '([%_\\])', '\\\1', 'g') || '%' AS pattern FROM c
""")
def clock_labels(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", (F.col("c_custkey") * 7919 % 1600).alias("m"), F.concat(F.lit("100%_"), "c_name").alias("q"))
    clock = web.clock(F.col("m"))
    return rows.select("c_custkey", clock.alias("clock"), web.minutes(clock).alias("minutes"), web.like_pattern(F.col("q")).alias("pattern"))


#: Questions, one of each kind, on the title of every tenth page, and the hits that retrieval finds for them in the pages' texts.
ASKING, FOUND = 10, 20
_KINDS = ["'List all pages please: ' || title", "'Anything similar to ' || title", "'Please show me three projects on ' || title", "'give me 9 articles on ' || title", "'Tell me of this: ' || title"]
_WANTED = f"""CASE WHEN regexp_matches(question, '(?i){a.LIST_OF}') THEN coalesce(CAST(nullif(regexp_extract(question, '(?i){a.LIST_NUMBER}', 1), '') AS INT),
  CASE lower(regexp_extract(question, '(?i){a.LIST_WORD}', 1)) {' '.join(f"WHEN '{w}' THEN {n}" for w, n in a.LIST_WORDS.items())} END) END"""
_KIND = "CASE k " + " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(_KINDS)) + " END"
_ASKING = f"SELECT page_id * {len(_KINDS)} + k AS item_id, {_KIND} AS text FROM page_names, (SELECT unnest(range({len(_KINDS)})) AS k) WHERE page_id % {ASKING} = 0"
_PAGE_RANKS = f"""{_PAGE_NAMES}, page_docs AS (SELECT page_id AS doc_id, title || chr(10) || trim({retrieval.TEXT}) AS text FROM pages JOIN page_names USING (page_id)),
{retrieval.asked_sql(retrieval.HIT_SQL, _ASKING).replace('FROM documents', 'FROM page_docs')}"""
_HITS = rf"""{_PAGE_RANKS},
page_ranks AS (SELECT ranks.item_id, questions.text AS question, place, doc_id, position, title, url, ttl AS title_score, content, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda z: z <> '') AS seg
  FROM ranks JOIN questions ON questions.item_id = ranks.item_id JOIN pages ON page_id = doc_id WHERE place <= {FOUND}),
page_hits AS (SELECT *, {_SPEC} - CASE WHEN regexp_matches(title, '(?i){a.GENERIC_TITLE}') THEN 4 ELSE 0 END AS spec, {_WANTED} AS wanted FROM page_ranks)"""


def page_index(t: Tables) -> DataFrame:
    """The index of all pages: chunks of title and text with their url, written once where there is a shared folder."""
    title = web.title(F.col("html"), F.col("url"))
    pages = retrieval.dealt(t("pages").select("page_id", "url", "html"), "page_id")
    docs = pages.select(F.col("page_id").alias("doc_id"), "url", F.concat(title, F.lit("\n"), retrieval.page_text(F.col("html"))).alias("text"))
    return retrieval.index_of(docs, "url")


def _page_hits(t: Tables, *texts: Column) -> DataFrame:
    """What retrieval finds for the questions on pages, with title, url and texts of the chunks found."""
    n = len(_KINDS)
    named = t("pages").where(F.col("page_id") % ASKING == 0).select("page_id", web.title(F.col("html"), F.col("url")).alias("title"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    asked = named.select((F.col("page_id") * n + F.col("k")).alias("item_id"), F.expr(_KIND).alias("text"))
    return retrieval.found_chunks(asked, page_index(t), FOUND, ("title", "url", *texts), ("title_score",)).join(asked.withColumnRenamed("text", "question"), "item_id")


#: Pages that an answer cites at most, and characters of each that it shows.
CITED, SHOWN = 4, 260
_SAID = """said AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS before, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS answer, role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_CITED_RANKS = _PAGE_RANKS.replace(_ASKING, "SELECT DISTINCT md5(before) AS item_id, before AS text FROM said WHERE role = 'user' AND before IS NOT NULL AND answer IS NOT NULL")


@R.add(rf"""
WITH {_SAID}, {_CITED_RANKS},
d1 AS (SELECT item_id, doc_id, min(place) AS place FROM ranks WHERE place <= {retrieval.HITS} GROUP BY ALL), d2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) - 1 AS nth FROM d1),
ct AS (SELECT conv_id, turn, answer, url, nth, title, title || ' ' || left(content, {SHOWN}) AS ev, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda z: z <> '') AS seg
  FROM said JOIN d2 ON item_id = md5(before) JOIN ranks r ON r.item_id = d2.item_id AND r.place = d2.place JOIN pages ON page_id = d2.doc_id WHERE role = 'user' AND answer IS NOT NULL AND nth < {CITED}),
cs AS (SELECT *, {_SPEC} - CASE WHEN regexp_matches(title, '(?i){a.GENERIC_TITLE}') THEN 4 ELSE 0 END AS spec FROM ct),
ck AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY nth) - 1 AS i, list_distinct({TOKENS.format('answer')}) AS a, list_distinct({TOKENS.format('ev')}) AS b FROM cs WHERE spec > 0),
cr AS (SELECT conv_id, turn, url, i, round(len(list_intersect(a, b)) / greatest(1, len(a)) * 4 + spec * 0.25 - i * 0.08, 6) AS score FROM ck)
SELECT conv_id, turn, url, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS n FROM cr) WHERE n = 1
""")
def contextual_citations(t: Tables) -> DataFrame:
    """The page that each user's turn may mean by "that article": of those that the last answer before it cites, the one that fits what was said best."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(w)
    said = t("conversations").select("conv_id", "turn", "role", last("user").alias("before"), last("assistant").alias("answer"))
    said = retrieval.written(said.where("role = 'user' AND before IS NOT NULL AND answer IS NOT NULL").drop("role").withColumn("item_id", F.md5("before")))
    asked = said.select("item_id", F.col("before").alias("text")).distinct()
    excerpt = F.left("content", F.lit(SHOWN)).alias("excerpt")
    # dealt by question once, for the documents of each and their order
    hits = retrieval.found_chunks(asked, page_index(t), texts=("title", "url", excerpt), scores=()).repartition("item_id").groupBy("item_id", "doc_id").agg(F.min(F.struct("place", "title", "excerpt", "url")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("h.place")) - 1
    cited = hits.select("item_id", "doc_id", nth.alias("place"), "h.title", "h.excerpt", "h.url").where(F.col("place") < CITED)
    return best_citation(said.join(cited, "item_id"), ["conv_id", "turn"], F.col("answer"))


@R.add(rf"""
WITH {_HITS}, b_ AS (SELECT item_id, arg_min(doc_id, place) AS best, arg_min(title_score, place) AS score FROM page_hits GROUP BY ALL),
m AS (SELECT h.*, best, CASE WHEN {_any('question', x.OVERVIEW)} THEN 'overview' WHEN {_rlike('question', x.RELATED)} OR wanted IS NOT NULL THEN 'several' WHEN score >= 0.5 THEN 'one' ELSE 'first' END AS mode FROM page_hits h JOIN b_ USING (item_id)),
f AS (SELECT *, mode <> 'several' OR url IS NULL OR spec > 0 AS fits FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id, fits ORDER BY place) AS nth FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS again FROM n WHERE CASE mode WHEN 'one' THEN doc_id = best WHEN 'first' THEN TRUE ELSE fits AND nth = 1 END)
SELECT item_id, CAST(again AS BIGINT) AS place, doc_id AS page_id, CAST(position AS BIGINT) AS position FROM k WHERE again <= CASE mode WHEN 'overview' THEN 14 ELSE 5 END
""")
def evidence_selection(t: Tables) -> DataFrame:
    return answers.coherent(_page_hits(t)).select("item_id", "place", F.col("doc_id").alias("page_id"), "position")


@R.add(rf"""
WITH {_HITS}, w AS (SELECT * FROM page_hits WHERE wanted IS NOT NULL AND url <> '' AND spec > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY place) AS nth FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS k FROM d WHERE nth = 1),
c AS (SELECT *, trim(regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(content, '\r?\n'), lambda z: NOT regexp_matches(z, '(?i){a.FRONT_LINE}')), ' '), '(?i){a.SUMMARY}', ''), '\s+', ' ', 'g')) AS body FROM k WHERE k <= wanted),
s AS (SELECT *, substr(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(body, '[^.!?]+[.!?]+|[^.!?]+$'), ''), body), '(?i){a.FRONT_NAME}', ' ', 'g'), '\s+', ' ', 'g')), 1, {a.DESCRIPTION}) AS about FROM c),
g AS (SELECT item_id, wanted, count(*) AS n, string_agg('- [' || title || '](' || url || ')' || CASE WHEN about <> '' THEN ' — ' || about ELSE '' END, chr(10) ORDER BY k) AS lines FROM s GROUP BY ALL)
SELECT item_id, CASE WHEN n < wanted THEN 'I found ' || n || ' clearly relevant indexed ' || CASE n WHEN 1 THEN 'project' ELSE 'projects' END || ':' ELSE 'Here are ' || n || ' relevant projects:' END || chr(10) || chr(10) || lines AS answer FROM g
""")
def listed_answers(t: Tables) -> DataFrame:
    return answers.listed(_page_hits(t, a.evidence_description(F.col("content")).alias("about")))


@R.add()
def speech_chunks(t: Tables) -> DataFrame:
    """What a voice says of each conversation's turns; no SQL, for it is a fold over the parts of a call (tests/test_tables.py)."""
    return events.speech_chunks(t("conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("at"), F.concat("text", F.lit(" ")).alias("part")))
