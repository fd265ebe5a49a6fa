"""Routing, history windows, pins, content gaps and inbox reports over messages.

The messages are the table conversations; its column turn is the time axis. An assistant's message counts as a refusal where its
length is a multiple of five, since the table has no such column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as x
from .registry import Registry, Sql, Tables

R = Registry()

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
TOKENS = Sql(r"regexp_extract_all(lower({0}), '[\p{L}\p{N}]{3,}')")
#: First occurrences only, in order.
DISTINCT = Sql("list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda z: list_position({0}, z[1]) = z[2]), lambda z: z[1])")

GAP_KEY = Sql(f"""CASE WHEN len(list_filter({TOKENS.format('{0}')}, lambda w: w NOT IN ({_LIST(x.FRAMING)}))) = 0 THEN trim(regexp_replace(lower({{0}}), '\\s+', ' ', 'g'))
ELSE array_to_string(list_sort(list_distinct(list_transform(list_filter({TOKENS.format('{0}')}, lambda w: w NOT IN ({_LIST(x.FRAMING)})), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END))), ' ') END""")


def content_gaps(messages: DataFrame, refused, limit: int = 25) -> DataFrame:
    """Refused questions by topic: key, question (the longest phrasing), asked, last_at, conv_id (of the newest) and variants.

    The question of a refusal is the user's last message before it in the conversation. Phrasings are distinct before they are
    gathered, so a topic that a third of all visitors asks about is a list of its wordings, not of its messages.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.trim("text")), ignorenulls=True).over(w))
    asked = asked.where((F.col("role") == "assistant") & refused & (F.col("question") != "")).withColumn("key", x.gap_key(F.col("question")))
    phrase = asked.groupBy("key", "question").agg(F.count("*").alias("n"), F.max(F.struct("turn", "conv_id")).alias("newest"), F.min(F.struct("conv_id", "turn")).alias("first"))
    order = F.struct(F.length("question").alias("len"), (-F.col("first.conv_id")).alias("c"), (-F.col("first.turn")).alias("t"), "question")
    best = phrase.groupBy("key").agg(F.max(order).alias("best"), F.sum("n").alias("asked"), F.max("newest").alias("newest"), F.count("*").alias("phrasings"))
    out = best.select("key", F.col("best.question").alias("question"), "asked", F.col("newest.turn").alias("last_at"), F.col("newest.conv_id").alias("conv_id"), F.least(F.col("phrasings") - 1, F.lit(4)).alias("variants"))
    return out.orderBy(F.desc("asked"), F.desc("last_at"), "key").limit(limit)


@R.add(f"""
WITH q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations),
r AS (SELECT *, {GAP_KEY.format('question')} AS key FROM q WHERE role = 'assistant' AND length(text) % 5 = 0 AND question <> ''),
g AS (SELECT key, count(*) AS asked, arg_max(question, length(question) * 1e12 - conv_id * 1e4 - turn) AS question, max(turn) AS last_at, arg_max(conv_id, turn * 1e9 + conv_id) AS conv_id, count(DISTINCT question) AS phrasings FROM r GROUP BY key)
SELECT key, question, CAST(asked AS BIGINT) AS asked, last_at, conv_id, CAST(least(phrasings - 1, 4) AS BIGINT) AS variants FROM g ORDER BY asked DESC, last_at DESC, key LIMIT 25
""")
def content_gap_report(t: Tables) -> DataFrame:
    return content_gaps(t("conversations"), F.length("text") % 5 == 0)


@R.add(f"SELECT item_id, {GAP_KEY.format('text')} AS key FROM benchmark")
def gap_question_key(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", x.gap_key(F.col("text")).alias("key"))


@R.add(f"""
WITH r AS (SELECT item_id, {DISTINCT.format('k')} AS raw FROM (SELECT item_id, {TOKENS.format('text')} AS k FROM benchmark)),
b AS (SELECT item_id, raw, list_filter(raw, lambda w: w NOT IN ({_LIST(x.GENERIC_STOP_WORDS)})) AS kept FROM r)
SELECT item_id, array_to_string(list_slice(CASE WHEN len(kept) > 0 THEN kept ELSE raw END, 1, 24), ' ') AS terms FROM b
""")
def query_terms(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.array_join(x.query_terms(F.col("text")), " ").alias("terms"))


def _rlike(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(_rlike(column, p) for p in patterns) + ")"


_PLAIN = r"regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g')"
_WIDE, _NARROW = x.WIDE, x.NARROW.replace("'", "''")
_NORMAL = rf"trim(regexp_replace(replace(replace(translate(text, '{_WIDE}', '{_NARROW}'), '’', ''), '''', ''), '\s+', ' ', 'g'))"
ROUTE = f"""CASE WHEN {_any(_PLAIN, [x.ATTACK_PHRASE, x.DISCARD])} OR ({_any(_PLAIN, x.INSTRUCTIONS)} AND {_rlike(_PLAIN, x.REVEAL)}) THEN 'attack'
WHEN {_any(_NORMAL, x.HUMAN_SUPPORT)} THEN 'handoff'
WHEN {_rlike('text', x.LATEST_LINK[0])} AND {_rlike('text', x.LATEST_LINK[1])} THEN 'latest_link'
WHEN {_rlike('text', x.CONTEXT_LINK[0])} AND {_rlike('text', x.CONTEXT_LINK[1])} THEN 'context_link'
WHEN {_any('text', x.IMAGE)} AND {_rlike('text', x.PAGE_OF_IMAGE)} THEN 'image_page'
WHEN {_any('text', x.OVERVIEW)} THEN 'overview' WHEN {_rlike('text', x.RELATED)} THEN 'related' ELSE 'retrieve' END"""


@R.add(f"SELECT conv_id, turn, {ROUTE} AS route FROM conversations WHERE role = 'user'")
def route_messages(t: Tables) -> DataFrame:
    return t("conversations").where("role = 'user'").select("conv_id", "turn", x.route(F.col("text")).alias("route"))


@R.add(f"""
WITH h AS (SELECT *, max(CASE WHEN (role = 'user' AND {_any(_NORMAL, x.HUMAN_SUPPORT)}) OR (role <> 'user' AND {_rlike('text', x.HANDOFF_REPLY)}) THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM conversations)
SELECT conv_id, turn FROM h WHERE cut IS NULL OR turn > cut
""")
def after_last_handoff(t: Tables) -> DataFrame:
    m = t("conversations")
    handoff = F.when(F.col("role") == "user", x.human_support(F.col("text"))).otherwise(x.matches(F.col("text"), x.HANDOFF_REPLY))
    rows = m.withColumn("cut", F.max(F.when(handoff, F.col("turn"))).over(Window.partitionBy("conv_id")))
    return rows.where(F.col("cut").isNull() | (F.col("turn") > F.col("cut"))).select("conv_id", "turn")


@R.add("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 12 AND role IN ('user', 'assistant')
""")
def last_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").withColumn("k", F.row_number().over(w)).where((F.col("k") <= 12) & F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


@R.add("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
       coalesce(last_value(CASE WHEN role = 'assistant' THEN length(text) % 5 = 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before
FROM conversations
""")
def previous_user(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role, c: F.last(F.when(F.col("role") == role, c), ignorenulls=True).over(w)
    return t("conversations").select("conv_id", "turn", last("user", F.col("text")).alias("before"), F.coalesce(last("assistant", F.length("text") % 5 == 0), F.lit(False)).alias("failed_before"))


_TERMS = Sql(f"""list_distinct(list_transform(list_filter({TOKENS.format('{0}')}, lambda w: w NOT IN ({_LIST(x.TERM_STOP_WORDS)})), lambda w: CASE WHEN length(w) <= 4 OR NOT ends_with(w, 's') OR regexp_matches(w, '(?:ss|us|is)$') THEN w
WHEN regexp_matches(w, '(?:ch|sh|x|z|s)es$') THEN left(w, length(w) - 2) ELSE left(w, length(w) - 1) END))""")


@R.add(f"""
WITH q AS (SELECT conv_id, turn, {_TERMS.format('text')} AS a FROM conversations WHERE role = 'user'), p AS (SELECT item_id, {_TERMS.format('text')} AS b FROM benchmark),
s AS (SELECT conv_id, turn, item_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) END, 6) AS score FROM q, p)
SELECT conv_id, turn, arg_max(item_id, score * 1e6 * 1e4 - item_id) AS item_id, max(score) AS score, max(score) >= {x.PINNED_THRESHOLD} AS pinned FROM s WHERE score > 0 GROUP BY conv_id, turn
""")
def pinned_match(t: Tables) -> DataFrame:
    return match_pins(t("conversations").where("role = 'user'"), t("benchmark"))


def match_pins(questions: DataFrame, pins: DataFrame) -> DataFrame:
    """The best curated phrasing for each question that shares a term with one.

    Only phrasings that share a term can score, so both sides meet on their terms instead of in all pairs.
    """
    q = questions.select("conv_id", "turn", x.term_set(F.col("text")).alias("a")).select("conv_id", "turn", F.size("a").alias("na"), F.explode("a").alias("term"))
    p = pins.select("item_id", x.term_set(F.col("text")).alias("b")).select("item_id", F.size("b").alias("nb"), F.explode("b").alias("term"))
    both = q.join(p, "term").groupBy("conv_id", "turn", "item_id", "na", "nb").agg(F.count("*").alias("n"))
    score = both.select("conv_id", "turn", "item_id", F.round(F.col("n") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("score"))
    best = score.groupBy("conv_id", "turn").agg(F.min(F.struct((-F.col("score")).alias("s"), "item_id")).alias("b"))
    return best.select("conv_id", "turn", "b.item_id", (-F.col("b.s")).alias("score"), (-F.col("b.s") >= x.PINNED_THRESHOLD).alias("pinned"))


@R.add("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, max(turn) AS last_turn, arg_max(left(regexp_replace(text, '\\s+', ' ', 'g'), 90), turn) AS last_message,
       arg_min(CASE WHEN role = 'user' THEN left(regexp_replace(text, '\\s+', ' ', 'g'), 90) END, CASE WHEN role = 'user' THEN turn END) AS title,
       CAST(count(*) FILTER (WHERE role = 'assistant' AND turn > 2) AS BIGINT) AS unread
FROM conversations GROUP BY conv_id
""".replace("\\\\", "\\"))
def inbox(t: Tables) -> DataFrame:
    short = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 90)
    user = F.col("role") == "user"
    return t("conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by(short, "turn").alias("last_message"),
        F.min_by(F.when(user, short), F.when(user, F.col("turn"))).alias("title"), F.count_if((F.col("role") == "assistant") & (F.col("turn") > 2)).alias("unread"),
    )


@R.add("""
SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS thread FROM conversations GROUP BY conv_id
""")
def thread_detail(t: Tables) -> DataFrame:
    entry = F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("e"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return rows.select("conv_id", F.array_join("x.e", ",").alias("thread"))


@R.add(rf"""
WITH d AS (SELECT doc_id, list_slice({DISTINCT.format('e')}, 1, 2) AS emails, p FROM (
  SELECT doc_id, regexp_extract_all(text, '(?i){x.EMAIL}') AS e, list_filter(list_transform(regexp_extract_all(text, '{x.PHONE}'), lambda v: trim(v)), lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) AS p FROM documents))
SELECT doc_id, array_to_string(emails, ' ') AS emails, array_to_string(list_slice({DISTINCT.format('p')}, 1, 2), ' ') AS phones FROM d WHERE len(emails) > 0 OR len(p) > 0
""")
def contact_details(t: Tables) -> DataFrame:
    emails = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("(?i)" + x.ascii_edges(x.EMAIL)), F.lit(0))), 1, 2)
    found = F.transform(F.regexp_extract_all("text", F.lit(x.PHONE), F.lit(0)), lambda v: F.trim(v))
    phones = F.slice(F.array_distinct(F.filter(found, lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15))), 1, 2)
    rows = t("documents").select("doc_id", F.array_join(emails, " ").alias("emails"), F.array_join(phones, " ").alias("phones"))
    return rows.where("emails <> '' OR phones <> ''")


@R.add(f"""
WITH m AS (SELECT conv_id, max(CASE WHEN role = 'user' AND {_any(_NORMAL, x.HUMAN_SUPPORT)} THEN turn END) AS asked, max(CASE WHEN role <> 'user' AND {_rlike('text', x.HANDOFF_REPLY)} THEN turn END) AS sent FROM conversations GROUP BY conv_id)
SELECT CAST(count(*) AS BIGINT) AS conversations, CAST(count(*) FILTER (asked IS NOT NULL) AS BIGINT) AS handoffs, CAST(count(*) FILTER (asked IS NOT NULL AND (sent IS NULL OR sent < asked)) AS BIGINT) AS pending FROM m
""")
def pending_handoffs(t: Tables) -> DataFrame:
    """Conversations that ask for a person, and those whose request nobody has taken up."""
    asked = F.max(F.when((F.col("role") == "user") & x.human_support(F.col("text")), F.col("turn")))
    sent = F.max(F.when((F.col("role") != "user") & x.matches(F.col("text"), x.HANDOFF_REPLY), F.col("turn")))
    rows = t("conversations").groupBy("conv_id").agg(asked.alias("asked"), sent.alias("sent"))
    waiting = F.col("asked").isNotNull() & (F.col("sent").isNull() | (F.col("sent") < F.col("asked")))
    return rows.agg(F.count("*").alias("conversations"), F.count_if(F.col("asked").isNotNull()).alias("handoffs"), F.count_if(waiting).alias("pending"))


#: Turns of one page of a thread.
THREAD_PAGE = 4


def thread_pages(messages: DataFrame, attachments: DataFrame, size: int) -> DataFrame:
    """conv_id, page and messages (turn, role, text, attachments of id and kind, each list in order): threads nested two levels deep.

    A page holds the messages of ``size`` turns, so no row grows with its conversation and none is gathered whole; attachments
    (conv_id, turn, id, kind) are nested in their message before messages are nested in their page. Attachments without a message are left out.
    """
    keys = ["conv_id", "turn"]
    held = attachments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "kind"))).alias("attachments"))
    none = F.array().cast(held.schema["attachments"].dataType)
    rows = messages.select(*keys, "role", "text").join(held, keys, "left").withColumn("attachments", F.coalesce("attachments", none))
    page = F.floor(F.col("turn") / size).alias("page")
    return rows.groupBy("conv_id", page).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "attachments"))).alias("messages"))


@R.add(f"""
WITH a AS (SELECT user_id AS conv_id, event_id % 8 AS turn, string_agg(event_id || '=' || event_type, ';' ORDER BY event_id) AS files FROM events GROUP BY ALL)
SELECT conv_id, turn // {THREAD_PAGE} AS page, string_agg(role || ':' || length(text) || '[' || coalesce(files, '') || ']', ',' ORDER BY turn) AS thread FROM conversations LEFT JOIN a USING (conv_id, turn) GROUP BY ALL
""")
def thread_with_attachments(t: Tables) -> DataFrame:
    """Pages of each thread, its messages' attachments within; a user's events are the attachments of one of the eight turns."""
    files = t("events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 8).alias("turn"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    pages = thread_pages(t("conversations"), files, THREAD_PAGE)
    named = lambda m: F.array_join(F.transform(m["attachments"], lambda a: F.concat(a["id"].cast("string"), F.lit("="), a["kind"])), ";")
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"]).cast("string"), F.lit("["), named(m), F.lit("]")))
    return pages.select("conv_id", "page", F.array_join(line, ",").alias("thread"))
