"""Repair of conversation structure by weighted finite-state composition.

A conversation is an acceptor, a chain of its rows; the edit transducer keeps, reroles, deletes or inserts rows at a cost; the grammar's acceptor
takes ``(s?(ua)+)?`` over the initials of roles. Their composition has a state for every row and grammar state and is built as the
shortest path asks for it, from the last row to the first. Weights are pairs (cost, labels of the path), of which the lexicographically least is sought. Adding a label in
front keeps the order of two such pairs, and of each state at most one edge bears a label, so cost and first label decide.

Rows are put in order by a distributed sort and numbered; a row of the search is one character that says all the search needs, and
these are packed in blocks before the blocks of a conversation meet. Texts never gather: they pass, in order, by the task that takes the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered
from .conversation_trie import CRC

#: Costs of the edits, and what a truncated row adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of the contract, and ends of a complete text.
SPACE = " \t\n\x0b\x0c\r"
#: Rows in one packed block.
BLOCK = 4096

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where each initial leads, and where an edit that may choose leads.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
CHOSEN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
FINAL = (0, 3)
INITIALS = "suax"
#: A row's character: one of 16, by kind (sound, duplicate, truncated, blank) and, within a kind, by initial (x: any other).
CODES = "ABCDEFGHIJKLMNOP"
SOUND, DUPLICATE, CUT, BLANK = range(4)
FAR = 1 << 40

PATH = "key string, n_rows long, cost long, blank long, duplicate long, truncated long, illegal long, audit string"


def name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage() -> Column:
    """What happens to a row: 0 to 4 as damaged() has it, else nothing."""
    return F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text after damage by the CRC-32 of conv_id:turn; nulls are one space, so the rows of a null conv_id are one conversation, of key ' '."""
    own = conversations.select(name("conv_id").alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), damage().alias("code"))
    own = own.where("code <> 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("key", "turn", role.alias("role"), text.alias("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) with n: each conversation's rows have consecutive numbers, by turn (nulls first), then role, then text."""
    return numbered(rows.repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text"), "n")


def coded(rows: DataFrame) -> DataFrame:
    """key, n, code of in_order() rows; the code is a character of CODES, for the row's first fault and its role's initial."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = rows.select("key", "n", F.left("role", F.lit(1)).alias("initial"), last.alias("last"), same.alias("same"))
    first = own.groupBy("key", "same").agg(F.min("n").alias("n")).withColumn("first", F.lit(True))
    own = own.join(first, ["key", "same", "n"], "left")
    kind = F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("last").isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.coalesce(*(F.when(F.col("initial") == c, k) for k, c in enumerate(INITIALS[:3])), F.lit(3))
    return own.select("key", "n", F.substring(F.lit(CODES), kind * 4 + initial + 1, 1).alias("code"))


def packed(codes: DataFrame) -> DataFrame:
    """key, n (of the first row), codes: up to BLOCK rows of a conversation in one text."""
    block = codes.groupBy("key", F.floor(F.col("n") / BLOCK).alias("block")).agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "code"))).alias("rows"))
    return block.select("key", "n", F.array_join("rows.code", "").alias("codes"))


@cache
def edges(codes: str, later: tuple[int, ...]) -> tuple[tuple[int, ...], int, str]:
    """The states before a row, from the costs of the states after it: costs less their least, that least, and each state's first label.

    ``codes`` is the row's character, or empty behind the last row. Only differences of costs matter, of which there are few, so composed states are made once each.
    """
    if not codes:
        best = [(0, "") if q in FINAL else (FAR, "") for q in range(4)]
    else:
        kind, initial = divmod(CODES.index(codes), 4)
        add, best = TRUNCATED * (kind == CUT), []
        for q in range(4):
            ways = [(DELETE + later[q], "D")]
            if kind in (SOUND, CUT):
                ways.append((REROLE + add + later[CHOSEN[q]], "R"))
                if (to := STEP[INITIALS[initial]].get(q)) is not None:
                    ways.append((KEEP + add + later[to], "K"))
            best.append(min(ways))
    for _ in range(3):  # no shortest path inserts more in one place: two lead back to the same state
        for q in range(4):
            best[q] = min(best[q], (INSERT + best[CHOSEN[q]][0], "I"))
    least = min(c for c, _ in best)
    return tuple(c - least for c, _ in best), least, "".join(label or "." for _, label in best)


def shortest(codes: str) -> tuple[int, str]:
    """Cost and labels of the cheapest path through the composition, of equally cheap ones the least in ASCII order."""
    costs, total, label = edges("", ())
    labels = [label]
    for code in reversed(codes):
        costs, least, label = edges(code, costs)
        total += least
        labels.append(label)
    out, q = [], 0
    for code, label in zip(codes, reversed(labels[1:])):
        while label[q] == "I":
            out.append("I")
            q = CHOSEN[q]
        out.append(label[q])
        if label[q] != "D":
            q = CHOSEN[q] if label[q] == "R" else STEP[INITIALS[CODES.index(code) % 4]][q]
    while labels[0][q] == "I":
        out.append("I")
        q = CHOSEN[q]
    return total + costs[0], "".join(out)


def illegal(codes: str) -> int:
    """Neighbours whose initials are none of su, ua, au."""
    initials = "".join(INITIALS[CODES.index(c) % 4] for c in codes)
    return max(len(codes) - 1, 0) - sum(initials.count(pair) for pair in ("su", "ua", "au"))


def paths(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of PATH for each conversation; blocks come sorted by conversation and number. A conversation is held as one character a row, as its audit is in the result."""
    key, held = None, []

    def row() -> tuple:
        codes = "".join(held)
        counts = [sum(codes.count(c) for c in CODES[4 * k : 4 * k + 4]) for k in (BLANK, DUPLICATE, CUT)]
        cost, audit = shortest(codes)
        return (key, len(codes), cost, *counts, illegal(codes), audit)

    names = [x.split()[0] for x in PATH.split(", ")]
    for batch in batches:
        out = []
        for k, codes in zip(batch["key"], batch["codes"]):
            if k != key:
                if held:
                    out.append(row())
                key, held = k, []
            held.append(codes)
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([row()], columns=names)


def walked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PATH with repaired_sha256: a conversation's path comes first and then its rows, each of which is edited as the audit says and digested at once."""
    names = [x.split()[0] for x in PATH.split(", ")]
    path, digest, at, q, first = None, hashlib.sha256(), 0, 0, True

    def line(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    def inserted() -> None:
        nonlocal at, q
        audit = path[-1]
        while at < len(audit) and audit[at] == "I":
            q, at = CHOSEN[q], at + 1
            line(ROLE[q], "")

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.audit is not None:
                if path is not None:
                    inserted()
                    out.append((*path, digest.hexdigest()))
                path, digest, at, q, first = tuple(getattr(r, c) for c in names), hashlib.sha256(), 0, 0, True
                continue
            inserted()
            edit, at = path[-1][at], at + 1
            if edit == "K":
                q = STEP[r.role[0]][q]
                line(r.role, r.text)
            elif edit == "R":
                q = CHOSEN[q]
                line(ROLE[q], r.text)
        yield pd.DataFrame(out, columns=[*names, "repaired_sha256"])
    if path is not None:
        inserted()
        yield pd.DataFrame([(*path, digest.hexdigest())], columns=[*names, "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """PATH and repaired_sha256 of every conversation of rows (key, turn, role, text; no nulls but of turn)."""
    rows = in_order(rows)
    best = packed(coded(rows)).repartition("key").sortWithinPartitions("key", "n").mapInPandas(paths, PATH)
    names = [x.split() for x in PATH.split(", ")]
    head = best.select("*", F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = rows.select("key", *(F.lit(None).cast(kind).alias(c) if c != "n_rows" else F.lit(0).cast("long").alias(c) for c, kind in names[1:]), "n", "role", "text")
    both = head.union(body.select(head.columns))
    return both.repartition("key").sortWithinPartitions("key", "n").mapInPandas(walked, PATH + ", repaired_sha256 string")


def structure_repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text): its faults after damage, the cheapest repair and the digest of what it gives.

    gaps, blank, duplicate, truncated, illegal, cost (longs), audit and repaired_sha256 are those of the rows after damaged(); a conversation without
    any has zeros, an empty audit and the digest of the empty text. Rows of equal turns are ordered by role and text; repeated rows are duplicates. An empty table gives
    an empty result; other columns are not read.
    """
    # a turn is counted once before the turns of a conversation meet
    spans = conversations.select("conv_id", F.when(damage() != 0, F.col("turn")).alias("turn")).distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    spans = spans.select("conv_id", name("conv_id").alias("key"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    out = spans.join(repair(damaged(conversations)), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: DuckDB SQL of the query: each conversation's best repair from every state of the grammar (q), from its last row up, as structs (cost, audit, lines) that compare in that order.
#: An insertion leads from state 1 to 3, from 2 to 3, from 4 to 3 and from 3 to 4 (lists count from 1).
_EXTEND = "list_transform(range(1, 5), lambda q: list_min([{0}[q], {{'c': 5 + {0}[[3, 3, 4, 3][q]].c, 'a': 'I' || {0}[[3, 3, 4, 3][q]].a, 't': list_prepend(['user', 'user', 'assistant', 'user'][q] || ':', {0}[[3, 3, 4, 3][q]].t)}}]))"
SQL = f"""
WITH RECURSIVE crc_names AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
{CRC},
d AS (SELECT conv_id, turn, crc % 20 AS k, CASE WHEN crc % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
      FROM conversations JOIN crc_of ON x = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
e AS (SELECT * FROM d WHERE k <> 0 UNION ALL SELECT * FROM d WHERE k = 3),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
f AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy, left(role, 1) AS s, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
g AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN copy > 1 THEN 'd' WHEN z IN ('.', '!', '?') THEN '' ELSE 't' END AS fault FROM f),
n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (b IS NOT NULL AND b || s NOT IN ('su', 'ua', 'au')) AS illegal,
             max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM g GROUP BY 1),
z AS (SELECT [{{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}, {{'c': 1000000, 'a': '', 't': CAST([] AS VARCHAR[])}}, {{'c': 1000000, 'a': '', 't': CAST([] AS VARCHAR[])}}, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}] AS v),
z2 AS (SELECT {_EXTEND.format("v")} AS v FROM z),
z3 AS (SELECT {_EXTEND.format("v")} AS v FROM z2),
run AS (
  SELECT conv_id, n + 1 AS i, v FROM n, z3
  UNION ALL
  SELECT conv_id, i, {_EXTEND.format("v")} FROM (SELECT conv_id, i, {_EXTEND.format("v")} AS v FROM (
    SELECT g.conv_id, g.i, list_transform(range(1, 5), lambda q: list_min(list_filter([
      {{'c': 2 + v[q].c, 'a': 'D' || v[q].a, 't': v[q].t}},
      CASE WHEN fault IN ('', 't') THEN {{'c': 1 + (CASE fault WHEN 't' THEN 5 ELSE 0 END) + v[[3, 3, 4, 3][q]].c, 'a': 'R' || v[[3, 3, 4, 3][q]].a, 't': list_prepend(['user', 'user', 'assistant', 'user'][q] || ':' || text, v[[3, 3, 4, 3][q]].t)}} END,
      CASE WHEN fault IN ('', 't') AND s = 's' AND q = 1 THEN {{'c': (CASE fault WHEN 't' THEN 5 ELSE 0 END) + v[2].c, 'a': 'K' || v[2].a, 't': list_prepend(role || ':' || text, v[2].t)}}
           WHEN fault IN ('', 't') AND s = 'u' AND q <> 3 THEN {{'c': (CASE fault WHEN 't' THEN 5 ELSE 0 END) + v[3].c, 'a': 'K' || v[3].a, 't': list_prepend(role || ':' || text, v[3].t)}}
           WHEN fault IN ('', 't') AND s = 'a' AND q = 3 THEN {{'c': (CASE fault WHEN 't' THEN 5 ELSE 0 END) + v[4].c, 'a': 'K' || v[4].a, 't': list_prepend(role || ':' || text, v[4].t)}} END], lambda w: w IS NOT NULL))) AS v
    FROM run JOIN g ON g.conv_id IS NOT DISTINCT FROM run.conv_id AND g.i = run.i - 1))
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN run ON run.conv_id IS NOT DISTINCT FROM c.conv_id AND run.i = 1
"""
