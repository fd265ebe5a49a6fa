"""A prefix trie of conversations: distributed MSD radix partitioning over dictionary-encoded turns, multikey quicksort inside buckets.

Turns (role, text) get dense ids from a dictionary; from then on only ids travel, a row a turn, with an end mark after each conversation's
last turn. A bucket is a set of conversations that share their first turns. A bucket of more than ``local_rows`` rows takes a distributed
round: the turns that all its members share become a chain of nodes at once, and the first turn in which they differ deals them into smaller
buckets. All other buckets are local: a task sorts each by multikey quicksort, whose recursion emits the nodes. Subtree sums
then rise through the rounds from the last to the first.

No conversation is ever gathered outside a local bucket, so a very long one, or a hot first turn, spreads over tasks. Every round is a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, numbered

#: Rows (turns and end marks) of the largest bucket that one task finishes.
LOCAL_ROWS = 20_000
#: The end mark's id; it sorts before every turn's.
END = -1
#: Conversation ids in one piece of a node's list of ends; pieces of a chain's sums.
PIECE = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), id (of the dictionary of turns), size (UTF-8 bytes of the text), len (turns of the conversation).

    Turns are ordered by turn (null first), then role, then text; a null role or text is empty. Rows without a
    conversation's id belong to none and are left out. Positions come from the row numbers of the sorted, written rows.
    """
    own = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    own = numbered(own.select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("size")), "n")
    words = numbered(own.select("key").distinct(), "id")
    starts = own.groupBy("conv_id").agg(F.min("n").alias("start"), F.count("*").alias("len"))
    return own.join(words, "key").join(starts, "conv_id").select("conv_id", (F.col("n") - F.col("start")).alias("pos"), "id", "size", "len")


def spliced(rows: DataFrame, donor: Column, head: Column) -> DataFrame:
    """Every conversation with its first ``head`` turns replaced by those of another one: turns() again, and a row of pos and id null for a conversation left without turns.

    ``donor`` and ``head`` are columns made of conv_id. A donor with fewer turns gives all it has, an absent one none.
    """
    convs = rows.groupBy("conv_id").agg(F.max("len").alias("len")).select("conv_id", "len", donor.alias("donor"), head.cast("long").alias("head"))
    have = convs.select(F.col("conv_id").alias("donor"), F.col("len").alias("there"))
    convs = convs.join(have, "donor", "left").withColumn("given", F.least("head", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.withColumn("new", F.col("given") + F.greatest(F.col("len") - F.col("head"), F.lit(0))))
    reach = convs.agg(F.coalesce(F.max("given"), F.lit(0))).first()[0]
    gifts = convs.select(F.col("conv_id").alias("to"), F.col("donor").alias("conv_id"), "given", "new")
    first = rows.where(F.col("pos") < reach).drop("len").join(gifts, "conv_id").where("pos < given").select(F.col("to").alias("conv_id"), "pos", "id", "size", F.col("new").alias("len"))
    rest = rows.drop("len").join(convs, "conv_id").where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "id", "size", F.col("new").alias("len"))
    none = convs.where("new = 0").select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("pos", "id", "size")), F.lit(0).cast("long").alias("len"))
    return first.union(rest).union(none)


def trie(rows: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row per node of the trie of turns() or spliced() rows: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, (members - 1) x bytes of each node's last text), ends_sha256 (of the ids of members
    that end here, ascending, comma-joined). A table without conversations has no nodes.
    """
    spark = rows.sparkSession
    marks = rows.select("conv_id", "len").distinct().select("conv_id", F.col("len").alias("pos"), F.lit(END).cast("long").alias("id"), F.lit(0).cast("long").alias("size"), "len")
    live = rows.where("pos is not null").select(marks.columns).union(marks)
    # a bucket: top (smallest member), d (turns shared by its definition), up (its parent node's smallest member), n (members), last (bytes of the turn that made it), weight (rows)
    bucket = ["top", "d", "up", "n", "last", "weight"]
    live = materialize(live)
    whole = live.agg(F.min("conv_id").alias("top"), F.count(F.when(F.col("id") == END, 1)).alias("n"), F.count("*").alias("weight"))
    top, n, weight = whole.first()
    if not n:
        return spark.createDataFrame([], NODE).drop("top")
    head = [F.lit(x).cast("long").alias(c) for x, c in zip((top, 0, None, n, 0, weight), bucket)]
    live = live.select(*head, "conv_id", "pos", "id", "size", "len")
    local, rounds = [live.where(F.col("weight") <= local_rows)], []
    while weight > local_rows:
        big = live.where(F.col("weight") > local_rows)
        at = big.groupBy(*bucket, "pos").agg(F.count("*").alias("here"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("size").alias("size"))
        at = materialize(at)
        splits = at.where((F.col("here") < F.col("n")) | (F.col("lo") != F.col("hi")) | (F.col("hi") == END)).groupBy("top", "d").agg(F.min("pos").alias("m"))
        cut = materialize(big.join(splits, ["top", "d"]).where("pos >= m"))
        turn = cut.where("pos = m")
        ends = turn.where(F.col("id") == END).select("top", F.col("m").alias("depth"), "conv_id")
        child = turn.where(F.col("id") != END).groupBy("top", "d", "m", "id").agg(F.min("conv_id").alias("to"), F.count("*").alias("members"), F.max("size").alias("bytes"), F.sum(F.col("len") - F.col("m")).alias("rows"))
        child = materialize(child)
        moves = turn.where(F.col("id") != END).select("top", "d", "id", "conv_id").join(child, ["top", "d", "id"])
        moves = moves.select("conv_id", F.col("to").alias("top"), (F.col("m") + 1).alias("d"), F.col("top").alias("up"), F.col("members").alias("n"), F.col("bytes").alias("last"), F.col("rows").alias("weight"))
        rounds.append((at.join(splits, ["top", "d"]).where("pos <= m"), child, ends))
        live = materialize(cut.where("pos > m").select("conv_id", "pos", "id", "size", "len").join(moves, "conv_id").select(*bucket, "conv_id", "pos", "id", "size", "len"))
        local.append(live.where(F.col("weight") <= local_rows))
        weight = live.agg(F.coalesce(F.max("weight"), F.lit(0))).first()[0]

    small = local[0]
    for x in local[1:]:
        small = small.union(x)
    small = small.select("top", "d", "up", "last", "conv_id", "pos", "id", "size").repartition("top", "d").sortWithinPartitions("top", "d", "conv_id", "pos")
    done = materialize(small.mapInPandas(finished, NODE))
    for chain, child, ends in reversed(rounds):
        done = done.union(materialize(chained(chain, child, done.where("top"), ends)))
    return done.drop("top")


def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of whole buckets, which come sorted by bucket, conversation and position; one bucket is held at a time, and the part of a batch."""
    names = [x.split()[0] for x in NODE.split(", ")]

    def frames(out: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"parent_conv_id": "Int64"})

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        key = held[0].iloc[0][["top", "d"]].to_list() if len(held[0]) else None
        if key is None or (len(batch) and [batch.top.iloc[-1], batch.d.iloc[-1]] == key):
            continue
        all_ = pd.concat(held)
        last = (all_.top == all_.top.iloc[-1]) & (all_.d == all_.d.iloc[-1])
        held = [all_[last]]
        yield frames([x for bucket in buckets(all_[~last]) for x in bucket])
    if held and len(all_ := pd.concat(held)):
        yield frames([x for bucket in buckets(all_) for x in bucket])


def buckets(rows: pd.DataFrame) -> Iterator[list[list]]:
    top, d, conv, ids, sizes = (rows[c].to_numpy() for c in ("top", "d", "conv_id", "id", "size"))
    up, last = rows["up"].to_numpy(dtype=object, na_value=None), rows["last"].to_numpy()
    new = np.r_[True, (top[1:] != top[:-1]) | (d[1:] != d[:-1])]
    starts = np.flatnonzero(new | np.r_[True, conv[1:] != conv[:-1]])
    edges = np.r_[starts, len(rows)].tolist()
    first = [k for k, s in enumerate(starts.tolist()) if new[s]] + [len(starts)]
    for a, b in zip(first, first[1:]):
        s = edges[a]
        spans = list(zip(edges[a:b], edges[a + 1 : b + 1]))
        parent = None if pd.isna(up[s]) else int(up[s])
        yield nodes([int(conv[x]) for x, _ in spans], [ids[x:y].tolist() for x, y in spans], [sizes[x:y].tolist() for x, y in spans], int(d[s]), parent, int(last[s]))


def nodes(convs: list[int], ids: list[list[int]], sizes: list[list[int]], depth: int, parent: int | None, size: int) -> list[list]:
    """The nodes of conversations (ascending) that share their first ``depth`` turns; ids holds each one's further turns and END.

    Multikey quicksort: a group that shares k more turns is a node, and is split around one member's next turn into less, equal
    and more; the equal ones share k + 1 turns and are the next node. Groups stay in order of id, so a node's first member is its smallest.
    """
    out: list[list] = []
    above: list[int] = []
    work = [(list(range(len(convs))), 0, -1, size)]
    while work:
        group, k, over, size = work.pop()
        own = len(out)
        ends: list[int] = []
        children = 0
        parts = [group]
        while parts:
            part = parts.pop()
            pivot = ids[part[len(part) // 2]][k]
            same = [g for g in part if ids[g][k] == pivot]
            if len(same) < len(part):
                parts += [x for x in ([g for g in part if ids[g][k] < pivot], [g for g in part if ids[g][k] > pivot]) if x]
            if pivot == END:
                ends = same
            else:
                children += 1
                work.append((same, k + 1, own, sizes[same[0]][k]))
        digest = hashlib.sha256(",".join(str(convs[g]) for g in ends).encode()).hexdigest() if ends else EMPTY
        out.append([convs[group[0]], depth + k, parent if over < 0 else out[over][0], len(group), children, int(not children), (len(group) - 1) * size, digest, over < 0])
        above.append(over)
    for x, over in zip(reversed(out), reversed(above)):  # children stand behind their parents
        if over >= 0:
            out[over][5] += x[5]
            out[over][6] += x[6]
    return out


def chained(chain: DataFrame, child: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of one distributed round: each bucket's shared turns, the last of which has its children; tops are finished nodes, of which those of its children count."""
    # the node at depth pos stands before the turn at pos; its own last turn is the one before, so sizes move on by one
    keys = ["top", "d"]
    size = chain.select(*keys, (F.col("pos") + 1).alias("pos"), F.col("size").alias("before"))
    chain = chain.select(*keys, "up", "n", "last", "m", "pos").join(size, [*keys, "pos"], "left")
    chain = chain.withColumn("own", (F.col("n") - 1) * F.coalesce("before", "last")).withColumn("piece", F.floor(F.col("pos") / PIECE))
    # sums from the end of the chain: of later pieces, and inside the piece
    later = chain.groupBy(*keys, "piece").agg(F.sum("own").alias("s"))
    later = later.select(*keys, "piece", (F.sum("s").over(Window.partitionBy(*keys).orderBy(F.desc("piece"))) - F.col("s")).alias("later"))
    inside = F.sum("own").over(Window.partitionBy(*keys, "piece").orderBy(F.desc("pos")))
    chain = chain.withColumn("inside", inside).join(later, [*keys, "piece"])
    kids = child.groupBy("top", "d").agg(F.count("*").alias("kids"))
    sums = tops.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("top"), (F.col("depth") - 1).alias("m")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    digests = hashed(ends)
    out = chain.join(kids, keys, "left").join(sums, ["top", "m"], "left").join(digests, (F.col("top") == F.col("e_top")) & (F.col("pos") == F.col("e_depth")), "left")
    last = F.col("pos") == F.col("m")
    return out.select(
        F.col("top").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") > F.col("d"), F.col("top")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("inside") + F.col("later") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
        (F.col("pos") == F.col("d")).alias("top"),
    )


def hashed(ends: DataFrame) -> DataFrame:
    """e_top, e_depth, sha of each node's ends (top, depth, conv_id). A digest is sequential, so ids are packed into texts where they lie, and only these meet, in order, in one task."""
    sorted_ = ends.repartitionByRange("top", "depth", "conv_id").sortWithinPartitions("top", "depth", "conv_id")
    pieces = sorted_.mapInPandas(packed, "top long, depth long, least long, ids string")
    return pieces.repartition("top", "depth").sortWithinPartitions("top", "depth", "least").mapInPandas(digested, "e_top long, e_depth long, sha string")


def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), PIECE):
            part = batch.iloc[k : k + PIECE]
            names = part.conv_id.astype(str)
            yield pd.DataFrame({"top": part.top, "depth": part.depth, "least": part.conv_id, "ids": names}).groupby(["top", "depth"], sort=False, as_index=False).agg({"least": "min", "ids": ",".join})


def digested(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for top, depth, ids in zip(batch.top, batch.depth, batch.ids):
            if key == (top, depth):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (top, depth), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["e_top", "e_depth", "sha"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["e_top", "e_depth", "sha"])


def prefix_trie(conversations: DataFrame, donor: Column | None = None, head: Column | None = None, local_rows: int = LOCAL_ROWS, **columns: str) -> DataFrame:
    """trie() of a table of turns; with donor and head (columns made of conv_id), of its spliced() conversations.

    Other columns are not read. See turns() for nulls and ties; repeated rows are repeated turns; an empty table gives no nodes.
    """
    rows = turns(conversations, **columns)
    if donor is not None and head is not None:
        rows = spliced(materialize(rows), donor, head)
    return trie(rows, local_rows)


#: DuckDB SQL of a column crc(x): the unsigned CRC-32 of an ASCII text, by a table made from its polynomial.
CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crcs FROM (SELECT unnest(range(256)) AS i)),
crc_of AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(x, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), 4294967295) AS crc FROM crc_names, crc_table)"""

#: DuckDB SQL of the query: nodes are digests of prefixes, and a node's subtree is found by its nodes' own smallest members.
SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc_names AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS x FROM o),
{CRC},
c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, crc % 9 AS h FROM (SELECT DISTINCT conv_id FROM o) JOIN crc_of ON x = CAST(conv_id AS VARCHAR)),
r AS (SELECT c.conv_id, 0 AS piece, pos, role, text FROM c JOIN o ON o.conv_id = donor AND pos < h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN o USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth, sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY piece, pos)),
p AS (SELECT conv_id, bytes, depth, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM s UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY 1),
n AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM p GROUP BY 1),
k AS (SELECT up AS node, count(*) AS kids FROM n GROUP BY 1),
t AS (SELECT p.node, count(*) FILTER (kids IS NULL) AS n_leaves, sum(saved) AS saved_tokens FROM n LEFT JOIN k ON k.node = n.node JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1),
x AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM e GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node JOIN t ON t.node = n.node LEFT JOIN x ON x.node = n.node
"""
