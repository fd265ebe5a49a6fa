"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source of weight a out of D in all is cut into blocks of about equal length. Its block j (from 0) is
released at slot floor(j D / a) and due by slot ceil((j + 1) D / a); the earliest deadline goes first. After every slot
each source then has less than one block more or less than its share. The pattern repeats after D slots, so
one period is scheduled, by a fold over its slots, and every block finds its slot by arithmetic. Periods beyond MAX_PERIOD
slots come from two heaps in one task, the only Python here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize

#: Slots of a period that the native fold schedules, and whose table is broadcast; a longer one takes long_schedule() and a shuffle join.
MAX_PERIOD = 10_000
#: Slots of one piece of the fold.
PIECE = 256
#: Hex digits of the key that part a source for counting: 16 ** 3 parts of each source.
DIGITS = 3


def schedule(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """One period: source, weight, block (0 to weight - 1), at (slot), release, deadline, period."""
    if not weights or min(weights.values()) < 1:
        raise ValueError("every source needs a weight of 1 or more")
    if (total := sum(weights.values())) > MAX_PERIOD:
        raise ValueError(f"weights sum to {total}; at most {MAX_PERIOD} are scheduled")
    # sources of one weight have the same releases and deadlines, so they take each block in turn, by name: the state is one block and one turn a weight
    names = sorted(weights)
    sizes = sorted(set(weights.values()))
    groups = [[i for i, n in enumerate(names) if weights[n] == a] for a in sizes]
    array = lambda x: F.array(*map(F.lit, x))
    one = spark.range(1).select(array(names).alias("s"), array(sizes).alias("a"), F.array(*map(array, groups)).alias("of"))

    def job(now: Column, g: Column) -> Column:
        j, a = now["block"], F.get(F.col("a"), g)
        return F.struct(F.ceil((j + 1) * total / a).cast("int").alias("deadline"), F.get(F.get(F.col("of"), g), now["turn"]).alias("i"), F.floor(j * total / a).cast("int").alias("release"), j.alias("block"), g.alias("g"))

    def step(state: Column, t: Column) -> Column:
        pick = F.array_min(F.filter(F.transform(state["now"], job), lambda x: x["release"] <= t))
        last = lambda n, g: n["turn"] + 1 == F.size(F.get(F.col("of"), g))
        following = lambda n, g: F.struct((n["block"] + last(n, g).cast("int")).alias("block"), F.when(last(n, g), 0).otherwise(n["turn"] + 1).alias("turn"))
        moved = F.transform(state["now"], lambda n, g: F.when(g == pick["g"], following(n, g)).otherwise(n))
        return F.struct(moved.alias("now"), F.concat(state["out"], F.array(F.struct(t.alias("at"), *(pick[c].alias(c) for c in ("i", "block", "release", "deadline"))))).alias("out"))

    jobs = "array<struct<at:int,i:int,block:int,release:int,deadline:int>>"

    def piece(state: Column, first: Column) -> Column:
        # slots leave the fold in pieces: an array that grew by each slot would be copied at each
        slots = F.sequence(first, F.least(first + PIECE, F.lit(total)) - 1)
        begin = F.struct(state["now"].alias("now"), F.array().cast(jobs).alias("out"))
        return F.aggregate(slots, begin, step, lambda x: F.struct(x["now"].alias("now"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(F.transform("a", lambda _: F.struct(F.lit(0).alias("block"), F.lit(0).alias("turn"))).alias("now"), F.array().cast(f"array<{jobs}>").alias("out"))
    out = one.select("s", F.explode(F.flatten(F.aggregate(F.sequence(F.lit(0), F.lit(total - 1), F.lit(PIECE)), begin, piece)["out"])).alias("x"))
    weight = F.create_map(*(F.lit(v) for a, g in zip(sizes, groups) for i in g for v in (i, a)))
    return out.select(F.get("s", F.col("x.i")).alias("source"), F.element_at(weight, F.col("x.i")).alias("weight"), "x.block", "x.at", "x.release", "x.deadline", F.lit(total).alias("period"))


def long_schedule(weights: DataFrame, total: int) -> DataFrame:
    """schedule() of a table (source, weight) whose weights sum to total, for any total: the same jobs from two heaps.

    One task holds a job of each source, not the period, and no document passes through it; its slots leave as they are made.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sorted((s, int(a)) for b in batches for s, a in zip(b.source, b.weight))
        waiting, ready, out = [(0, i, 0) for i in range(len(own))], [], []
        for t in range(total):
            while waiting and waiting[0][0] <= t:
                release, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // own[i][1]), i, release, j))
            deadline, i, release, j = heapq.heappop(ready)
            source, a = own[i]
            out.append((source, a, j, t, release, deadline, total))
            if j + 1 < a:
                heapq.heappush(waiting, ((j + 1) * total // a, i, j + 1))
            if len(out) == 50_000 or t + 1 == total:
                yield pd.DataFrame(out, columns=["source", "weight", "block", "at", "release", "deadline", "period"])
                out = []

    return weights.repartition(1).mapInPandas(run, "source string, weight int, block int, at int, release int, deadline int, period int")


def mix(docs: DataFrame, weights: Mapping[str, int] | Column, block_chars: int, default_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with mix_block, mix_slot, mix_release and mix_deadline; reading by mix_slot mixes the sources.

    weights are a dict, or a column made of source_col alone. Within a source, documents come in the order of md5(id), then id and md5(text), and a document belongs to the block in which its
    first character falls; so a document longer than a block takes several and the next one starts later.
    A source without a weight gets default_weight; a null source is the source '' and a null text has no
    characters. When a source has no blocks left, its slots stay empty and the others go on: no row is dropped or repeated. An
    empty table gives an empty result; other columns pass through, and one that is named like a new column is an error.
    """
    if taken := {"mix_block", "mix_slot", "mix_release", "mix_deadline"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {min(taken)} already")
    name, default = F.coalesce(F.col(source_col), F.lit("")), F.lit(default_weight)
    if isinstance(weights, Column):
        weight = F.coalesce(weights, default)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in weights.items() for x in item)), name), default) if weights else default
    own = docs.select("*", name.alias("__s"), weight.cast("int").alias("__w"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__k"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("__n"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__t"))
    named = materialize(own.groupBy(F.col("__s").alias("source")).agg(F.max("__w").alias("weight")))
    total, least = named.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.min("weight"), F.lit(1))).first()
    if least < 1:
        raise ValueError("every source needs a weight of 1 or more")
    if total <= MAX_PERIOD:  # at most so many names
        table = F.broadcast(schedule(docs.sparkSession, {r.source: r.weight for r in named.collect()} or {"": 1}))
    else:
        table = materialize(long_schedule(named, int(total)))

    own = own.withColumn("__part", F.substring("__k", 1, DIGITS))
    # the hot source is counted in parts, whose sums are few, and only then numbered within each part
    sums = own.groupBy("__s", "__part").agg(F.sum("__n").alias("__sum"))
    sums = sums.select("__s", "__part", (F.sum("__sum").over(Window.partitionBy("__s").orderBy("__part")) - F.col("__sum")).alias("__base"))
    within = Window.partitionBy("__s", "__part").orderBy("__k", F.col(id_col), "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.join(sums, ["__s", "__part"]).withColumn("__at", F.col("__base") + F.sum("__n").over(within) - F.col("__n"))
    own = own.withColumn("mix_block", F.floor(F.col("__at") / block_chars).cast("long")).withColumn("__left", F.col("mix_block") % F.col("__w"))
    few = table.select(F.col("source").alias("__src"), F.col("block").cast("long").alias("__b"), F.col("at").alias("__slot"), F.col("release").alias("__r"), F.col("deadline").alias("__d"), F.col("period").alias("__p"))
    joined = own.join(few, (F.col("__s") == F.col("__src")) & (F.col("__left") == F.col("__b")))
    turn = F.expr("mix_block div __w") * F.col("__p")
    return joined.select(*docs.columns, "mix_block", (turn + F.col("__slot")).alias("mix_slot"), (turn + F.col("__r")).alias("mix_release"), (turn + F.col("__d")).alias("mix_deadline"))


def mixed(docs: DataFrame, weights: Mapping[str, int] | Column, block_chars: int, default_weight: int = 1) -> DataFrame:
    """The rows of docs, laid out over partitions in mixed order."""
    # columns of docs step aside meanwhile, however they are named
    named = [weights.alias("__weight")] if isinstance(weights, Column) else []
    own = docs.select(*(F.col(c).alias(f"__doc_{c}") for c in docs.columns), *named)
    out = mix(own, F.col("__weight") if named else weights, block_chars, default_weight, "__doc_doc_id", "__doc_source", "__doc_text")
    out = out.repartitionByRange("mix_slot", "__doc_doc_id").sortWithinPartitions("mix_slot", "__doc_doc_id")
    return out.select(*(F.col(f"__doc_{c}").alias(c) for c in docs.columns))


#: DuckDB SQL of mix() over documents: weight 1 plus the source's number mod 4 (src3: 4), blocks of 100000 characters.
SQL = """
WITH RECURSIVE s AS (SELECT source, CAST(regexp_extract(source, '[0-9]+$') AS INT) % 4 + 1 AS a FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)),
l AS (SELECT list(source ORDER BY source) AS names, list(a ORDER BY source) AS a, CAST(sum(a) AS INT) AS total FROM s),
run AS (
  SELECT -1 AS t, list_transform(a, lambda x: 0) AS done, 0 AS pick, 0 AS block, 0 AS release, 0 AS deadline FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p.i THEN 1 ELSE 0 END), p.i, done[p.i], p.r, p.d
  FROM (SELECT t, done, list_min(list_filter(list_transform(done, lambda j, i: {'d': CAST(ceil((j + 1) * total / a[i]) AS INT), 'i': i, 'r': CAST(floor(j * total / a[i]) AS INT)}), lambda x: x.r <= t + 1)) AS p
        FROM run, l WHERE t + 1 < total)
),
k AS (SELECT names[pick] AS source, a[pick] AS w, block, t AS at_slot, release, deadline, total FROM run, l WHERE t >= 0),
d AS (SELECT doc_id, coalesce(source, '') AS source,
             CAST(floor((sum(coalesce(length(text), 0)) OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) - coalesce(length(text), 0)) / 100000) AS BIGINT) AS b
      FROM documents)
SELECT doc_id, d.source, b AS mix_block, CAST(b // w * total + at_slot AS BIGINT) AS mix_slot,
       CAST(b // w * total + release AS BIGINT) AS mix_release, CAST(b // w * total + deadline AS BIGINT) AS mix_deadline
FROM d JOIN k ON d.source = k.source AND d.b % k.w = k.block
"""
