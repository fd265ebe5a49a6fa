"""N-gram Jaccard join: exact links between documents whose word 5-gram sets overlap by 75 % or more.

1. Singles out documents that cannot link: at least 75 % of a linked document's n-grams stand in another document
   too. Half of the hash space shows most of them: more n-grams there without a second document than the whole
   set may have is proof enough.
2. Of the others, equal sets become one representative each.
3. Representatives that share one of their rarest n-grams (the prefix of the global order by frequency) may link;
   they form blocks, and a large block is dealt in pairs of chunks.
4. A block's sets, in a common order, go into a prefix tree. A set's walk through it shares partial overlaps and
   leaves subtrees that the remaining lengths, or known links, make pointless.

N-grams are 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import aside, materialize
from .components import components

N = 5
#: Texts hashed together, in bytes: what a task holds at once besides its batch.
LOT = 2 << 20
#: N-gram hashes of a part of the hash space, on average, at most.
PART_GRAMS = 2_000_000
#: Members and n-grams of a chunk at most, on average.
CHUNK, CHUNK_GRAMS = 1000, 2_000_000
#: Ids of open documents that are broadcast at most (64 MB).
BROADCAST_IDS = 4_000_000

PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VALUE = _LOWER + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, LOT + (1 << 16))
        for name, base in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: A-Z lower-cased, words between blanks; fewer than N words are one n-gram."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    step = np.diff(inside.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power(len(data))
    # one array of 8 bytes a byte of text, reused in place
    sums = _VALUE[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(first > 0, sums[first - 1], np.uint64(0)) if len(first) else sums[:0]
    word = mix((sums[last - 1] - before) * down[first] + (last - first).astype(np.uint64))
    del sums
    begin = np.searchsorted(first, np.cumsum(size) - size)
    n_words = np.diff(np.append(begin, len(first)))
    gram = np.zeros(max(0, len(word) - N + 1), np.uint64)
    for k in range(N):
        gram = (gram + word[k : k + len(gram)]) * PRIME
    gram = mix(gram)
    out = []
    for b, n in zip(begin.tolist(), n_words.tolist()):
        if n >= N:
            out.append(np.unique(gram[b : b + n - N + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for w in word[b : b + n]:
                h = mix(h * PRIME + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lots(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts in lots of about LOT bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.doc_id, batch.text):
            ids.append(i)
            texts.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
            size += len(texts[-1])
            if size >= LOT or len(ids) == 60_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    del texts
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task gives back what batches took


def allowed(n: np.ndarray) -> np.ndarray:
    """How many n-grams of a set of n may be missing from a set that it links with."""
    return n - -(-3 * n // 4)


def sizes(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles and alone (proved to have no link) of every row; doc_id is not null.

    A lot of texts sends each n-gram hash of one half of the hash space once; hashes that two of its texts share are marked
    and need no answer. The answers are, for each text of the lot, how many hashes no one else has.
    """
    # a part's hashes are held at once, so parts are as many as the texts call for: half of a word's n-gram for about 6 bytes
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (12 * PART_GRAMS)))
    shared = np.uint16(65535)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, (ids, texts) in enumerate(_lots(batches)):
            lot = TaskContext.get().partitionId() << 32 | number
            sets = shingles(texts)
            n = np.array([len(s) for s in sets])
            grams, own = np.concatenate(sets), np.repeat(np.arange(len(n)), n).astype(np.uint16)
            half = (grams & np.uint64(1)) == 0
            grams, own = (grams[half] >> np.uint64(1)), own[half]
            order = np.argsort(grams, kind="stable")
            grams, own = grams[order], own[order]
            new = np.append(True, grams[1:] != grams[:-1]) if len(grams) else np.zeros(0, bool)
            twice = np.append(~new[1:], False)[new] if len(grams) else new
            grams, own = grams[new], np.where(twice, shared, own[new])
            part = (grams % np.uint64(parts)).astype(np.int64)
            short = (grams // np.uint64(parts)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, lot, short[k].tobytes(), own[k].tobytes(), None, None) for p in range(parts) if len(k := order[cut[p] : cut[p + 1]])]
            rows.append((int(lot % parts), lot, None, None, np.array(ids, "<i8").tobytes(), n.astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["part", "lot", "grams", "own", "ids", "n"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        heads, asked = group[group.ids.notna()], group[group.ids.isna()]
        out = [(r.lot, None, r.ids, r.n) for r in heads.itertuples()]
        if len(asked):
            grams = [np.frombuffer(g, np.uint32) for g in asked.grams]
            own = np.frombuffer(b"".join(asked.own), np.uint16)
            _, back, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            single = (count[back] == 1) & (own != shared)
            ends = np.cumsum([len(g) for g in grams])
            for lot, a, b in zip(asked.lot, np.append(0, ends[:-1]), ends):
                out.append((lot, np.bincount(own[a:b][single[a:b]]).astype("<i4").tobytes(), None, None))
            pa.default_memory_pool().release_unused()
        return pd.DataFrame(out, columns=["lot", "single", "ids", "n"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group.ids.notna()].iloc[0]
        n = np.frombuffer(head.n, "<i4").astype(np.int64)
        single = np.zeros(len(n), np.int64)
        for s in group.single[group.single.notna()]:
            x = np.frombuffer(s, "<i4")
            single[: len(x)] += x
        return pd.DataFrame({"doc_id": np.frombuffer(head.ids, "<i8"), "n_shingles": n, "alone": (n == 0) | (single > allowed(n))})

    sent = rows.mapInPandas(send, "part int, lot long, grams binary, own binary, ids binary, n binary")
    back = sent.repartition(parts, "part").groupBy("part").applyInPandas(answer, "lot long, single binary, ids binary, n binary")
    return back.groupBy("lot").applyInPandas(total, "doc_id long, n_shingles long, alone boolean")


def sets_of(rows: DataFrame) -> DataFrame:
    """doc_id, n, digest (of the set) and grams (the sorted set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _lots(batches):
            sets = shingles(texts)
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "grams": [s.view(np.int64) for s in sets]})

    return rows.mapInPandas(run, "doc_id long, n int, digest binary, grams array<long>")


def prefixes(reps: DataFrame) -> DataFrame:
    """gram and rep: the n-grams in the prefix of a set, rarest first, that another set has too."""
    grams = reps.select("rep", "n", F.explode("grams").alias("gram"))
    count = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    held = grams.join(count, "gram")
    # n-grams of one set alone come first in the order, so the prefix keeps what they leave of it
    per = Window.partitionBy("rep")
    held = held.withColumn("row", F.row_number().over(per.orderBy("df", "gram"))).withColumn("shared", F.count("*").over(per))
    return held.where("row <= n - ceil(3 * n / 4) + 1 - (n - shared)").select("gram", "rep")


class Tree:
    """A prefix tree over sets in a common order, its single paths drawn together."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        grams, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(count, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        several = count > 1
        cut = np.cumsum(self.n) - self.n
        self.width = len(grams)
        # n-grams of one set only count by its size
        self.sets = [np.sort(place[b][several[b]]) for b in np.split(back, cut[1:])]
        self.order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">i4").tobytes())
        self.parent = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self) -> list[tuple[int, int]]:
        """Links that connect whatever links connect: 7 |x and y| >= 3 (|x| + |y|), which is 75 % of the union."""
        self.found: list[tuple[int, int]] = []
        for a, b in zip(self.order, self.order[1:]):  # neighbours in the tree's order first
            both = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
            self._meet(a, b, both)
        root = self._build()
        for x in self.order:
            self._walk(root, x)
        return self.found

    def _meet(self, a: int, b: int, both: int) -> None:
        if 7 * both >= 3 * int(self.n[a] + self.n[b]) and (p := self.find(a)) != (q := self.find(b)):
            self.parent[p] = q
            self.found.append((a, b))

    def _build(self) -> list:
        """Nodes as [edge, ends here, children, least n, most n, longest rest, component or -1]."""
        sets, order = self.sets, self.order
        root: list = []
        todo = [(0, len(order), 0, root)]
        made = []
        while todo:
            lo, hi, depth, siblings = todo.pop()
            a, b = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(a), len(b))
            off = a[depth:m] != b[depth:m]
            until = depth + int(off.argmax()) if off.any() else m
            node = [a[depth:until], [], [], 0, 0, 0, -1]
            siblings.append(node)
            made.append((node, lo, hi, until))
            while lo < hi and len(sets[order[lo]]) == until:
                node[1].append(order[lo])
                lo += 1
            while lo < hi:
                key, end = sets[order[lo]][until], lo + 1
                while end < hi and sets[order[end]][until] == key:
                    end += 1
                todo.append((lo, end, until, node[2]))
                lo = end
        for node, lo, hi, until in made:
            own = [order[k] for k in range(lo, hi)]
            n = self.n[own]
            heads = {self.find(i) for i in own} if hi - lo < 5000 or lo == 0 else set()
            node[3:] = [int(n.min()), int(n.max()), max(len(sets[i]) for i in own) - until, heads.pop() if len(heads) == 1 else -1]
        return root[0]

    def _walk(self, root: list, x: int) -> None:
        own, n = self.sets[x], int(self.n[x])
        has = np.zeros(self.width, bool)
        has[own] = True
        todo = [(root, 0)]
        while todo:
            node, both = todo.pop()
            edge, here, below, low, high, rest, group = node
            if 4 * high < 3 * n or 3 * low > 4 * n or (group >= 0 and self.find(group) == self.find(x)):
                continue
            left = len(own)
            if len(edge):
                both += int(np.count_nonzero(has[edge]))
                left -= int(np.searchsorted(own, edge[-1], "right"))
            if 7 * (both + min(left, rest)) < 3 * (n + low):
                continue
            for y in here:
                if y != x:
                    self._meet(x, y, both)
            todo.extend((c, both) for c in below)


def verified(blocks: DataFrame) -> DataFrame:
    """Links (a, b) between representatives of each block; blocks has block, i, j, rep and grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(reps: list, sets: list) -> pd.DataFrame:
            found = Tree(sets).links() if len(reps) > 1 else []
            return pd.DataFrame({"a": [reps[x] for x, _ in found], "b": [reps[y] for _, y in found]}, dtype="int64")

        key, reps, sets = None, [], []
        for batch in batches:
            for block, i, j, rep, grams in zip(batch.block, batch.i, batch.j, batch.rep, batch.grams):
                if (block, i, j) != key:
                    if reps:
                        yield done(reps, sets)
                    key, reps, sets = (block, i, j), [], []
                reps.append(rep)
                sets.append(np.asarray(grams, np.int64))
        if reps:
            yield done(reps, sets)
        pa.default_memory_pool().release_unused()

    dealt = blocks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "rep")
    return dealt.mapInPandas(run, "a long, b long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the least doc_id that links reach.

    A null or blank text has no n-grams and no links. Equal texts are linked. Rows that repeat an id are rows of
    their own with one component. A null id has no component and is never linked. No rows, no result; other columns are ignored.
    """
    all_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = all_.where(F.col("doc_id").isNotNull())
    known = materialize(sizes(named))

    open_ = known.where("not alone").select("doc_id").distinct()
    # ids of 8 bytes: a bounded number is broadcast, so that texts stay where they are; more are joined by shuffle
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_IDS else open_
    sets = materialize(sets_of(named.join(open_, "doc_id", "left_semi")))
    # copies are dropped before anything shuffles: each task keeps the least id of a set
    reps = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "grams")).alias("x"))
    reps = materialize(reps.select("digest", F.col("x.doc_id").alias("rep"), "x.n", "x.grams"))
    member = materialize(sets.select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct())

    starts = materialize(prefixes(reps))
    centre = starts.groupBy("gram").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k")
    blocks = components(starts.join(centre, "gram").select(F.col("rep").alias("a"), "b"))

    inside = reps.drop("digest").join(blocks, F.col("rep") == F.col("node")).select(F.col("component").alias("block"), "rep", "n", "grams")
    load = inside.groupBy("block").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    load = load.select("block", F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("total") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    dealt = inside.join(load, "block").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # a block of one chunk is one group; of more, every two chunks meet
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("chunk")))
    dealt = dealt.withColumn("other", F.explode(other)).select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "grams")
    links = verified(dealt)

    twice = member.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("rep").alias("rep"))
    joined = member.join(twice.where("k > 1").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(joined))
    place = twice.join(found, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("linked"), F.coalesce("component", "rep").alias("component"))
    out = known.join(place, F.col("doc_id") == F.col("linked"), "left").select("doc_id", "n_shingles", F.least(F.coalesce("component", "doc_id"), "doc_id").alias("component_id"))
    return out.unionByName(nameless(all_))


def nameless(rows: DataFrame) -> DataFrame:
    """Rows without an id: they have a size, but no component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _lots(batches):
            yield pd.DataFrame({"doc_id": pd.array([None] * len(ids), "Int64"), "n_shingles": [len(s) for s in shingles(texts)], "component_id": pd.array([None] * len(ids), "Int64")})

    return rows.where(F.col("doc_id").isNull()).mapInPandas(run, "doc_id long, n_shingles long, component_id long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, with one row of each component of linked texts: that of the least id (null last), then text hash.

    Each row is judged by its own text, whatever its id: texts are joined under their hashes. Rows without n-grams all stay.
    """
    return _representatives(aside(docs), f"__doc_{id_col}", f"__doc_{text_col}").toDF(*docs.columns)


def _representatives(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hash_ = F.xxhash64(F.col(text_col).cast("string"))
    found = ngram_join(docs.select(hash_.alias("doc_id"), F.col(text_col).alias("text"))).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("__h"), F.col("component_id").alias("__c")).distinct()
    # ids and hashes alone are grouped, so copies and hot components stay small
    rows = docs.select(F.col(id_col).alias("__id"), hash_.alias("__h")).groupBy("__id", "__h").agg(F.count("*").alias("__k"))
    rows = materialize(rows.join(found, "__h"))
    first = rows.groupBy("__c").agg(F.sum("__k").alias("all"), F.min(F.struct(F.col("__id").isNull().alias("n"), "__id", "__h", "__k")).alias("x")).where("all > 1")
    first = first.select("__c", F.col("x.__id").alias("__first"), F.col("x.__h").alias("__own"), F.col("x.__k").alias("__same"))
    crowded = materialize(rows.select("__h", "__c").distinct().join(first, "__c"))
    placed = docs.withColumn("__hash", hash_).join(crowded, F.col("__hash") == F.col("__h"), "left")
    chosen = F.col(id_col).eqNullSafe(F.col("__first")) & (F.col("__hash") == F.col("__own"))
    out = placed.where(F.col("__c").isNull() | chosen & (F.col("__same") == 1)).select(*docs.columns)
    if crowded.where((F.col("__same") > 1) & (F.col("__h") == F.col("__own"))).isEmpty():
        return out
    # rows that repeat id and text: any one of them
    return out.unionByName(placed.where(chosen & (F.col("__same") > 1)).dropDuplicates(["__c"]).select(*docs.columns))
