import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation_trie as t

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, spliced=True):
    """Nodes by a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in sorted(((c, turn, r or "", x or "") for c, turn, r, x, *_ in rows if c is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        own.setdefault(c, []).append((role, text))
    paths = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if spliced else 0
        paths[c] = tuple((own.get(c - c % 5, [])[:h] if spliced else []) + seq[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = set()
    for p, cs in members.items():
        below = [v for v in members if v[: len(p)] == p]
        leaf = [v for v in below if not any(w[:-1] == v and w for w in members)]
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(v) == len(p) + 1 for v in below), len(leaf),
                 sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def family(seed, n=60):
    rng = random.Random(seed)
    words = ["", "a", "é", "b" * 5, None]
    rows = []
    for c in range(n):
        hot = c % 3 == 0  # a third share their first turns
        for k in range(rng.randrange(0 if c % 7 else 1, 9)):
            rows.append((c, k if rng.random() > 0.1 else rng.choice([None, k]), "user" if hot and k < 4 else rng.choice(["user", "assistant", None]), "hello" if hot and k < 4 else rng.choice(words)))
    rows += [(200, k, "user", str(k % 2)) for k in range(300)] + [(205, k, "user", str(k % 2)) for k in range(310)]  # two long ones, alike
    rows += [(300, 1, "user", "same")] * 4 + [(None, 0, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_rows, spliced", [(1, True), (40, True), (40, False), (t.LOCAL_ROWS, True)])
def test_nodes(spark, local_rows, spliced):
    """Distributed rounds and local quicksort give the same nodes, whatever their share."""
    rows = [r for r in family(local_rows) if local_rows > 1 or r[0] is None or r[0] < 40]
    c = F.col("conv_id")
    kw = {"donor": c - c % 5, "head": F.crc32(c.cast("string").cast("binary")) % 9} if spliced else {}
    got = t.prefix_trie(spark.createDataFrame(rows, SCHEMA), local_rows=local_rows, **kw).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    assert {tuple(r) for r in got} == brute(rows, spliced)


def test_packed_ends(spark, monkeypatch):
    """Copies of one conversation end at one node, whose digest is made of pieces."""
    monkeypatch.setattr(t, "PIECE", 7)
    rows = [(c, k, "user", "x") for c in range(100) for k in range(2)]
    got = t.prefix_trie(spark.createDataFrame(rows, SCHEMA), local_rows=5).collect()
    assert {tuple(r) for r in got} == brute(rows, False)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert t.prefix_trie(empty).collect() == [] and t.prefix_trie(empty).columns == COLUMNS
    assert t.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    clash = [(1, 0, "user", "x" * 200_000, 5, 6), (2, 0, "user", "x" * 200_000, 7, 8)]
    got = t.prefix_trie(spark.createDataFrame(clash, SCHEMA + ", pos long, top long")).collect()
    assert {tuple(r) for r in got} == brute(clash, False)


def test_sql(spark):
    """The query's SQL on the same rows, nulls and ties among them."""
    rows = family(5)
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    want = con.execute(t.SQL)
    names = [d[0] for d in want.description]
    assert {tuple(dict(zip(names, r))[c] for c in COLUMNS) for r in want.fetchall()} == brute(rows)
