import hashlib
import re

from sparkloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, n=10):
    grams = {}
    for i, text in items:
        w = words(text)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w and i is not None else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit |= set(range(k, k + m))
                    ids |= grams[g]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine TEN eleven twelve"), (10, "short one"), (2, "é É"), (3, None), (4, " .,"), (None, "one"), (5, "two three four five six seven eight nine ten eleven")]
DOCS = [
    (1, "Zero one two three four five six seven eight nine ten eleven twelve, thirteen"), (2, None), (3, ""), (4, "a short-one é É x"), (5, "one two three four five six seven eight nine"), (5, "short one short one"),
    (None, "short one"), (6, "é é É short"), (7, ("pad " * 30_000) + "short one"), (8, "eleven two three four five six seven eight nine ten eleven"), (8, "eleven two three four five six seven eight nine ten eleven"), (9, "İ ŞORT one"),
]


def frames(spark):
    return spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, hash int"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark, monkeypatch):
    docs, items = frames(spark)
    for limit in (d.BROADCAST_BYTES, 0):  # the hash set broadcast, and joined by shuffle
        monkeypatch.setattr(d, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, d.contamination(docs, items).drop("spans").collect()), key=str) == brute(DOCS, ITEMS)
    assert sorted(map(tuple, d.contamination(docs, items.limit(0)).drop("spans").collect()), key=str) == brute(DOCS, [])
    assert d.contamination(docs.limit(0), items).count() == 0


def test_removal(spark):
    docs, items = frames(spark)
    clean = {r[0] for r in brute(DOCS, ITEMS)} - {r[0] for r in brute(DOCS, ITEMS) if r[-1]}
    kept = d.remove_documents(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    one = spark.createDataFrame([(1, "  Say: short, one! then é É end.", "x"), (2, "clean", "y"), (3, None, "z")], "doc_id long, text string, k string")
    assert [tuple(r) for r in d.remove_spans(one, items).orderBy("doc_id").collect()] == [(1, "  Say: then end.", "x"), (2, "clean", "y"), (3, None, "z")]
