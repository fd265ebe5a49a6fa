import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from sparkloom.llm import decontaminate, mixing, ngram_join, token_output
from sparkloom.llm.common import materialize, table
from sparkloom.llm.queries import TOKENIZER, source_weights

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage on what the one before kept, against a plain reading of its rule."""
    docs = table(spark, SF, "documents")
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == docs.columns
        assert kept[-1].exceptAll(kept[-2]).count() == 0
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    wrong = [i for i in ids[0] - ids[1] if labels.get(i) == 0]
    assert len(wrong) <= 2
    groups = {}
    for r in ngram_join.ngram_join(kept[1]).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert ids[2] == {min(g) for g in groups.values()}
    bad = {r.doc_id for r in decontaminate.contamination(kept[2], table(spark, SF, "benchmark")).collect() if r.contaminated}
    assert ids[3] == ids[2] - bad
    assert ids[4] == ids[3]
    slots = {r.doc_id: r.mix_slot for r in mixing.mix(kept[3], source_weights(kept[3]), p.BLOCK_CHARS).collect()}
    got = p.write_tokens(spark, kept[4], SF).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(slots, key=lambda i: (slots[i], i))
    tokenizer, start = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER))), 0
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    for r in got:
        tokens = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", None, "s", 1)], table(spark, SF, "documents").schema)
    for docs in (rows, rows.limit(0)):
        docs = materialize(docs)
        n = docs.count()
        for _, stage in p.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF))
        assert p.write_tokens(spark, docs, SF).count() == n
    assert token_output.token_output(rows, TOKENIZER).count() == 3


def test_rows_are_judged_by_their_own_texts(spark, monkeypatch):
    """Null and repeated ids: a clean row stays beside a contaminated or copied one, and a copy goes."""
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(None, passage)], "item_id long, text string")
    rows = [(None, f"so {passage}"), (None, "clean words"), (None, None), (5, f"and {passage}"), (5, "clean too"), (6, ""), (6, f"{passage} again")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    monkeypatch.setattr(p, "table", lambda *_: items)
    assert sorted(r.k for r in p.drop_contaminated(spark, docs, SF).collect()) == [1, 2, 4, 5]

    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(None, a), (None, a), (3, b), (3, b), (7, c), (9, c), (9, "a text of its own that shares an id"), (None, b + " more"), (None, ""), (None, ""), (None, None), (4, "short"), (2, "short")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    kept = p.drop_near_duplicates(spark, docs, SF)
    got = sorted((r.k for r in kept.collect()))
    assert kept.columns == docs.columns
    assert len(got) == 8 and len({0, 1} & set(got)) == 1 and len({2, 3} & set(got)) == 1 and set(got) - {0, 1, 2, 3} == {4, 6, 8, 9, 10, 12}


def test_clashing_columns(spark):
    """Columns with the stages' own names pass through all of them with their values."""
    clash = "__h __c __hash __key __bad __doc_text toxicity __toxicity mix_slot mix_block part file row n_shingles component_id __first".split()
    docs = table(spark, SF, "documents").limit(60)
    for k, name in enumerate(clash):
        docs = docs.withColumn(name, p.F.col("doc_id") * 100 + k)
    docs = given = materialize(docs)
    for _, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == given.columns
    rows = docs.collect()
    assert rows and all(r[name] == r.doc_id * 100 + k for r in rows for k, name in enumerate(clash))
    assert p.write_tokens(spark, docs, SF).count() == len(rows)
