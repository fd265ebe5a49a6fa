import zlib

import numpy as np
import pytest

from sparkloom.llm import token_output as t

PATH = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5], [1, 2, 3, 900, 900, 100_000], list(range(0, 4000, 7)), []])
def test_elias_fano(values):
    ef = t.EliasFano.encode(np.array(values, np.int64))
    assert ef.decode().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["The cat's, don't. It'sX", None, "", "a\n\n b  c\t d\x85e f", "<|endoftext|> x<|startoftext|>", "Ünïcode É é ́ ΣΑΣ ΣΑΣ.", "word. " * 3000 + "123 ### !!", "The cat's, don't. It'sX", "\U0001f600 ok 12,5 .", "İstanbul ﬁ"]
    rows = [(i * 3, x, "clash", 1) for i, x in enumerate(texts)] + [(9, "tie", "clash", 1)]
    got = t.token_output(spark.createDataFrame(rows, "doc_id long, text string, part string, start int"), PATH).orderBy("start").collect()
    want, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty(spark):
    assert t.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    """Whole documents and hostile strings, also of a vocabulary whose pieces cannot be told apart."""
    import random

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = f"/opt/tokenizers/{name}"
    tokenizer, encoder, rng = Tokenizer.from_file(path), t.WordEncoder(path), random.Random(5)
    letters = "abcXYZ  \n'''\"stmdlrev.,;:!?0129éßÿÀ÷×µªº<|>-_\t\x85\xa0½²#&Σ́"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|> x<|startoftext|>y", "İstanbul ﬁ ΣΑΣ", "don't 's''s x'll'd '", "pneumonoultramicroscopicsilicovolcanoconiosis " * 3 + "pneumonoultramicroscopicsilicovolcanoconiosi"]
    texts += [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for own, text in zip(encoder.encode(texts), texts):
        assert np.frombuffer(own, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_select_finds_few_documents(spark):
    from sparkloom.llm.common import shared_dir

    rows = [(i, f"word {i} " * (i % 7)) for i in range(300)]
    path = shared_dir(spark)
    t.write(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, 2)
    whole = {r.doc_id: r for r in t.read(spark, path).collect()}
    got = t.tokens_of(spark, path, [0, 64, 299, 1000]).collect()
    assert sorted(r.doc_id for r in got) == [0, 64, 299]
    for r in got:
        assert r.start == whole[r.doc_id].start and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == whole[r.doc_id].ids_crc32
