"""Token-ID output: one concatenated id array with Elias-Fano encoded document boundaries.

File format (a Parquet folder, so that Spark's own commit protocol writes it and any store that
Spark reads can hold it). A row is a block of consecutive documents:

=============  ======  ==========================================================================
part, block    int     place of the block: blocks ordered by (part, block) form the whole array
part_start     long    ids in the same part before this block
n_docs, n_ids  long    documents and ids in the block
low_bits       int     width of the low halves of the boundaries
low, high      binary  Elias-Fano halves of the documents' end offsets within the block
samples        binary  int32 bit positions of every 64th set bit of ``high`` (select structure)
doc_ids        binary  int64 ids of the documents
ids            binary  the token ids, unsigned 16-bit little-endian (32-bit where ``wide``)
wide           bool    whether ids take 32 bits
=============  ======  ==========================================================================
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir

SAMPLE = 64
BLOCK_IDS = 1 << 20
#: Entries of each of the two generations of a worker's word memo.
MEMO_WORDS = 500_000

SCHEMA = "part int, block int, part_start long, n_docs long, n_ids long, low_bits int, low binary, high binary, samples binary, doc_ids binary, ids binary, wide boolean"


class EliasFano:
    """A non-decreasing sequence of n integers up to u in about 2 + log2(u/n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<i4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(high), ones[::SAMPLE].astype("<i4").tobytes())

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) + (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Value i alone: the sampled position of a set bit before it, then a walk over whole bytes."""
        left, at = i % SAMPLE, int(self.samples[i // SAMPLE])
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low_bits
        held = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return upper << self.low_bits | held >> first % 8 & (1 << self.low_bits) - 1


#: The normaliser and pre-tokenizer (as the library writes them) under which a text's ids are those of its pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Kinds of Latin-1 bytes of a lower-cased text: between pieces, letters, digits (each a piece), marks, and what only the library parts.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = MARK
KIND[[32, 10]] = BLANK
KIND[48:58] = DIGIT
KIND[97:123] = KIND[0xDF:0xF7] = KIND[0xF8:] = LETTER
KIND[0xF7] = OTHER
PLAIN = bytes(k for k in range(256) if KIND[k] != OTHER)
#: Characters of texts that are parted together.
LOT = 1 << 20


def _plain(text: str) -> bytes | None:
    """The lower-cased Latin-1 bytes of a text whose pieces KIND tells apart; None for any other text.

    Lower-casing, which the vocabulary does itself, is the same for each letter of Latin-1; special tokens begin with <|.
    """
    try:
        data = text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"<|" in data or data.translate(None, PLAIN) else data


def _pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces: runs of letters or of marks and single digits; what holds an apostrophe stays whole between blanks."""
    code = np.frombuffer(data, np.uint8)
    kind = KIND[code]
    held = kind != BLANK
    before = np.append(np.uint8(BLANK), kind[:-1])
    start = held & ((kind != before) | (kind == DIGIT))
    if len(quotes := np.flatnonzero(code == 39)):
        first = held & (before == BLANK)
        run = np.cumsum(first)
        whole = np.zeros(int(run[-1]) + 1, bool)
        whole[run[quotes]] = True
        start &= first | ~whole[run]
    bounds = np.append(np.flatnonzero(start | ~held), len(code))
    own = np.flatnonzero(start[bounds[:-1]])
    return bounds[own], bounds[own + 1]


def _kinds(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each piece's spelling, and a piece of each spelling."""
    code = np.frombuffer(data + bytes(8), np.uint8)
    size = last - first
    words = np.lib.stride_tricks.sliding_window_view(code, 8)
    mask = (1 << np.minimum(size, 8).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
    mask[size >= 8] = np.uint64(0xFFFFFFFFFFFFFFFF)
    head = np.ascontiguousarray(words[first]).view("<u8").ravel() & mask
    tail = np.where(size > 8, np.ascontiguousarray(words[np.maximum(first, last - 8)]).view("<u8").ravel(), np.uint64(0))
    # size, head and tail tell pieces of up to 16 bytes apart; longer ones are numbered besides
    key = head * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + tail * np.uint64(0xA24BAED4963EE407) + size.astype(np.uint64)
    long = np.flatnonzero(size > 16)
    number: dict[bytes, int] = {}
    inner = np.zeros(len(size), np.int64)
    inner[long] = [number.setdefault(data[a:b], len(number) + 1) for a, b in zip(first[long].tolist(), last[long].tolist())]
    key += inner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    kind, _ = pd.factorize(key)
    some = np.zeros(int(kind.max()) + 1 if len(kind) else 0, np.int64)
    some[kind] = np.arange(len(kind))
    like = some[kind]
    if not ((head == head[like]) & (tail == tail[like]) & (size == size[like]) & (inner == inner[like])).all():
        kind, some = np.arange(len(kind)), np.arange(len(kind))  # two spellings met in one key: none is shared
    return kind, some


class WordEncoder:
    """Whole texts to ids.

    With the vocabulary's NORMALIZER and PRE_TOKENIZER, the ids of a text are those of its pieces in order, and each piece is encoded once
    and remembered. Pieces of plain texts are told apart for many texts at once; other texts are parted at blanks only. Any
    other vocabulary encodes whole texts.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.most = memo_words

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocab = self.tokenizer.get_vocab()
        # a special token must keep its place whole: it has no blank in it and begins with <|
        special = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        self.parted = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and special and spec["truncation"] is None and spec["padding"] is None
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.wide = len(self.ends) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memo) + len(pieces) > self.most:
            self.memo, self.old = {}, self.memo
        if again := pieces & self.old.keys():
            self.memo.update((p, self.old[p]) for p in again)
            pieces = pieces - again
        words = [p for p in pieces if p.isalpha() and p.lower().isalpha()]
        own: dict[str, bytes] = {}
        for k in range(0, len(words), 256):
            few = words[k : k + 256]
            ids = np.array(self.tokenizer.encode(" ".join(few), add_special_tokens=False).ids, self.dtype)
            cut = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(cut) == len(few):  # else some letters are such as the vocabulary's own normalisation splits
                data, cut = ids.tobytes(), cut.tolist()
                own.update((w, data[a:b]) for w, a, b in zip(few, [0, *cut], cut))
        for p in pieces - own.keys():
            own[p] = self._ids(self.tokenizer.encode(p, add_special_tokens=False).ids)
        self.memo.update(own)

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        found = list(map(self.memo.get, pieces))
        for _ in range(2):  # a new generation may begin while pieces are learned
            if None in found:
                self._learn({p for p, ids in zip(pieces, found) if ids is None})
                found = list(map(self.memo.get, pieces))
        return found if None not in found else [self._ids(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in pieces]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts."""
        data = b"\n".join(texts)
        first, last = _pieces(data)
        if not len(first):
            return [b""] * len(texts)
        kind, some = _kinds(data, first, last)
        ids = self._known([data[a:b].decode("latin-1") for a, b in zip(first[some].tolist(), last[some].tolist())])
        size = np.array([len(x) for x in ids]) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = size[kind]
        until = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(size) - size)[kind] - (until - n), n) + np.arange(until[-1])].tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = np.append(0, until)[np.searchsorted(first, ends)] * self.dtype.itemsize
        return [out[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.parted:
            return [self._ids(e.ids) for text in texts for e in [self.tokenizer.encode(text, add_special_tokens=False)]]
        out: list[bytes | None] = [None] * len(texts)
        lot: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if (data := _plain(text)) is None:
                out[i] = b"".join(self._known(text.replace("\n", " ").split(" ")))
                continue
            lot.append((i, data))
            size += len(data)
            if size >= LOT:
                for (k, _), ids in zip(lot, self._together([x for _, x in lot])):
                    out[k] = ids
                lot, size = [], 0
        if lot:
            for (k, _), ids in zip(lot, self._together([x for _, x in lot])):
                out[k] = ids
        return out


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, memo_words: int) -> WordEncoder:
    """The worker's own encoder, kept from task to task; a name without a folder is one of the public_tokenizers package."""
    if (path, memo_words) not in _encoders:
        import public_tokenizers

        _encoders[path, memo_words] = WordEncoder(path if "/" in path else str(public_tokenizers.path(path)), memo_words)
    return _encoders[path, memo_words]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", place: list[str] | None = None, memo_words: int = MEMO_WORDS) -> None:
    """Encode every whole text and write the id array to path, documents in ascending order of ``place`` (default: the id).

    Null texts count as empty and keep their end id. Rows that tie (repeated ids) stand in order of their text.
    Documents without an id are kept, first in order, and read back with a null id (stored as the smallest long).
    An empty table gives a file without blocks. Only the named columns are read, whatever else the table has.
    """
    order = [f"place_{k}" for k in range(len(place or [id_col]))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(o) for c, o in zip(place or [id_col], order)))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "text").select("doc_id", "text")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number, before = _encoder(tokenizer, memo_words), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        ids, coded, held = [], [], 0

        def block() -> pd.DataFrame:
            width = encoder.dtype.itemsize
            ends = np.cumsum([len(x) // width for x in coded])
            ef = EliasFano.encode(ends)
            return pd.DataFrame([[part, number, before, len(ids), int(ends[-1]), ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), np.array(ids, "<i8").tobytes(), b"".join(coded), encoder.wide]], columns=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, own in zip(batch.doc_id, encoder.encode(list(batch.text))):
                ids.append(np.iinfo(np.int64).min if pd.isna(doc) else int(doc))
                coded.append(own + end)
                held += len(coded[-1]) // encoder.dtype.itemsize
                if held >= BLOCK_IDS:
                    yield block()
                    number, before, ids, coded, held = number + 1, before + held, [], [], 0
        if ids:
            yield block()
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task gives back what batches took

    rows.mapInPandas(blocks, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and ids_crc32.

    What precedes a block is the sum over earlier parts (one row a part; parts are as many as the
    writer's partitions) plus its own ``part_start``.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ends = EliasFano(b.n_docs, b.low_bits, b.low, b.high, b.samples).decode()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(b.ids, "<u4" if b.wide else "<u2").astype("<u4", copy=False)
                docs = np.frombuffer(b.doc_ids, "<i8")
                yield pd.DataFrame({
                    "doc_id": pd.array(docs, "Int64").copy() if docs.min() > np.iinfo(np.int64).min else pd.array([None if d == np.iinfo(np.int64).min else d for d in docs.tolist()], "Int64"),
                    "start": b.base + b.part_start + starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)],
                })

    return blocks.join(F.broadcast(bases), "part").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids of the named few documents: two selects find each, and no other boundary is decoded."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    wanted = np.array(sorted(doc_ids), np.int64)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                docs, ef = np.frombuffer(b.doc_ids, "<i8"), EliasFano(b.n_docs, b.low_bits, b.low, b.high, b.samples)
                at = np.flatnonzero(np.isin(docs, wanted))
                bounds = [(ef.select(i - 1) if i else 0, ef.select(i)) for i in at.tolist()]
                ids = np.frombuffer(b.ids, "<u4" if b.wide else "<u2")
                yield pd.DataFrame({"doc_id": docs[at], "start": [b.base + b.part_start + s for s, _ in bounds], "ids": [ids[s:e].astype(np.int64) for s, e in bounds]})

    return blocks.join(F.broadcast(bases), "part").mapInPandas(find, "doc_id long, start long, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", place: list[str] | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Write the token file into the shared folder and return what reading it back says of each document. A worker remembers twice memo_words words at most."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, end_id, id_col, text_col, place, memo_words)
    return read(docs.sparkSession, path)
