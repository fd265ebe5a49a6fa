"""Vectors: hashed embeddings, cosine and truncation, as Column builders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

DIMENSIONS = 768
#: The FNV-1a hash's offset and prime.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def slot_and_sign(word: Column) -> Column:
    """slot and sign of a word: FNV-1a over its characters (of the basic plane), read as a signed 32-bit number.

    The hash is bound once by a one-element transform; written out, every use would fold the word again.
    """
    h = F.aggregate(F.split(word, ""), F.lit(FNV_OFFSET).cast("long"), lambda a, c: a.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32))
    use = lambda u: F.struct((F.when(u >= 1 << 31, F.lit(1 << 32) - u).otherwise(u) % DIMENSIONS).alias("slot"), F.when(u % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    return F.get(F.transform(F.array(h), use), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def truncate(v: Column, n: int) -> Column:
    """The first n components made a unit vector again."""
    cut = F.slice(v, 1, n)
    return F.transform(cut, lambda x: F.when(norm(cut) > 0, x / norm(cut)).otherwise(x))


def hashed_words(words: list[str], memo: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signs of words as slot_and_sign() has them; memo keeps those seen."""
    out = []
    for w in words:
        if (own := memo.get(w)) is None:
            h = 2166136261
            for c in w:
                h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
            own = memo[w] = (abs(h - (h >> 31 << 32)) % DIMENSIONS, 1 - 2 * (h & 1))
        out.append(own)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


#: Fixed value: characters of a word that are hashed beside those of other words; longer ones are hashed by themselves.
WIDTH = 32


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """hashed_words() of many words at once, character by character of all."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).T.astype(np.uint64)
    h = np.full(len(words), FNV_OFFSET, np.uint64)
    for c in codes:
        own = np.flatnonzero(c)
        if not len(own):
            break
        h[own] = (h[own] ^ c[own]) * np.uint64(FNV_PRIME) & np.uint64(0xFFFFFFFF)
    h = h.astype(np.int64)
    slot, sign = np.abs(h - (h >> 31 << 32)) % DIMENSIONS, 1 - 2 * (h & 1)
    odd = [k for k, w in enumerate(words) if len(w) > WIDTH or "\0" in w]
    if odd:
        slot[odd], sign[odd] = hashed_words([words[k] for k in odd], {})
    return slot, sign


def components(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed unit vectors of texts (lists of words) without their zeros: cells, of DIMENSIONS a text, and their values."""
    coded = texts.flatten().dictionary_encode()
    slot, sign = hashed(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    cells, where = np.unique(pc.list_parent_indices(texts).to_numpy() * DIMENSIONS + slot[at], return_inverse=True)
    value = np.bincount(where, sign[at], len(cells))
    cells, value = cells[value != 0], value[value != 0]
    row = cells // DIMENSIONS
    return cells, value / np.sqrt(np.bincount(row, value * value))[row]
