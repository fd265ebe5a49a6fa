"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A statement is a line of a file that holds a word of some template: any line may be a header, so all lines of the whole text are
compared. So are, with the notices, longer headers and whole licences (``license_texts``), the file as a whole and its word windows of each
template's length, for a header may run over lines or stand inside one. A file most of whose words stand in statements is a licence file and covers its directory; files
without a statement of their own inherit from the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Short notices of common licences, by SPDX name, as they are usually worded.
TEMPLATES = {
    "Apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"],
    "BSD-2-Clause": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 2 clause license"],
    "BSD-3-Clause": ["licensed under the bsd 3 clause license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "CC-BY-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0-1.0": ["released under cc0 1 0", "this work is dedicated to the public domain"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"],
    "GPL-3.0": ["licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved"],
}
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
_WARRANTY = " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} public license for more details"
#: Headers of source files that run over several lines.
HEADERS = {
    "AGPL-3.0": [_GPL.format("affero general", 3), (_GPL + _WARRANTY).format("affero general", 3, "affero general")],
    "GPL-2.0": [_GPL.format("general", 2), (_GPL + _WARRANTY).format("general", 2, "general")],
    "GPL-3.0": [_GPL.format("general", 3), (_GPL + _WARRANTY).format("general", 3, "general")],
    "LGPL-2.1": [_GPL.format("lesser general", "2 1").replace("program", "library"), (_GPL + _WARRANTY).format("lesser general", "2 1", "lesser general").replace("program", "library")],
    "LGPL-3.0": [_GPL.format("lesser general", 3), (_GPL + _WARRANTY).format("lesser general", 3, "lesser general")],
}
#: A file with none of these words, and too little of every notice, is compared with no longer text.
LEGAL = ("license", "licence", "licensed", "copyright", "permission", "warranty", "redistribution")
#: A window moves on by this share of its length, or one word.
STRIDE = 0.05
#: Lines that resemble a template this much are statements; files with this share of words in them are licence files.
MIN_COSINE, MIN_SHARE = 0.8, 0.5

WORD = r"[a-z0-9]+"
#: Words of the templates that any English text has.
EVERYDAY = frozenset("the of to this is any in and or not a you may by with for be from work under file are all that use used except v 0 2 3 4 1".split())
#: Copies of a directory's row that its files are dealt over.
SALTS = 32


class Weights:
    """Inverse document frequencies over the templates and each template's unit vector; a few hundred numbers."""

    def __init__(self, templates: dict[str, list[str]]):
        rows = [(name, Counter(re.findall(WORD, text.lower()))) for name, texts in sorted(templates.items()) for text in texts]
        df = Counter(w for _, words in rows for w in words)
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in sorted(df.items())}
        self.other = math.log(1 + len(rows)) + 1  # of a word that no template has
        self.vectors = []
        for number, (name, words) in enumerate(rows):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in words.items()))
            self.vectors += [(number, name, w, n * self.idf[w] / norm) for w, n in sorted(words.items())]


    def telling(self, min_cosine: float) -> list[str]:
        """Words of which a line must hold one to reach min_cosine: without them too little of any template's vector is left.

        Any such set is safe; long words come first and everyday ones last, for these let fewest lines through.
        """
        out: set[str] = set()
        rank = lambda v: (v[2] in EVERYDAY, len(v[2]) < 5, -v[3], v[2])
        for number in {v[0] for v in self.vectors}:
            left = 1.0
            for _, _, word, weight in sorted((v for v in self.vectors if v[0] == number), key=rank):
                if left < min_cosine**2 - 1e-9:
                    break
                out.add(word)
                left -= weight**2
        return sorted(out)


@cache
def full_texts() -> dict[str, list[str]]:
    """HEADERS and the licences of the folder license_texts, by SPDX name."""
    out = {name: list(texts) for name, texts in HEADERS.items()}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out.setdefault(file.stem, []).append(file.read_text("utf-8"))
    return out


class Windows:
    """Cosines of ranges of a file's words to templates."""

    def __init__(self, templates: dict[str, list[str]], min_cosine: float):
        weights = Weights(templates)
        self.words = {w: k for k, w in enumerate(weights.idf)}
        # the last number is that of every word that no template has; such words are told apart only by file
        self.idf, self.other, self.least = np.array([*weights.idf.values()]), weights.other, min_cosine
        self.names = {number: name for number, name, _, _ in weights.vectors}
        self.rows = np.zeros((len(self.names), len(self.words)))
        for number, _, word, weight in weights.vectors:
            self.rows[number, self.words[word]] = weight
        self.lengths = [len(re.findall(WORD, text.lower())) for _, texts in sorted(templates.items()) for text in texts]

    def find(self, words: list[str], lines: np.ndarray) -> list[tuple[float, str, int, int]]:
        """(-cosine, license, first, until) of the ranges, among windows, lines (bounds) and the whole, that reach the least cosine."""
        n, number = len(words), {}
        ids = np.array([self.words[w] if w in self.words else len(self.words) + number.setdefault(w, len(number)) for w in words], np.int64)
        idf = np.append(self.idf, np.full(len(number), self.other))[ids]
        # a cosine is at most the length of what the file has of the template's vector
        has = np.zeros(len(self.words), bool)
        has[ids[ids < len(self.words)]] = True
        reach = (self.rows**2) @ has >= self.least**2 - 1e-6
        squares = np.append(0.0, np.cumsum(idf**2))
        known = ids < len(self.words)
        out, norms = [], {}
        for t, length in enumerate(self.lengths):
            if not reach[t]:
                continue
            dots = np.append(0.0, np.cumsum(np.where(known, self.rows[t][np.where(known, ids, 0)], 0.0) * idf))
            first = np.arange(0, max(0, n - length) + 1, max(1, int(length * STRIDE)))
            ranges = np.concatenate([np.stack([first, np.minimum(n, first + length)], 1), np.array([[max(0, n - length), n], [0, n]]), lines])
            dot = dots[ranges[:, 1]] - dots[ranges[:, 0]]
            # a word that repeats only makes the range's vector longer, so this bounds the cosine from above
            may = dot >= (self.least - 1e-6) * np.sqrt(squares[ranges[:, 1]] - squares[ranges[:, 0]])
            for (a, b), d in {(int(a), int(b)): d for (a, b), d in zip(ranges[may], dot[may]) if b > a}.items():
                if (a, b) not in norms:
                    own, tf = np.unique(ids[a:b], return_counts=True)
                    norms[a, b] = math.sqrt(((tf * np.where(own < len(self.idf), self.idf[np.minimum(own, len(self.idf) - 1)], self.other)) ** 2).sum())
                if (cosine := round(d / norms[a, b], 6)) >= self.least:
                    out.append((-cosine, self.names[t], a, b))
        return out


def own(found: list[tuple[float, str, int, int]], long: int | None) -> list[tuple[float, str, int, int]]:
    """found, best first, without the notices that are part of a matching text of long words or more and twice their length."""
    at = np.array([x[2:] for x in found])
    size = at[:, 1] - at[:, 0]
    part = np.zeros(len(at), bool)
    for a, b in {tuple(x) for x in at[size >= long].tolist()} if long else ():
        part |= (at[:, 0] >= a) & (at[:, 1] <= b) & (size * 2 <= b - a)
    return sorted(x for x, inside in zip(found, part) if not inside)


def passages(files: DataFrame, templates: dict[str, list[str]] | None = None, texts: dict[str, list[str]] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """path, t, license, cosine, stated and file_words of the files with a range of words that reaches min_cosine.

    files has path, t (a hash of the text) and text; texts are longer templates. Equal cosines go to the licence of the smaller name. stated counts the words of the best ranges that do not overlap.
    """
    tables = [Windows(x, min_cosine) for x in (templates or TEMPLATES, texts) if x]
    sure = {*Weights(templates or TEMPLATES).telling(min_cosine), *(LEGAL if texts else ())}
    holds = F.lower("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(sorted(sure))})(?![a-z0-9])")
    some = files.select("path", "t", "text").where(holds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, t, text in zip(batch.path, batch.t, batch.text):
                said = [re.findall(WORD, x) for x in re.split(r"\n|\r", text.lower())]
                words = [w for line in said for w in line]
                ends = np.cumsum([len(x) for x in said])
                lines = np.stack([np.append(0, ends[:-1]), ends], 1)
                found = [x for table in tables for x in table.find(words, lines)] if words else []
                if found:
                    found = own(found, min(tables[-1].lengths) if texts else None)
                    taken = np.zeros(len(words), bool)
                    for _, _, a, b in sorted(found, key=lambda x: (x[2] - x[3], x)):
                        if not taken[a:b].any():
                            taken[a:b] = True
                    out.append((path, t, found[0][1], -found[0][0], int(taken.sum()), len(words)))
            yield pd.DataFrame(out, columns=["path", "t", "license", "cosine", "stated", "file_words"])

    return some.mapInPandas(run, "path string, t long, license string, cosine double, stated long, file_words long")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^((?s:.*))/", 1)).otherwise("")


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, min_cosine: float = MIN_COSINE, min_share: float = MIN_SHARE, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """Per file: id, path, license, cosine, licence_file and inherited_from (a directory; null where the license is its own or none).

    A file's own license is its best statement's, then the smaller name's. A directory's is its best licence file's, by cosine, then
    path, then name. Null and empty texts have no statement but can inherit, a null path is a file of the root without a name, and no files give no rows.
    Repeated rows are rows of their own. Other columns are ignored.
    """
    own = files.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    texts = full_texts() if templates is None and texts is None else texts
    said = materialize(passages(own, templates, texts, min_cosine))
    best = said.groupBy("path", "t").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.max(F.col("stated") >= min_share * F.col("file_words")).alias("licence_file"))
    best = best.select("path", "t", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_cosine"), "licence_file")
    own = own.select("id", "path", "t", parent(F.col("path")).alias("home")).join(best, ["path", "t"], "left")

    heads = best.where("licence_file").select(parent(F.col("path")).alias("dir"), F.struct((-F.col("own_cosine")).alias("c"), "path", F.col("own_license").alias("license")).alias("head"))
    heads = heads.groupBy("dir").agg(F.min("head").alias("head")).select("dir", F.col("head.license").alias("dir_license"), (-F.col("head.c")).alias("dir_cosine"))
    # directories are few beside files: each finds its nearest covered ancestor once, then files join their directory
    dirs = own.select("home").distinct()
    parts = F.split("home", "/")
    up = F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.lit(""))
    near = dirs.select("home", F.explode(F.array_distinct(up)).alias("dir")).join(heads, "dir")
    near = near.groupBy("home").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_license", "dir_cosine")).alias("n"))
    # a hot directory's files are dealt over copies of its one row
    near = near.select("home", "n.dir", "n.dir_license", "n.dir_cosine", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = own.withColumn("salt", F.pmod(F.col("t"), F.lit(SALTS)).cast("int")).join(near, ["home", "salt"], "left")
    return out.select(
        "id", "path", F.coalesce("own_license", "dir_license").alias("license"), F.coalesce("own_cosine", "dir_cosine").alias("cosine"), F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.when(F.col("own_license").isNull(), F.col("dir")).alias("inherited_from"),
    )
