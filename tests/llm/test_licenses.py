import math
import re
from collections import Counter

import duckdb

from sparkloom.llm import licenses as x
from pyspark.sql import functions as F


def brute(files):
    """Own licence by comparing every line with every template, then a walk up the directories."""
    rows = [(name, Counter(re.findall("[a-z0-9]+", t))) for name, ts in sorted(x.TEMPLATES.items()) for t in ts]
    df = Counter(w for _, c in rows for w in c)
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
    own, heads = {}, {}
    for i, path, text in files:
        lines, stated = [], 0
        for line in (text or "").lower().split("\n"):
            c = Counter(re.findall("[a-z0-9]+", line))
            best = min(((-round(sum(n * t[w] * idf(w) ** 2 for w, n in c.items()) / norm(c) / norm(t), 6), name) for name, t in rows), default=None) if c else None
            if best and -best[0] >= x.MIN_COSINE:
                lines.append(best)
                stated += sum(c.values())
        if lines:
            whole = stated >= x.MIN_SHARE * len(re.findall("[a-z0-9]+", (text or "").lower()))
            own[i] = (*min(lines), whole)
            if whole:
                d = path.rpartition("/")[0]
                heads[d] = min(heads.get(d, (9,)), (min(lines)[0], path, min(lines)[1]))
    out = []
    for i, path, _ in files:
        if i in own:
            out.append((i, path, own[i][1], -own[i][0], own[i][2], None))
            continue
        d = path.rpartition("/")[0]
        while d and d not in heads:
            d = d.rpartition("/")[0]
        out.append((i, path, heads[d][2], -heads[d][0], False, d) if d in heads else (i, path, None, None, False, None))
    return sorted(out, key=str)


def test_tree(spark):
    long = "word " * 30_000
    files = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "# Licensed under the Apache License, Version 2.0\nx = 1\n" + long), (3, "a/b/d.py", "x"), (4, "a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/e/f.py", None), (6, "z/q.py", ""), (7, "a/NOTICE", "All rights reserved."), (8, "a/b/c.py/g", "released under mit"), (9, "weird//x", "y"), (10, "ab/x", "Licensed under CC BY-NC 4.0"), (11, "ab/y", "é"),
    ]
    frame = spark.createDataFrame([(*f, "clash") for f in files], "doc_id long, p string, text string, license string")
    got = sorted(map(tuple, x.scan(frame, F.col("p")).collect()), key=str)
    assert got == brute(files)
    assert {g[0]: g[2] for g in got}[5] == "GPL-3.0" and {g[0]: g[2] for g in got}[6] == "MIT"
    twice = x.scan(frame.union(frame), F.col("p")).collect()
    assert sorted(map(tuple, twice), key=str) == sorted(brute(files) * 2, key=str)
    assert x.scan(frame.limit(0), F.col("p")).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], "doc_id long, p string, text string")
    assert [tuple(r) for r in x.scan(nulls, F.col("p")).collect()] == [(None, "", None, None, False, None)]


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    files = duckdb.sql(f"SELECT doc_id, concat_ws('/', source, lang, doc_id), text FROM '{path}'").fetchall()
    got = x.scan(spark.read.parquet(path), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).collect()
    assert sorted(map(tuple, got), key=str) == brute(files)


def test_full_texts(spark):
    """Whole licence files cover their directories, and headers count over several lines or inside one."""
    text = lambda name: "\n".join(x.full_texts()[name][-1:]).replace("\t", " ")
    mit = text("MIT").partition("Permission is")
    header = x.full_texts()["GPL-3.0"][0].split()
    lines = "\n".join(" * " + " ".join(header[k : k + 9]) for k in range(0, len(header), 9))
    pad = "def value of some other code " * 400
    files = [
        (1, "a/LICENSE", "Copyright (c) 2031 Jo Doe\n\n" + mit[1] + mit[2]), (2, "a/x/y.py", "code"), (3, "b/LICENSE", text("Apache-2.0")), (4, "b/c.py", "code"), (5, "b/g/COPYING", text("GPL-3.0")), (6, "b/g/h/i.c", None),
        (7, "n/one.c", f"/*\n{lines}\n */\n{pad}"), (8, "n/two.txt", f"{pad} licensed under the Apache License, Version 2.0 {pad}"), (9, "n/mit.c", pad + "\n" + text("MIT") + pad), (10, "n/none.c", pad + " the license of this is none"), (11, "g2/COPYING", text("GPL-2.0")),
        (12, "n/README", pad * 3 + text("GPL-3.0")), (13, "d/LICENSE", text("BSD-2-Clause")), (14, "e/LICENSE", text("BSD-3-Clause")), (15, "n/all.txt", pad + "Copyright 2031 X. All rights reserved. " + pad),
    ]
    frame = spark.createDataFrame(files, "doc_id long, p string, text string")
    got = {r.id: (r.license, r.licence_file, r.inherited_from) for r in x.scan(frame, F.col("p")).collect()}
    assert got == {
        1: ("MIT", True, None), 2: ("MIT", False, "a"), 3: ("Apache-2.0", True, None), 4: ("Apache-2.0", False, "b"), 5: ("GPL-3.0", True, None), 6: ("GPL-3.0", False, "b/g"), 7: ("GPL-3.0", False, None), 8: ("Apache-2.0", False, None),
        9: ("MIT", False, None), 10: (None, False, None), 11: ("GPL-2.0", True, None), 12: ("GPL-3.0", got[12][1], None), 13: ("BSD-2-Clause", True, None), 14: ("BSD-3-Clause", True, None), 15: ("all-rights-reserved", False, None),
    }
