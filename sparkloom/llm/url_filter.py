"""URL filter: a sorted array of 64-bit digests, memory-mapped by every worker.

The array's file travels with ``SparkContext.addFile``. For each page the keys host suffix + path prefix
are hashed, found by binary search over a whole batch at once, and compared with the stored strings.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rules that are memory-mapped at most; more are joined by their keys instead.
MAX_MAPPED = 20_000_000

Rule = tuple[str, str, str]  # host, path, verdict


def write_rules(rules: Sequence[Rule]) -> str:
    """Write rules as one file: count, digests in order, string offsets, host lengths, verdicts, strings."""
    rows = sorted((xxhash.xxh64_intdigest(f"{host}{path}"), f"{host}{path}".encode(), len(host), verdict == "allow") for host, path, verdict in {(h, p): (h, p, v) for h, p, v in rules}.values())
    ends = np.cumsum([0, *(len(r[1]) for r in rows)])
    body = struct.pack("<Q", len(rows)) + np.array([r[0] for r in rows], "<u8").tobytes() + ends.astype("<u8").tobytes() + np.array([r[2] for r in rows], "<u4").tobytes() + np.array([r[3] for r in rows], "u1").tobytes() + b"".join(r[1] for r in rows)
    path = Path(tempfile.mkdtemp(prefix="sparkloom-")) / f"url-rules-{uuid.uuid4().hex}.bin"  # a name that no other call has added
    path.write_bytes(body)
    return str(path)


class RuleArray:
    """The memory-mapped file."""

    def __init__(self, path: str):
        n = struct.unpack("<Q", Path(path).open("rb").read(8))[0]
        part = lambda kind, count, at: np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind)
        self.digests, self.ends = part("<u8", n, 8), part("<u8", n + 1, 8 + 8 * n)
        self.hosts, self.allow = part("<u4", n, 16 + 16 * n), part("u1", n, 16 + 20 * n)
        self.strings = part("u1", int(self.ends[-1]), 16 + 21 * n)

    def string(self, k: int) -> str:
        return self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode()

    def find(self, keys: list[str], hosts: list[int]) -> list[int]:
        """For each key (host part of so many characters) the index of the rule with that very string, or -1."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        out = np.full(len(keys), -1)
        first, last = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        for q in np.flatnonzero(first < last):
            out[q] = next((k for k in range(first[q], last[q]) if self.hosts[k] == hosts[q] and self.string(k) == keys[q]), -1)
        return out.tolist()


_arrays: dict[str, RuleArray] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where :// is missing."""
    _, mark, rest = (url or "").partition("://")
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return (host.translate(_LOWER), slash + path) if mark else ("", "")


_LOWER = {c: c + 32 for c in range(65, 91)}


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    out = [host] if host else []
    while "." in host:
        host = host.partition(".")[2]
        out.append(host)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with its path; the longest rule string wins, then
    the one of the longer host. rules are a list, or a table (host, path, verdict, and n where the order of repeats matters). Where none fits, rule is null and verdict is ``default``. Null urls and urls without :// have an
    empty host and path. Rules that repeat a host and path count once, the last one (of a table the one of the largest n, then "block"). No pages, no rows; no rules, all
    default. Repeated ids are rows of their own, and other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_MAPPED:
        return judge_by_join(rows, rules, default)
    spark: SparkSession = pages.sparkSession
    file = write_rules(rules)
    spark.sparkContext.addFile(file)
    name, lengths = Path(file).name, sorted({len(p) for _, p, _ in rules})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _arrays:
            _arrays[name] = RuleArray(SparkFiles.get(name))
        array = _arrays[name]
        for batch in batches:
            parts = [split_url(u if isinstance(u, str) else None) for u in batch.url]
            keys, hosts, owners = [], [], []
            for row, (host, path) in enumerate(parts):
                for domain in suffixes(host):
                    for n in lengths:
                        if n <= len(path):
                            keys.append(domain + path[:n])
                            hosts.append(len(domain))
                            owners.append(row)
            best: dict[int, tuple[int, int, int]] = {}
            for row, key, host, k in zip(owners, keys, hosts, array.find(keys, hosts)):
                if k >= 0:
                    best[row] = max(best.get(row, (-1, -1, -1)), (len(key), host, k))
            found = [best.get(row, (0, 0, -1))[2] for row in range(len(parts))]
            yield pd.DataFrame({
                "page_id": batch.page_id, "host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [array.string(k) if k >= 0 else None for k in found],
                "verdict": [default if k < 0 else "allow" if array.allow[k] else "block" for k in found],
            })

    return rows.mapInPandas(probe, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judge_by_join(rows: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """judge() of rows (page_id, url) for rules beyond a worker's memory: the keys of distinct urls meet the table of rules in a shuffle join."""
    spark = rows.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "n long, host string, path string, verdict string")
    rank = F.struct(F.col("n") if "n" in table.columns else F.lit(0), F.col("verdict"))
    table = table.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max(rank)["verdict"].alias("r_verdict"))
    lengths = [r[0] for r in table.select(F.length("r_path")).distinct().collect()]  # as many as paths have lengths
    rest = F.regexp_extract("url", r"^(?s:.*?)://([^?#]*)", 1)
    host = F.coalesce(F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/]*((?s:.*))$", 1), F.lit(""))
    labels = F.split("host", r"\.")
    keys = rows.select("url").where("url IS NOT NULL").distinct().select("url", host.alias("host"), path.alias("path"))
    keys = keys.select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host")).where("r_host <> ''")
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = keys.select("url", "r_host", F.explode(F.transform(fits, lambda n: F.substring("path", F.lit(1), n))).alias("r_path"))
    found = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = keys.join(table, ["r_host", "r_path"]).groupBy("url").agg(F.max(found).alias("b"))
    out = rows.select("page_id", "url", host.alias("host"), path.alias("path")).join(best, "url", "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


#: DuckDB SQL of judge() over pages with the query's five rules.
SQL = """
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^?#]*)', 1), '') AS rest FROM pages),
x AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
f AS (SELECT page_id, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
      FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT x.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN f ON x.page_id = f.page_id
"""
