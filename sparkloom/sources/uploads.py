"""Uploaded files to records: one row for each CSV record, sheet row, text or page."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The parser of each file extension.
KINDS = {"csv": "csv", "xlsx": "sheet", "xls": "sheet", "pdf": "pdf", "txt": "text", "md": "text", "markdown": "text", "json": "text", "html": "html", "htm": "html"}
#: Names of CSV columns by role, in order of preference.
ROLES = {"title": "title|name|headline|subject", "url": "url|permalink|link|href", "date": "date|published|created|updated", "id": "id|key|sku"}
SHEET_ROWS = 20_000


def kind(name: Column) -> Column:
    """The parser of a file's name; null where there is none."""
    table = F.create_map(*(F.lit(x) for item in KINDS.items() for x in item))
    return F.when(F.contains(name, F.lit(".")), F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One record a row: title, url, and content of "Header: value" lines without blank cells; blank rows go."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    cell = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`"))))
    role = {r: next((c for p in names.split("|") for c in rows.columns if c.strip().lower() == p), None) for r, names in ROLES.items()}
    of = lambda r: F.col(f"`{role[r]}`") if role[r] else F.lit(None).cast("string")
    out = rows.select(of("title").alias("title"), F.regexp_replace(of("url"), "#.*", "").alias("url"), of("date").alias("date"), of("id").alias("id"), F.concat_ws("\n", *map(cell, rows.columns)).alias("content"))
    return out.where("content <> ''")


def text_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("title"), F.col("value").alias("content"))


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, str]]:
    """Sheet, row number and "Header: value" lines of an XLSX file's rows."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{{{space['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", space)]
        for k, name in enumerate(sheets, 1):
            head: dict[str, str] = {}
            for n, row in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iterfind(".//m:row", space), 1):
                if n > SHEET_ROWS + 1:
                    break
                cells = {}
                for c in row.iterfind("m:c", space):
                    value = c.find("m:v", space)
                    text = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")) if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    cells[re.sub(r"\d", "", c.get("r", ""))] = text.strip()
                if n == 1:
                    head = cells
                elif any(cells.values()):
                    yield name, n, "\n".join(f"{head.get(c) or c}: {v}" for c, v in cells.items() if v)


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row and content of every row of every sheet below its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content):
                yield pd.DataFrame([(name, *r) for r in sheet_rows(data)], columns=["file", "sheet", "row", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, content string")


def pdf_text(text: Column) -> Column:
    """Text of a PDF's text layer with hyphenated and wrapped lines joined."""
    joined = F.regexp_replace(F.regexp_replace(text, r"-\n(\p{Ll})", "$1"), r"(\p{Ll},?)\n(\p{Ll})", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
