"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Fixed value: the ASCII capitals, which "lower-case A-Z" means here.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a temporary
    folder; on a cluster, whose executors would not share it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() wrote for df, once nothing will read it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparkloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """materialize(df) with each row's number, from 0, in the order in which df was laid out over its partitions.

    A row's number is its place in its file after the rows of all files before; the table of files, one row each, is broadcast.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    # a part's number may outgrow its five digits, so names alone do not order files
    file, part = F.col("_metadata.file_name"), F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    back = df.sparkSession.read.schema(df.schema).parquet(path).select("*", part.alias("__part"), file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = back.groupBy("__part", "__file").agg(F.count("*").alias("__n"))
    files = files.select("__part", "__file", (F.sum("__n").over(Window.orderBy("__part", "__file")) - F.col("__n")).alias("__start"))
    return back.join(F.broadcast(files), ["__part", "__file"]).select(*df.columns, (F.col("__start") + F.col("__row")).alias(name))


def aside(docs: DataFrame) -> DataFrame:
    """docs with every column c named __doc_c: whatever they are called, none meets a column of an operator's own. toDF(*docs.columns) names them back."""
    return docs.toDF(*(f"__doc_{c}" for c in docs.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ASCII-only texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
