"""Uploaded files: first-come deduplication, what a host still lacks, message parts."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions import text as tx


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as path, size, time and body."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def first_uploads(uploads: DataFrame) -> DataFrame:
    """One row per session and file name: the first upload stays and later bodies are ignored.

    uploads: session_id, seq, file_name and more; ties of seq fall to the smallest row.
    """
    keys = ["session_id", "file_name"]
    rest = F.struct("seq", *[c for c in uploads.columns if c not in ("seq", *keys)])
    first = uploads.groupBy(*keys).agg(F.min(rest).alias("first"))
    return first.select(*keys, "first.*").select(*uploads.columns)


def downloaded(answers: DataFrame, *keys: str) -> DataFrame:
    """What downloads bring: ok, file_name and body, or the error. answers: url, status, content_type, body and the keys.

    Fetching is the caller's; an address that is none of the web, no answer and a status of 400 or more are errors.
    """
    error = (
        F.when(~tx.is_web_address(F.col("url")), "not a web address").when(F.col("status").isNull(), "no answer")
        .when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status").cast("string")))
    )
    good = lambda c: F.when(error.isNull(), c)
    return answers.select(
        *keys, "url", error.isNull().alias("ok"), good(tx.file_name(F.col("url"), F.col("content_type"))).alias("file_name"), error.alias("error"), good(F.col("body")).alias("body")
    )


def unsent(files: DataFrame, active: DataFrame, host: str) -> DataFrame:
    """Active files that the host does not have; other kinds than PDFs and images are skipped.

    files: file_id, file_name, host_ids map; active: file_id.
    """
    kinds = tx.is_pdf(F.col("file_name")) | tx.is_image(F.col("file_name"))
    missing = ~F.coalesce(F.map_contains_key("host_ids", F.lit(host)), F.lit(False))
    return files.join(active.select("file_id").distinct(), "file_id", "left_semi").filter(kinds & missing)


def message_parts(files: DataFrame, active: DataFrame, host: str) -> DataFrame:
    """Active files present on the host as parts of a message: images by their id, other files as files."""
    there = files.join(active.select("file_id").distinct(), "file_id", "left_semi").filter(F.map_contains_key("host_ids", F.lit(host)))
    kind = F.when(tx.is_image(F.col("file_name")), F.lit("input_image")).otherwise(F.lit("input_file"))
    return there.select("file_id", kind.alias("type"), F.element_at("host_ids", F.lit(host)).alias("host_file_id"))


def write_files(files: DataFrame, folder: str) -> None:
    """Bodies under session_id= / file_id= folders, so a session or a file goes by dropping one."""
    files.write.mode("append").partitionBy("session_id", "file_id").parquet(folder)


def drop_session(spark: SparkSession, folder: str, session_id: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/session_id={session_id}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def code_that_returns(source: str) -> str:
    """The program with its last expression bound to ``_result``; one that does not parse, or does not end in an expression, stays.

    Nothing is run: whatever sandbox executes the text reads ``_result``.
    """
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return source
    if not tree.body or not isinstance(tree.body[-1], ast.Expr):
        return source
    last = tree.body[-1]
    tree.body[-1] = ast.Assign([ast.Name("_result", ast.Store())], last.value, lineno=last.lineno)  # the only place that unparse reads
    return ast.unparse(tree)


def returning(code):
    """``code_that_returns`` over a column, in Arrow batches (parsing Python has no JVM counterpart)."""

    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else code_that_returns(x))

    return rewrite(code)


def returned(programs: DataFrame, key: str) -> DataFrame:
    """Programs (the key, ``code`` and more) with their last expressions bound.

    They are dealt out by the key first: programs take far longer to rewrite than to read, and a small file of many is read
    by few tasks.
    """
    return programs.repartition(key).withColumn("code", returning(F.col("code")))
