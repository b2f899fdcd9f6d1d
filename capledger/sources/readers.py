"""Readers of the library's inputs.  All go through spark.read, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas


def csv(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """A CSV with a header, bound by name; every column is text unless ddl types it.  A byte-order mark goes."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    if ddl is None:
        return named
    return named.select(*[(F.col(f"`{n}`").try_cast(t) if n in named.columns else F.lit(None).cast(t)).alias(n) for n, t in (f.split() for f in ddl.split(", "))])


def company_list(spark: SparkSession, path: str) -> DataFrame:
    """The company list, without rows whose short name is blank."""
    return csv(spark, path, schemas.COMPANY_LIST).where(F.trim(F.coalesce("company_short_name", F.lit(""))) != "")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """company, line and raw of JSON lines: company is the file's stem, and line counts lines that are not blank, from 1.

    Lines are numbered by their place in the file, which Spark gives per split, so a file is read whole.
    """
    return numbered(spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("company"), F.col("value").alias("text")))


def numbered(files: DataFrame) -> DataFrame:
    """company, line and raw of whole texts (company, text), as of jsonl; with a column part, of texts in parts of whole lines.

    Lines of parts are numbered on: only the parts' counts are summed by company, so a company's lines do not meet in a task.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    if "part" not in files.columns:
        return files.select("company", F.posexplode(lines).alias("line", "raw")).select("company", (F.col("line") + 1).cast("long").alias("line"), "raw")
    counts = files.select("company", "part", F.size(lines).cast("long").alias("n"))
    before = counts.select("company", "part", (F.sum("n").over(W.partitionBy("company").orderBy("part")) - F.col("n")).alias("before"))
    each = files.join(before, ["company", "part"]).select("company", "before", F.posexplode(lines).alias("line", "raw"))
    return each.select("company", (F.col("before") + F.col("line") + 1).alias("line"), "raw")


def records(lines: DataFrame) -> DataFrame:
    """JSON lines as records of text fields (company, line, and the fields of both types)."""
    return lines.select("company", "line", F.from_json("raw", schemas.RAW_RECORD).alias("r")).select("company", "line", "r.*")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """company (the folder's name) and raw of whole JSON documents, corrupt ones as well."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(path, wholetext=True).select(F.get(parts, F.size(parts) - 2).alias("company"), F.col("value").alias("raw"))


def texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_name and text of whole files, without hidden ones."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).where(~F.col("file_name").startswith("."))


def tolerant_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name and text; bytes that are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def company_texts(files: DataFrame, company) -> DataFrame:
    """company and text: a company's files in order of name, each followed by an empty line.  company maps the stem."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    parts = files.withColumn("company", company(stem)).where("company is not null").groupBy("company").agg(F.array_sort(F.collect_list(F.struct("file_name", "text"))).alias("f"))
    return parts.select("company", F.concat(F.array_join(F.transform("f", lambda x: x["text"]), "\n\n"), F.lit("\n\n")).alias("text"))


def head_lines(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """docs with text cut to its first lines."""
    return docs.withColumn(text, F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n"))


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """path, file_name and length of files that are not hidden and begin with prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    return files.where(~F.col("file_name").startswith(".") & F.col("file_name").startswith(prefix))


def preferred_files(files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Of each company folder the file whose name has the first of kinds (then by name); week and hidden folders go."""
    parts = F.split("path", "/")
    company = F.get(parts, F.size(parts) - 2)
    rank = F.lit(len(kinds))
    for i, k in reversed(list(enumerate(kinds))):
        rank = F.when(F.col("file_name").contains(k), i).otherwise(rank)
    ranked = files.withColumn("company", company).where(~F.col("company").rlike(r"^(week|\.)")).withColumn("_rank", rank).where(F.col("_rank") < len(kinds))
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy("company").orderBy("_rank", "file_name"))).where("_n = 1").drop("_n", "_rank")


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of inline rows."""
    return spark.createDataFrame(rows, ddl)
