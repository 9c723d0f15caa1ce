"""Readers and writers of the engine's tables and exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions.text import fold_name
from marisma.schemas import TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table with its declared schema, so that no file is opened to infer one."""
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A table of a relational database, read in parallel by ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.options(**options).load()


def read_names(spark: SparkSession, path: str, column: str, sep: str = ";") -> DataFrame:
    """Names of a delimited sheet, normalised: (nome, original, vezes, ordem); the first spelling by file
    order is kept and ``ordem`` is its place, blank rows are skipped.  A row without a name that has
    other cells is an error."""
    sheet = spark.read.csv(path, sep=sep, header=True, encoding="utf-8")
    first = sheet.columns[0]
    sheet = sheet.withColumnRenamed(first, first.lstrip("﻿"))
    other = F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in sheet.columns if c != column])
    nameless = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    if not sheet.where(nameless & F.exists(other, lambda x: x != "")).isEmpty():
        raise ValueError(f"a row has no {column}")
    rows = sheet.select(F.col(column).alias("original"), F.monotonically_increasing_id().alias("_p"))
    rows = rows.withColumn("nome", fold_name("original")).where(F.coalesce("nome", F.lit("")) != "")
    return rows.groupBy("nome").agg(F.min_by("original", "_p").alias("original"), F.count("*").alias("vezes"), F.min("_p").alias("ordem"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(termo): one per line, ``#`` starts a comment."""
    lines = spark.read.text(path).select(fold_name(F.split("value", "#")[0]).alias("termo"))
    return lines.where("termo <> ''").distinct()


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of the files that begin as a PDF does; contents are not kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", F.sha2("content", 256).alias("sha256"), "length")


def write_report(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A ;-separated report that refuses to overwrite; rows are range-sorted, not gathered."""
    rows = df.sort(*order) if order else df
    rows.write.mode("errorifexists").csv(path, sep=";", header=True)


def write_details(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_table(df: DataFrame, path: str, name: str) -> None:
    """Append rows to a table, columns in declared order."""
    df.select(*TABLES[name].names).write.mode("append").parquet(f"{path}/{name}.parquet")
