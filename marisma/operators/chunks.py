"""Token chunks of texts, their hashes, and checks of their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk_index, tokens, texto_chunk): windows of ``size`` blank-separated tokens that share
    ``overlap`` with the next; a text that fits is kept as it is.  Null and blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    rows = df.select(key, F.col(text).alias("_t"), F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
    last = F.when(F.size("_w") <= size, 0).otherwise(F.ceil((F.size("_w") - size) / F.lit(step))).cast("int")
    rows = rows.select(key, "_t", "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    own = F.slice("_w", F.col("chunk_index") * step + 1, size)
    return rows.select(key, "chunk_index", F.size(own).alias("tokens"), F.when(F.size("_w") <= size, F.col("_t")).otherwise(F.array_join(own, " ")).alias("texto_chunk"))


def chunk_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def token_windows(counts: Column, budget: int) -> Column:
    """First unit of each window when units of the given token counts are packed in order into
    windows of ``budget`` tokens; a unit beyond the budget is a window of its own."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("soma"), F.array().cast("array<int>").alias("cortes"))

    def add(acc: Column, n: Column) -> Column:
        new = (acc["i"] == 0) | (acc["soma"] + n > budget)
        return F.struct((acc["i"] + 1).alias("i"), F.when(new, n).otherwise(acc["soma"] + n).cast("int").alias("soma"), F.when(new, F.concat(acc["cortes"], F.array(acc["i"]))).otherwise(acc["cortes"]).alias("cortes"))

    return F.aggregate(counts, start, add, lambda acc: acc["cortes"])


def norm(vector: Column) -> Column:
    """Euclidean norm in double precision; null for a null vector."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def vector_state(vector: Column, dimension: int) -> Column:
    """OK, NULO, DIMENSAO, NAO_FINITO or ZERO."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull(), "NULO").when(F.size(vector) != dimension, "DIMENSAO").when(bad, "NAO_FINITO")
        .when(~F.exists(vector, lambda x: x != 0), "ZERO").otherwise("OK")
    )


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, media): element-wise mean of the vectors of each key, by position, with partial sums; null
    elements do not count."""
    rows = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = rows.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("media"))


def unit_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """:func:`mean_vector` of length one; a mean of length zero stays as it is."""
    rows = mean_vector(df, keys, vector)
    length = norm(F.col("media"))
    return rows.withColumn("media", F.when(length > 0, F.transform("media", lambda x: x / length)).otherwise(F.col("media")))


def chunk_coverage(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(nome_normalizado, blocos, continuo): whether the chunk numbers of a text run from 0 without gap."""
    counted = chunks.groupBy("nome_normalizado").agg(F.count_distinct("chunk_index").alias("blocos"), F.max("chunk_index").alias("_m"))
    rows = texts.select("nome_normalizado").distinct().join(counted, "nome_normalizado", "left")
    return rows.select("nome_normalizado", F.coalesce("blocos", F.lit(0)).alias("blocos"), F.coalesce(F.col("_m") + 1 == F.col("blocos"), F.lit(False)).alias("continuo"))
