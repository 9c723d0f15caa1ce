"""Integrity as data: keys, references, checks and what triggers would refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions.text import not_blank


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of every key that occurs more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(column, n): references without a parent; null refers to nothing."""
    rows = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return rows.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def check_violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, regra) for every check that is false; a check that is NULL passes."""
    failed = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(None)).otherwise(F.lit(name)) for name, c in checks.items()])
    return df.select(key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("regra"))


def origin_mismatches(relations: DataFrame, runs: DataFrame) -> DataFrame:
    """Relations whose origin is not their run's origin."""
    own = runs.select(F.col("id").alias("processamento_id"), F.col("medicamento_origem").alias("_o"))
    return relations.join(own, "processamento_id").where(~F.col("medicamento_origem").eqNullSafe(F.col("_o"))).select("id", "processamento_id")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys in both frames of which one of the columns changed, null-safe."""
    b = new.select(key, F.struct(*columns).alias("_b"))
    return old.select(key, F.struct(*columns).alias("_a")).join(b, key).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def protected_sources(old: DataFrame, new: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources whose text or status changed although runs of them are still valid."""
    changed = changed_rows(old, new, "nome_normalizado", ["trecho_interacoes", "status_extracao"])
    valid = runs.where(F.col("invalidado_em").isNull()).select(F.col("medicamento_origem").alias("nome_normalizado"))
    return changed.join(valid, "nome_normalizado", "left_semi")


def invalidation_cascade(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """Relations whose rewrite is stale: all of the (run, target, type) group of a changed one."""
    group = ["processamento_id", "alvo", "tipo_alvo"]
    hit = relations.join(changed.select("id"), "id", "left_semi").select(*group).distinct()
    return relations.join(hit, group, "left_semi").select("id", "processamento_id")


def table_fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(linhas, soma_a, soma_b): equal for equal row sets, whatever their order.

    Row digests are added, so the table is hashed in one pass with partial sums; a digest over an
    ordered concatenation would need all rows in one task.
    """
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [key, *columns]]))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("linhas"), F.sum(half(1)).alias("soma_a"), F.sum(half(9)).alias("soma_b"))


def eligible_share(source: DataFrame) -> DataFrame:
    """One row: sources with a text by status, for the coverage alarm."""
    return source.groupBy("status_extracao").agg(F.count("*").alias("fontes"), F.count_if(not_blank(F.col("trecho_interacoes"))).alias("com_texto"))


def quality_alarm(rows: DataFrame, weak: Column, done: Column, most: float = 0.2) -> DataFrame:
    """One row: weak results against the concluded ones, and whether their share is beyond ``most``."""
    share = F.try_divide(F.count_if(weak), F.count_if(done))
    return rows.agg(F.count("*").alias("total"), F.count_if(weak).alias("fracos"), F.round(share, 6).alias("parte"), F.coalesce(share > most, F.lit(False)).alias("alarme"))
