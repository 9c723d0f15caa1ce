"""Append-only history of runs and what is current in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions.text import not_blank

DONE = ("CONCLUIDO_COM_RELACOES", "CONCLUIDO_SEM_RELACOES")


def eligible(source: DataFrame) -> DataFrame:
    """Sources that were read and have a text."""
    return source.where((F.col("status_extracao") == "CONCLUIDO") & not_blank(F.col("trecho_interacoes")))


def _latest(runs: DataFrame, source: DataFrame, status: tuple[str, ...]) -> DataFrame:
    # The whole row is the aggregate's value, so one partial aggregation replaces sort and window.
    alive = runs.where(F.col("invalidado_em").isNull() & F.col("status").isin(*status))
    alive = alive.join(eligible(source).select(F.col("nome_normalizado").alias("medicamento_origem")), "medicamento_origem", "left_semi")
    newest = alive.groupBy("medicamento_origem").agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns]), F.col("id")).alias("_r"))
    return newest.select("_r.*")


def current_runs(runs: DataFrame, source: DataFrame) -> DataFrame:
    """Last concluded run, not withdrawn, of every origin with an eligible source.  A later failure
    or review does not withdraw an earlier conclusion."""
    return _latest(runs, source, DONE)


def registered_runs(runs: DataFrame, source: DataFrame) -> DataFrame:
    """Like :func:`current_runs`, counting runs under review."""
    return _latest(runs, source, (*DONE, "REVISAO_NECESSARIA"))


def history_with_flag(runs: DataFrame, source: DataFrame) -> DataFrame:
    """Every run with whether it is the current one of its origin."""
    current = current_runs(runs, source).select("id", F.lit(True).alias("_v"))
    kept = ["id", "medicamento_origem", "status", "quantidade_relacoes", "quantidade_rejeicoes"]
    return runs.join(current, "id", "left").select(*kept, F.col("_v").isNotNull().alias("vigente"))


def pending_sources(runs: DataFrame, source: DataFrame, version: str | None = None) -> DataFrame:
    """Eligible sources whose latest registered run has not this version; new ones first by flag."""
    last = registered_runs(runs, source)
    if version is not None:
        last = last.where(F.col("versao_processamento") == version)
    seen = runs.select(F.col("medicamento_origem").alias("nome_normalizado")).distinct().withColumn("_visto", F.lit(True))
    due = eligible(source).join(last.select(F.col("medicamento_origem").alias("nome_normalizado")), "nome_normalizado", "left_anti")
    flag = F.col("_visto").isNotNull().alias("ja_processado")
    return due.join(seen, "nome_normalizado", "left").select("nome_normalizado", F.sha2("trecho_interacoes", 256).alias("hash_texto"), flag)


def version_fingerprint(terms: DataFrame, term: Column, kind: Column) -> DataFrame:
    """One row: the hash of the sorted dictionary.  The list is the dictionary itself, whose size
    the caller bounds; it is hashed by parts so that no long string is built per row."""
    lines = terms.select(F.concat_ws("\t", term, kind).alias("l")).distinct()
    parts = lines.groupBy(F.substring(F.sha2("l", 256), 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), "\n"), 256).alias("versao"))
