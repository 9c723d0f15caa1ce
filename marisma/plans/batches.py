"""Batch drivers: what is pending goes through one plan and is appended; a dry run stops before that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marisma.functions.text import is_filled
from marisma.operators import catalog, identify, selections, writes
from marisma.operators.answers import ORIGIN, Corpus
from marisma.plans.runs import pending_sources, registered_runs, version_fingerprint
from marisma.session import cut_lineage


@dataclass(frozen=True)
class Batch:
    """Frames to append, what was refused, and one report row for each source."""

    runs: DataFrame
    relations: DataFrame
    links: DataFrame
    refused: DataFrame
    report: DataFrame


def current_version(c: Corpus) -> str:
    """Version of an identification: rules and dictionary; either change makes all sources pending."""
    rules = F.sha2(F.lit("\n".join(identify.ignored_terms())), 256)
    row = version_fingerprint(catalog.terms(c.catalog), F.col("termo"), F.col("tipo")).select(F.concat(F.lit("dicionario/1#"), F.substring(rules, 1, 12), F.lit("|"), F.substring("versao", 1, 12)))
    return row.first()[0]


def identification(c: Corpus, version: str | None = None, names: list[str] | None = None, reprocess: bool = False, limit: int | None = None) -> Batch:
    """Identify the pending sources (all eligible ones with ``reprocess``), in order: never processed
    first, then by name; ``limit`` takes that many from the front."""
    version = current_version(c) if version is None else version
    due = pending_sources(c.runs, c.source, None if reprocess else version) if not reprocess else pending_sources(c.runs.limit(0), c.source, version)
    if names is not None:
        due = due.where(F.col("nome_normalizado").isin(*names))
    if limit is not None:
        due = due.orderBy("ja_processado", "nome_normalizado").limit(limit)
    due = cut_lineage(due)
    source = c.source.join(due.select("nome_normalizado"), "nome_normalizado", "left_semi")
    # Relations, counts and rejections read the judged matches; rules are applied once.
    found = cut_lineage(identify.identify(source, c.catalog))
    relations = cut_lineage(identify.relations(found))
    status = identify.run_status(source, identify.counts(found))
    rejected = identify.rejections(found).groupBy("nome_normalizado").agg(F.count("*").alias("_r"))
    run = status.join(due, "nome_normalizado").join(rejected, "nome_normalizado", "left").select(
        F.col("nome_normalizado").alias(ORIGIN), F.lit(version).alias("versao_processamento"), "hash_texto", "status", F.col("relacoes").cast("int").alias("quantidade_relacoes"),
        F.coalesce("_r", F.lit(0)).cast("int").alias("quantidade_rejeicoes"), F.lit("dicionario").alias("modelo"), "aviso",
    )
    order = Window.partitionBy("nome_normalizado").orderBy("trecho", "alvo", "ordem")
    rel = relations.select(F.col("nome_normalizado").alias(ORIGIN), F.row_number().over(order).alias("ordem"), "alvo", "tipo_alvo", "resumo", "evidencia")
    link = catalog.resolve(rel.select(ORIGIN, "ordem", "alvo"), c.catalog, "alvo", ORIGIN).select(ORIGIN, "ordem", "medicamento_relacionado", "criterio_vinculo")
    new_run, new_rel, new_link, refused = writes.append_result(c.runs, c.relations, c.links, registered_runs(c.runs, c.source), c.source, run.drop("aviso"), rel, link)
    report = run.select(ORIGIN, "status", "quantidade_relacoes", "quantidade_rejeicoes", "aviso").join(refused, ORIGIN, "left")
    return Batch(new_run, new_rel, new_link, refused, report)


def relink(c: Corpus, names: DataFrame | None = None) -> DataFrame:
    """Actions that bring the links of current relations up to the catalogue: of all of them, or of those
    that new or changed entries affect."""
    if names is None:
        wanted = catalog.resolve(c.current_relations().select("id", ORIGIN, "alvo"), c.catalog, "alvo", ORIGIN).select("id", "medicamento_relacionado", "criterio_vinculo")
        held = c.links.join(c.current_relations().select(F.col("id").alias("interacao_id")), "interacao_id", "left_semi")
    else:
        wanted = cut_lineage(selections.relinked(c, names))
        held = c.links.join(wanted.select(F.col("id").alias("interacao_id")).distinct(), "interacao_id", "left_semi")
    return writes.sync_links(wanted.withColumnRenamed("id", "interacao_id"), held)


def save(spark: SparkSession, batch: Batch, path: str) -> int:
    """Append a batch to the tables of a folder; the number of runs written.  Relations and links go first:
    without their run they are not current and a repetition supersedes them."""
    from marisma.schemas import TABLES

    for name, df in (("interacoes_medicamentos", batch.links), ("interacoes", batch.relations), ("processamentos_interacoes", batch.runs)):
        schema = TABLES[name]
        columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        df.select(*columns).write.mode("append").parquet(f"{path}/{name}.parquet")
    return batch.runs.count()


def done_files(catalog_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose document is among the files (path) already, by its deterministic name."""
    from marisma.operators.layout import file_name

    have = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_f")).distinct()
    return catalog_rows.withColumn("_f", file_name(F.col("nome_normalizado"), F.col("numero_registro"))).join(have, "_f", "left_semi").drop("_f")


def summary_sample(c: Corpus, size: int) -> DataFrame:
    """Relations for a benchmark of summaries: different evidences first, then by id; ``size`` of them."""
    rank = F.row_number().over(Window.partitionBy(F.xxhash64("evidencia"), F.length("evidencia")).orderBy("id"))
    rows = c.current_relations().where(is_filled(F.col("evidencia"))).withColumn("_r", rank)
    return rows.orderBy("_r", "id").limit(size).select("id", ORIGIN, "alvo", "evidencia")


def has_work(pending: DataFrame) -> bool:
    """Whether anything is pending, before a model is loaded for it."""
    return not pending.isEmpty()
