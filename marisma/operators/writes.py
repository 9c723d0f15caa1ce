"""Writes as pure functions: old frame and new frame in, next frame or planned actions out.

There is one writer; conflicts come back as data instead of being locked out.  Nothing is deleted
but the tail of a re-chunked text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.session import cut_lineage

#: Rows numbered by one task when ids are assigned.
NUMBERED = 500_000


def assign_ids(rows: DataFrame, order: list[str], start: int, key: str = "id") -> DataFrame:
    """``rows`` with consecutive ids after ``start``, in the given order.

    Ids are numbered inside range partitions and shifted by the rows before them, so no single
    task sorts the whole batch; ``start`` is the highest id written so far.
    """
    parts = max(1, -(-rows.count() // NUMBERED))
    # Written once: the bounds of the ranges are sampled, and both branches must see the same ones.
    ranged = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = inside.groupBy("_p").agg(F.count("*").alias("_c"))
    before = before.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return inside.join(F.broadcast(before), "_p").withColumn(key, F.col("_n") + F.col("_o") + start).drop("_p", "_n", "_o")


def new_runs(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming runs (medicamento_origem, versao_processamento) that may be appended: the latest
    registered run of the origin has not this version yet.  An older run of it does not count."""
    return incoming.join(latest.select("medicamento_origem", "versao_processamento"), ["medicamento_origem", "versao_processamento"], "left_anti")


def append_result(runs: DataFrame, relations: DataFrame, links: DataFrame, latest: DataFrame, source: DataFrame, new_run: DataFrame, new_relations: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, relations, links, refused) to append for results of one batch.

    ``new_run`` has medicamento_origem, versao_processamento, hash_texto and run columns, one row an
    origin; relations refer to their run by medicamento_origem and are ordered by ``ordem``; links refer
    to relations by (medicamento_origem, ordem).  A run is refused if its source is gone or has another
    text by now, or if the latest registered run has its version already; the refused carry the reason.
    Ids go on from the greatest so far; links of one target count once.
    """
    own = source.select(F.col("nome_normalizado").alias("medicamento_origem"), F.sha2("trecho_interacoes", 256).alias("_h"))
    seen = latest.select("medicamento_origem", "versao_processamento", F.lit(True).alias("_v"))
    rows = new_run.join(own, "medicamento_origem", "left").join(seen, ["medicamento_origem", "versao_processamento"], "left")
    why = F.when(F.col("_h").isNull(), "FONTE_AUSENTE").when(F.col("_h") != F.col("hash_texto"), "FONTE_ALTERADA").when(F.col("_v"), "VERSAO_REGISTRADA")
    judged = cut_lineage(rows.withColumn("motivo", why).drop("_h", "_v"))
    top = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    run = cut_lineage(assign_ids(judged.where("motivo IS NULL").drop("motivo", "hash_texto"), ["medicamento_origem"], top(runs)))
    run_id = run.select("medicamento_origem", F.col("id").alias("processamento_id"))
    relation = cut_lineage(assign_ids(new_relations.join(run_id, "medicamento_origem"), ["medicamento_origem", "ordem"], top(relations)))
    link = new_links.join(relation.select("medicamento_origem", "ordem", F.col("id").alias("interacao_id")), ["medicamento_origem", "ordem"])
    link = link.groupBy("interacao_id", "medicamento_relacionado").agg(F.min("criterio_vinculo").alias("criterio_vinculo"))
    link = link.join(links.select("interacao_id", "medicamento_relacionado"), ["interacao_id", "medicamento_relacionado"], "left_anti")
    return run, relation.drop("ordem"), link, judged.where("motivo IS NOT NULL").select("medicamento_origem", "motivo")


def failure_rows(failed: DataFrame, version: str, start: int) -> DataFrame:
    """Control rows of sources that failed: status FALHA, no relations, ids after ``start``."""
    rows = failed.select(F.col("nome_normalizado").alias("medicamento_origem")).distinct()
    rows = rows.select("medicamento_origem", F.lit("FALHA").alias("status"), F.lit(version).alias("versao_processamento"), F.lit(0).alias("quantidade_relacoes"), F.lit(0).alias("quantidade_rejeicoes"))
    return assign_ids(rows, ["medicamento_origem"], start)


def pending_only_upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], status: str, pending: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(next frame, incoming rows that changed nothing): only rows in a pending status are overwritten;
    no row is added."""
    hit = old.where(F.col(status).isin(*pending)).select(key)
    kept = new.join(hit, key, "left_semi")
    value = kept.select(key, F.struct(*columns).alias("_n"))
    rows = old.join(value, key, "left")
    out = rows.select(*[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return out, new.join(hit, key, "left_anti")


def count_attempts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status, tentativas): incoming statuses win and count an attempt, unless the old one is
    CONCLUIDO, which stays."""
    done = F.coalesce(F.col("o.status") == "CONCLUIDO", F.lit(False))
    status = F.when(F.col("_n").isNull() | done, F.col("o.status")).otherwise(F.col("n.status"))
    tries = F.when(F.col("_n").isNull() | done, F.col("o.tentativas")).otherwise(F.coalesce(F.col("o.tentativas"), F.lit(0)) + 1)
    return merge(old.select(key, "status", "tentativas"), new.select(key, "status"), key, {"status": status, "tentativas": tries})


def coalesce_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming values where they are not null; rows are never added."""
    rows = old.join(new.select(key, F.struct(*columns).alias("_n")), key, "left")
    return rows.select(*[F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def update_cards(relations: DataFrame, current: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, resumo_card) that may be written, and the refused: a card made from an evidence is written
    only while the relation has that evidence and its run is current."""
    now = relations.join(current.select(F.col("id").alias("processamento_id")), "processamento_id", "left_semi").select("id", "processamento_id", "evidencia")
    accepted = cards.join(now, ["id", "processamento_id", "evidencia"], "left_semi")
    return accepted.select("id", "resumo_card"), cards.join(accepted.select("id"), "id", "left_anti").select("id")


def invalidate_rewrites(relations: DataFrame, changed: DataFrame, control: str = "reescrita_controle") -> DataFrame:
    """(id, controle): the control document of every relation in the (run, target, type) group of a
    changed one, marked as invalidated by its input.  A change that publishes under the prompt in use
    (``publica``) marks nothing."""
    group = ["processamento_id", "alvo", "tipo_alvo"]
    hit = relations.join(changed.where(~F.col("publica")).select("id"), "id", "left_semi").select(*group).distinct()
    rows = relations.join(hit, group, "left_semi")
    old = F.from_json(F.coalesce(F.col(control), F.lit("{}")), "map<string,string>")
    marked = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != "entrada_invalidada"), F.create_map(F.lit("entrada_invalidada"), F.lit("true"))))
    return rows.select("id", marked.alias("controle"))


def ensure_tables(spark, path: str) -> list[str]:
    """Create the empty tables of the schema if the folder has none of them; otherwise validate them.
    The differences found, as text; nothing is ever altered or dropped."""
    from pyspark.errors import AnalysisException

    from marisma.schemas import TABLES, schema_differences

    found = {}
    for name in TABLES:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except AnalysisException:
            continue
    if not found:
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
        return []
    missing = [f"{name}: missing" for name in TABLES if name not in found]
    return missing + [f"{name}.{c}: {want} expected, {got} found" for name, df in found.items() for c, want, got in schema_differences(df, name)]


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(next frame, incoming rows that met an existing key)."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh), new.join(old.select(key), key, "left_semi")


def merge(old: DataFrame, new: DataFrame, key: str, value: dict[str, Column]) -> DataFrame:
    """Full outer merge: each column by its rule over ``o.<column>`` and ``n.<column>``."""
    o = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("o"), F.lit(True).alias("_o"))
    n = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("n"), F.lit(True).alias("_n"))
    return o.join(n, key, "full_outer").select(key, *[rule.alias(c) for c, rule in value.items()])


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], guard: Column) -> DataFrame:
    """Incoming values win where the row is new or ``guard`` (over o.* and n.*) holds."""
    take = F.col("_n").isNotNull() & (F.col("_o").isNull() | F.coalesce(guard, F.lit(False)))
    return merge(old, new, key, {c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in columns})


def fill_nulls(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming values only where the old one is null or blank; rows are never added."""
    n = new.select(key, F.struct(*columns).alias("n"))
    rows = old.join(n, key, "left")
    blank = lambda c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit("")).isNull()
    return rows.select(*[F.when(blank(c), F.coalesce(f"n.{c}", F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def sync_links(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(interacao_id, medicamento_relacionado, criterio_vinculo, acao): what makes the links as desired.

    CRIAR, REATIVAR, ATUALIZAR, MANTER, INVALIDAR; an invalid link that is not desired stays as it
    is.  Links given twice count once: an active one before an invalidated one.
    """
    keys = ["interacao_id", "medicamento_relacionado"]
    d = desired.groupBy(*keys).agg(F.min("criterio_vinculo").alias("_d"), F.lit(True).alias("_tem_d"))
    e = existing.groupBy(*keys).agg(
        F.min_by(F.struct("criterio_vinculo", "invalidado_em"), F.struct(F.col("invalidado_em").isNotNull(), F.coalesce("criterio_vinculo", F.lit("")))).alias("_e")
    )
    rows = d.join(e, keys, "full_outer")
    gone, wanted, known = F.col("_e.invalidado_em").isNotNull(), F.col("_tem_d").isNotNull(), F.col("_e").isNotNull()
    action = (
        F.when(wanted & ~known, "CRIAR")
        .when(wanted & gone, "REATIVAR")
        .when(wanted & ~F.col("_d").eqNullSafe(F.col("_e.criterio_vinculo")), "ATUALIZAR")
        .when(wanted, "MANTER")
        .when(~gone, "INVALIDAR")
    )
    return rows.withColumn("acao", action).where(F.col("acao").isNotNull()).select(*keys, F.when(wanted, F.col("_d")).otherwise(F.col("_e.criterio_vinculo")).alias("criterio_vinculo"), "acao")


def invalidate(runs: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Runs with the given ids withdrawn; an earlier withdrawal keeps its time."""
    hit = ids.select("id", F.lit(True).alias("_i")).distinct()
    rows = runs.join(hit, "id", "left")
    when = F.when(F.col("_i"), F.coalesce("invalidado_em", at)).otherwise(F.col("invalidado_em"))
    return rows.withColumn("invalidado_em", when).select(*runs.columns)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after re-chunking: incoming (nome_normalizado, chunk_index) win and the tail beyond
    the incoming chunks of a name goes."""
    keys = ["nome_normalizado", "chunk_index"]
    last = new.groupBy("nome_normalizado").agg(F.max("chunk_index").alias("_m"))
    kept = old.join(last, "nome_normalizado", "left").where(F.col("_m").isNull() | (F.col("chunk_index") <= F.col("_m"))).drop("_m")
    return kept.join(new.select(*keys), keys, "left_anti").unionByName(new)


def reserve(queue: DataFrame, most: int, attempts: int = 3) -> DataFrame:
    """Oldest available items, at most ``most``: (id, tentativas + 1)."""
    free = queue.where((F.col("estado") == "PENDENTE") & (F.col("tentativas") < attempts))
    return free.orderBy("criado_em", "id").limit(most).select("id", (F.col("tentativas") + 1).alias("tentativas"))
