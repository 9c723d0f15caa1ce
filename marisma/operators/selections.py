"""What is still to be done: selections by missing or outdated results, and what changes affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions.text import fold_target, is_filled, list_of, not_blank
from marisma.operators.answers import ORIGIN, Corpus
from marisma.operators.catalog import catalog_keys, key_words, resolve, without_salt
from marisma.plans.runs import eligible, registered_runs

PENDING_EXTRACTION = ("ERRO", "REVISAO_MANUAL", "PENDENTE")


def extraction_needs(catalog: DataFrame, source: DataFrame, reprocess: bool = False) -> DataFrame:
    """(nome_normalizado, precisa_texto, precisa_cadastro) of collected entries that need either."""
    text = source.select("nome_normalizado", F.col("status_extracao").alias("_s"))
    rows = catalog.where("status = 'CONCLUIDO'").join(text, "nome_normalizado", "left")
    again = F.lit(reprocess)
    need_text = again | F.col("_s").isNull()
    need_entry = again | ~is_filled(F.col("principios_ativos")) | ~is_filled(F.col("composicao"))
    return rows.select("nome_normalizado", need_text.alias("precisa_texto"), need_entry.alias("precisa_cadastro")).where("precisa_texto OR precisa_cadastro")


def pending_extractions(catalog: DataFrame, source: DataFrame, status: tuple[str, ...] = PENDING_EXTRACTION) -> DataFrame:
    """Collected entries whose extraction is missing or in one of the pending states."""
    rows = catalog.where("status = 'CONCLUIDO'").select("nome_normalizado").join(source.select("nome_normalizado", "status_extracao"), "nome_normalizado", "left")
    return rows.where(F.col("status_extracao").isNull() | F.col("status_extracao").isin(*status))


def pending_vectors(source: DataFrame, chunks: DataFrame) -> DataFrame:
    """Eligible sources without any chunk."""
    return eligible(source).join(chunks.select("nome_normalizado"), "nome_normalizado", "left_anti").select("nome_normalizado")


def unchanged_vectors(chunks: DataFrame, again: DataFrame) -> DataFrame:
    """Names whose stored chunk hashes are exactly those of the new chunking."""
    listed = lambda df, to: df.groupBy("nome_normalizado").agg(F.array_sort(F.collect_set(F.struct("chunk_index", "texto_hash"))).alias(to))
    return listed(chunks, "_a").join(listed(again, "_b"), "nome_normalizado").where(F.col("_a") == F.col("_b")).select("nome_normalizado")


def readiness(c: Corpus) -> DataFrame:
    """(nome_normalizado, cadastro_ok, extracao_ok, estado, cards_ok, pronto): whether an entry can be
    asked: collected, registered, extracted, and, if it has relations, with all cards of the current run."""
    current = c.current().select(F.col(ORIGIN).alias("nome_normalizado"), F.col("id").alias("processamento_id"), F.col("status").alias("estado"), is_filled(F.col("resumo_geral")).alias("_g"))
    cards = c.relations.groupBy("processamento_id").agg(F.bool_and(is_filled(F.col("resumo_card"))).alias("_c"))
    registered = registered_runs(c.runs, c.source).select(F.col(ORIGIN).alias("nome_normalizado"), F.col("status").alias("_r"))
    text = c.source.select("nome_normalizado", "status_extracao")
    rows = c.catalog.join(text, "nome_normalizado", "left").join(current, "nome_normalizado", "left").join(cards, "processamento_id", "left").join(registered, "nome_normalizado", "left")
    entry = F.coalesce(F.col("status") == "CONCLUIDO", F.lit(False)) & is_filled(F.col("principios_ativos")) & is_filled(F.col("composicao"))
    read = F.coalesce(F.col("status_extracao").isin("CONCLUIDO", "SEM_SECAO_INTERACOES"), F.lit(False))
    told = F.coalesce(F.col("_c") & F.col("_g"), F.lit(False))
    done = (F.col("status_extracao") == "SEM_SECAO_INTERACOES") | (F.col("estado") == "CONCLUIDO_SEM_RELACOES") | ((F.col("estado") == "CONCLUIDO_COM_RELACOES") & told)
    return rows.select("nome_normalizado", entry.alias("cadastro_ok"), read.alias("extracao_ok"), F.coalesce("estado", "_r").alias("estado"), told.alias("cards_ok"), (entry & read & F.coalesce(done, F.lit(False))).alias("pronto"))


def siblings(relations: DataFrame) -> DataFrame:
    """(id, irmaos): the cards of the relations of the same run, target and type, in order of id, as JSON.

    The group is aggregated once and joined back, so a group's list is built in one place."""
    group = ["processamento_id", "alvo", "tipo_alvo"]
    listed = relations.where(not_blank(F.col("resumo_card"))).groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "resumo_card")))).alias("irmaos"))
    return relations.select("id", *group).join(listed, group, "left").select("id", "irmaos")


def single_substance_synonyms(c: Corpus) -> DataFrame:
    """(id, sinonimos): the linked entries of a current relation that have exactly one ingredient."""
    single = c.catalog.where(F.size(list_of(F.col("principios_ativos"))) == 1).select(F.col("nome_normalizado").alias("medicamento_relacionado"))
    active = c.links.where(F.col("invalidado_em").isNull()).select(F.col("interacao_id").alias("id"), "medicamento_relacionado")
    rows = c.current_relations().select("id").join(active, "id").join(single, "medicamento_relacionado", "left_semi")
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("medicamento_relacionado")), "; ").alias("sinonimos"))


def relinked(c: Corpus, names: DataFrame) -> DataFrame:
    """(id, medicamento_relacionado, criterio_vinculo): all links of the current relations whose target
    has a key of one of the new or changed entries ``names``; no other relation is resolved again."""
    fresh = catalog_keys(c.catalog.join(names.select("nome_normalizado"), "nome_normalizado", "left_semi")).select(F.col("chave").alias("_k")).distinct()
    key = key_words(fold_target(F.col("alvo")))
    asked = c.current_relations().select("id", ORIGIN, "alvo", F.explode(F.array_distinct(F.array(key, without_salt(key)))).alias("_k"))
    hit = asked.join(fresh, "_k", "left_semi").select("id", ORIGIN, "alvo").distinct()
    return resolve(hit, c.catalog, "alvo", ORIGIN).select("id", "medicamento_relacionado", "criterio_vinculo")


def pending_summaries(c: Corpus, before: Column | None = None) -> DataFrame:
    """Origins whose current run with relations lacks a general summary or a card, or has one that was
    made before a time; a null time is never before."""
    run = c.current().where("status = 'CONCLUIDO_COM_RELACOES'").select(F.col("id").alias("processamento_id"), ORIGIN, "resumo_geral", "resumo_gerado_em")
    old = lambda x: F.coalesce(F.col(x) < before, F.lit(False)) if before is not None else F.lit(False)
    cards = c.relations.groupBy("processamento_id").agg(F.bool_or(~is_filled(F.col("resumo_card"))).alias("_sem"), F.bool_or(old("resumo_atualizado_em")).alias("_velho"))
    rows = run.join(cards, "processamento_id")
    missing = ~is_filled(F.col("resumo_geral")) | F.col("_sem")
    return rows.where(missing | old("resumo_gerado_em") | F.col("_velho")).select(ORIGIN, missing.alias("falta"))


def strict_current(runs: DataFrame, source: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Runs whose recorded identity of the source still is the source's: (run column, source column)
    pairs that must not be distinct."""
    own = source.select(F.col("nome_normalizado").alias(ORIGIN), *[F.col(s).alias(f"_{s}") for _, s in fields])
    same = F.lit(True)
    for r, s in fields:
        same = same & F.col(r).eqNullSafe(F.col(f"_{s}"))
    return runs.join(own, ORIGIN).where(same).select(*runs.columns)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, to the microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / 1_000_000


def parsed_time(text: Column) -> Column:
    """A time written in ISO form, as seconds or milliseconds since 1970, or day first; else null."""
    bare = F.trim(text)
    epoch = F.when(bare.rlike(r"^\d{13}$"), F.timestamp_millis(bare.try_cast("long"))).when(bare.rlike(r"^\d{10}$"), F.timestamp_seconds(bare.try_cast("long")))
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
    return F.coalesce(epoch, *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])
