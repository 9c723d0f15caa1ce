"""What stands around an answer: messages, components, groups, summaries shown, and coherence."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.text import fold_name, is_filled, list_of, not_blank, quotation_key
from marisma.operators.answers import ORIGIN, Corpus, coverage, pair_evidence, pair_rows, pair_verdicts, single_answers, suggest, suggest_fuzzy

# Words that stay in lower case inside a shown name.
SMALL_WORDS = ("de", "da", "do", "das", "dos", "e", "com", "em", "a", "o")


class InvalidRequest(ValueError):
    """A question that breaks the rules of its arguments."""


class UnknownEntry(LookupError):
    """A question about a name that the catalogue does not have."""


def checked_name(name: str) -> str:
    """An identifier: not blank, at most 200 characters, already in its normal form."""
    if not name or len(name) > 200 or name != " ".join(name.lower().split()):
        raise InvalidRequest("name must be normalised and have at most 200 characters")
    return name


def checked_page(page: int, size: int) -> tuple[int, int]:
    if not 1 <= page <= 10_000 or not 1 <= size <= 100:
        raise InvalidRequest("1 <= page <= 10000 and 1 <= size <= 100")
    return page, size


def known_entry(c: Corpus, name: str) -> str:
    if c.catalog.where(F.col("nome_normalizado") == checked_name(name)).isEmpty():
        raise UnknownEntry(name)
    return name


def coverage_message(c: Corpus) -> DataFrame:
    """Coverage with its sentence."""
    rows = coverage(c)
    message = (
        F.when(F.col("elegiveis") == 0, "Nenhum texto disponível para análise.")
        .when(F.col("lista_exaustiva"), "Todos os textos disponíveis foram analisados.")
        .when(F.col("corpus_completo"), "Todos os textos foram analisados; parte aguarda revisão.")
        .otherwise(F.format_string("%d de %d textos analisados.", "analisadas", "elegiveis"))
    )
    return rows.withColumn("mensagem", message)


def single_messages(c: Corpus) -> DataFrame:
    """Verdict of every entry with its sentence."""
    rows = single_answers(c)
    message = (
        F.when(F.col("identificada"), F.format_string("%d interações com %d alvos.", "relacoes", "alvos"))
        .when(~F.col("identificada"), "Nenhuma interação identificada no texto.")
        .otherwise("Sem conclusão: a análise do texto não terminou.")
    )
    return rows.withColumn("mensagem", message)


def verdict_counters(c: Corpus, pairs: DataFrame) -> DataFrame:
    """One row: how many pairs have each of the three verdicts."""
    v = F.col("identificada")
    return pair_verdicts(c, pairs).agg(F.count_if(v).alias("sim"), F.count_if(~v).alias("nao"), F.count_if(v.isNull()).alias("sem_conclusao"))


def selection_pairs(selection: DataFrame, order: str, name: str) -> DataFrame:
    """Unordered pairs (a, b) of a selection, each name once at its first place; a asker chooses few."""
    once = selection.groupBy(F.col(name).alias("n")).agg(F.min(order).alias("p"))
    left, right = once.select(F.col("n").alias("x"), F.col("p").alias("i")), once.select(F.col("n").alias("y"), F.col("p").alias("j"))
    return left.join(right, F.col("i") < F.col("j")).select("i", "j", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def readable_name(name: Column) -> Column:
    """A name in capitals or small letters throughout as words with an initial capital; small words stay
    small, short acronyms of names in capitals stay as they are."""
    letters = F.regexp_replace(name, r"[^A-Za-zÀ-ÖØ-öø-ÿ]", "")
    upper, lower = letters == F.upper(letters), letters == F.lower(letters)
    word = lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).when(upper & (F.length(w) <= 3), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when(upper | lower, F.array_join(F.transform(F.split(name, r"\s+"), word), " ")).otherwise(name)


def component_explanation(c: Corpus, pairs: DataFrame) -> DataFrame:
    """(a, b, sentido, componentes, citados, nao_citados, parcial) of each linked direction: which
    ingredients of the linked entry the relations name by equal text."""
    rows = pair_rows(c, pairs).where(F.col("especie") == "ESPECIFICA").withColumn("outro", F.when(F.col("sentido") == "BULA_A_CITA_B", F.col("b")).otherwise(F.col("a")))
    said = rows.groupBy("a", "b", "sentido", "outro").agg(F.collect_set(fold_name(F.col("alvo"))).alias("_ditos"))
    parts = c.catalog.select(F.col("nome_normalizado").alias("outro"), list_of(F.col("principios_ativos")).alias("_p"))
    met = said.join(parts, "outro")
    cited = F.filter("_p", lambda p: F.array_contains("_ditos", fold_name(p)))
    missing = F.when(F.size(cited) > 0, F.array_except("_p", cited)).otherwise(F.array().cast("array<string>"))
    return met.select("a", "b", "sentido", F.size("_p").alias("componentes"), F.array_join(cited, "; ").alias("citados"), F.array_join(missing, "; ").alias("nao_citados"), ((F.size("_p") > 1) & (F.size(missing) > 0)).alias("parcial"))


def target_groups(c: Corpus, links_total: DataFrame) -> DataFrame:
    """Relations of an origin grouped by folded target: first name, different quotations and summaries,
    related entries seen, and the greater of the reported and the seen number of them."""
    run = c.current().select(F.col("id").alias("processamento_id"))
    rows = c.relations.join(run, "processamento_id", "left_semi").select("id", ORIGIN, fold_name(F.col("alvo")).alias("alvo_normal"), "alvo", quotation_key(F.col("evidencia")).alias("_q"), F.trim("resumo").alias("_r"))
    active = c.links.where(F.col("invalidado_em").isNull()).select(F.col("interacao_id").alias("id"), "medicamento_relacionado")
    groups = rows.groupBy(ORIGIN, "alvo_normal").agg(F.min_by("alvo", "id").alias("alvo"), F.count_distinct("_q").alias("citacoes"), F.count_distinct("_r").alias("resumos"))
    seen = rows.join(active, "id").groupBy(ORIGIN, "alvo_normal").agg(F.count_distinct("medicamento_relacionado").alias("_v"))
    told = rows.join(links_total, "id").groupBy(ORIGIN, "alvo_normal").agg(F.max("total").alias("_t"))
    out = groups.join(seen, [ORIGIN, "alvo_normal"], "left").join(told, [ORIGIN, "alvo_normal"], "left")
    return out.select(ORIGIN, "alvo_normal", "alvo", "citacoes", "resumos", F.greatest(F.coalesce("_v", F.lit(0)), F.coalesce("_t", F.lit(0))).alias("relacionados"))


def evidence_objects(c: Corpus, pairs: DataFrame) -> DataFrame:
    """Evidence groups of each pair with their items as ordered JSON objects."""
    rows = pair_rows(c, pairs)
    group = ["a", "b", "especie", "sentido", ORIGIN, "processamento_id", "_q"]
    item = [fold_name(F.col("alvo")).alias("_a"), "tipo_alvo", quotation_key(F.col("resumo")).alias("_r"), "criterio_vinculo"]
    first = rows.groupBy(*group, *item).agg(F.min(F.struct("id", "alvo", "resumo")).alias("_i"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_i.id").alias("id"), F.col("_i.alvo").alias("alvo"), "tipo_alvo")))
    return first.groupBy(*group).agg(F.to_json(listed).alias("itens")).drop("_q")


def shown_summaries(c: Corpus) -> DataFrame:
    """(medicamento_origem, processamento_id, resumo, simples): the general summary of each current run,
    if it is not blank; the plain text only while it is published and not invalidated."""
    get = lambda path: F.get_json_object("reescrita_controle", path)
    valid = (get("$.publicado.status") == "CONCLUIDO") & ~F.coalesce(get("$.entrada_invalidada") == "true", F.lit(False)) & is_filled(F.col("resumo_geral_simples"))
    rows = c.current().where(is_filled(F.col("resumo_geral")))
    return rows.select(ORIGIN, F.col("id").alias("processamento_id"), F.col("resumo_geral").alias("resumo"), F.when(F.coalesce(valid, F.lit(False)), F.col("resumo_geral_simples")).alias("simples"))


def snapshot(relations: DataFrame, runs: DataFrame) -> DataFrame:
    """(processamento_id, relacoes, completo, identidade): completeness of each run's summaries and the
    hash of its ordered relations, to be compared before and after a generation."""
    item = F.struct("id", F.sha2(F.concat_ws("\x1f", F.col("id").cast("string"), "alvo", "tipo_alvo", "evidencia"), 256).alias("h"))
    rows = relations.groupBy("processamento_id").agg(
        F.count("*").alias("relacoes"), F.bool_and(is_filled(F.col("resumo_card"))).alias("_c"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["h"]), ""), 256).alias("identidade")
    )
    general = runs.select(F.col("id").alias("processamento_id"), is_filled(F.col("resumo_geral")).alias("_g"))
    return rows.join(general, "processamento_id").select("processamento_id", "relacoes", (F.col("_c") & F.col("_g")).alias("completo"), "identidade")


def source_coherence(source: DataFrame, claimed: DataFrame) -> DataFrame:
    """(nome_normalizado, coerente): whether the text still has the hash its reader saw."""
    seen = claimed.select("nome_normalizado", F.col("hash_texto").alias("_h"))
    return source.join(seen, "nome_normalizado").select("nome_normalizado", F.coalesce(F.sha2("trecho_interacoes", 256) == F.col("_h"), F.lit(False)).alias("coerente"))


def busy_entries(locks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose processing key, a number from the hash of the name, is among the locks held."""
    key = F.conv(F.substring(F.sha2("nome_normalizado", 256), 1, 15), 16, 10).cast("long")
    return catalog.select("nome_normalizado", key.alias("chave")).join(locks.select("chave").distinct(), "chave").select("nome_normalizado")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks; null if one is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def suggestions(c: Corpus, term: str, limit: int = 6) -> DataFrame:
    """Literal suggestions, or else the fuzzy ones with their ratio as second key."""
    literal = suggest(c, term, limit)
    if len(term) < 4 or not literal.isEmpty():
        return literal.select("nome_normalizado", F.lit("LITERAL").alias("tipo"))
    near = suggest_fuzzy(c, term, 10 * limit).withColumn("_r", sequence_ratio(F.lit(term), F.col("nome_normalizado")))
    return near.orderBy("distancia", F.desc("_r"), "palavras", "nome_normalizado").limit(limit).select("nome_normalizado", F.lit("APROXIMADA").alias("tipo"))


def evidence_count(c: Corpus, pairs: DataFrame) -> DataFrame:
    """Evidence groups of each pair by kind."""
    return pair_evidence(c, pairs).groupBy("a", "b", "especie").agg(F.count("*").alias("grupos"))


def pair_answer(c: Corpus, one: str, other: str) -> DataFrame:
    """The verdict of one pair; both names must be known and different."""
    names = sorted({known_entry(c, one), known_entry(c, other)})
    if len(names) < 2:
        raise InvalidRequest("two different names")
    pair = c.catalog.sparkSession.createDataFrame([tuple(names)], "a string, b string")
    return pair_verdicts(c, pair)


def input_documents(relations: DataFrame) -> DataFrame:
    """(processamento_id, alvo, tipo_alvo, entrada): the JSON document a card is rewritten from, with the
    evidences of its group in order of id."""
    rows = relations.where(not_blank(F.col("resumo_card")))
    proof = F.array_sort(F.collect_list(F.struct("id", "alvo", F.col("evidencia").alias("texto"))))
    texts = F.array_sort(F.collect_list(F.struct("id", F.trim("resumo_card").alias("texto"))))
    grouped = rows.groupBy("processamento_id", "alvo", "tipo_alvo").agg(F.min_by(ORIGIN, "id").alias("origem"), F.min("id").alias("id"), proof.alias("evidencias"), texts.alias("_t"))
    original = F.array_join(F.array_distinct(F.transform("_t", lambda t: t["texto"])), "\n")
    document = F.to_json(F.struct(F.lit("card").alias("tipo"), "origem", "processamento_id", "id", "alvo", "tipo_alvo", original.alias("resumo_original"), "evidencias"))
    return grouped.select("processamento_id", "alvo", "tipo_alvo", document.alias("entrada"))
