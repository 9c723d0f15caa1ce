"""Verdicts on produced relations: one reason per row, null where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.functions.rules import clauses_about, contains_term, fidelity_flags, is_not_positive
from marisma.functions.text import fold_name, fold_target, list_of, plain_words, relevant_words
from marisma.functions.vocabulary import GENERIC_HEADS
from marisma.operators.catalog import key_words

MAX_TARGET, MAX_SUMMARY = 150, 300


def is_generic(target: Column, kind: Column) -> Column:
    """A target that begins with a generic head; laboratory examinations are named that way."""
    words = plain_words(fold_target(target))
    return (F.size(words) > 0) & F.coalesce(F.get(words, F.lit(0)).isin(*GENERIC_HEADS), F.lit(False)) & ~F.coalesce(kind == "EXAME_LABORATORIAL", F.lit(False))


def is_mentioned(evidence: Column, target: Column) -> Column:
    """The target stands in the evidence whole, or with all its relevant words."""
    text, name = fold_name(evidence), fold_target(target)
    words = relevant_words(name)
    return contains_term(text, name) | ((F.size(words) > 0) & F.forall(words, lambda w: contains_term(text, w)))


def target_verdicts(relations: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, motivo): the first reason that holds, in this order: ALVO_INVALIDO, ALVO_E_ORIGEM,
    ALVO_GENERICO, EVIDENCIA_NAO_ENCONTRADA, ALVO_AUSENTE_NA_EVIDENCIA, RELACAO_NAO_POSITIVA, and
    what the summary adds or loses.  Null texts count as blank."""
    own = F.transform(F.concat(F.array("nome_normalizado", F.coalesce("nome_anvisa", F.lit(""))), list_of(F.col("principios_ativos"))), lambda x: plain_words(fold_target(x)))
    names = catalog.select(F.col("nome_normalizado").alias("medicamento_origem"), F.filter(own, lambda s: F.size(s) > 0).alias("_nomes"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = relations.select("id", "medicamento_origem", text("alvo").alias("alvo"), "tipo_alvo", text("resumo").alias("resumo"), text("evidencia").alias("evidencia")).join(names, "medicamento_origem", "left")
    alvo, evidencia, resumo = F.col("alvo"), F.col("evidencia"), F.trim("resumo")
    words = F.split(key_words(fold_target(alvo)), " ")
    self_named = F.coalesce(F.exists("_nomes", lambda n: F.size(F.array_except(words, n)) == 0), F.lit(False))
    invalid = ~alvo.rlike(r"\pL") | (F.length(alvo) > MAX_TARGET) | (resumo == "") | (F.length(resumo) > MAX_SUMMARY)
    rows = rows.withColumn("_f", fidelity_flags(F.col("resumo"), evidencia, F.array_join(clauses_about(fold_name(evidencia), fold_target(alvo)), " ")))
    reason = (
        F.when(invalid, "ALVO_INVALIDO")
        .when(self_named, "ALVO_E_ORIGEM")
        .when(is_generic(alvo, F.col("tipo_alvo")), "ALVO_GENERICO")
        .when(F.trim(evidencia) == "", "EVIDENCIA_NAO_ENCONTRADA")
        .when(~is_mentioned(evidencia, alvo), "ALVO_AUSENTE_NA_EVIDENCIA")
        .when(is_not_positive(evidencia, alvo), "RELACAO_NAO_POSITIVA")
        .when(F.col("_f.negacao_perdida"), "RESUMO_OMITE_NEGACAO")
        .when(F.col("_f.quantidade_perdida") | F.col("_f.condicao_perdida"), "RESUMO_OMITE_QUANTIDADE")
        .when(F.col("_f.via_perdida"), "RESUMO_OMITE_VIA")
        .when(F.col("_f.gravidade_inventada"), "RESUMO_INVENTA_GRAVIDADE")
        .when(F.col("_f.direcao_inventada"), "RESUMO_INVENTA_EFEITO")
        .when(F.col("_f.pouco_apoio"), "RESUMO_SEM_APOIO_NA_EVIDENCIA")
    )
    return rows.select("id", reason.alias("motivo"))


def unresolved(rejected: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rejections (alvo, tipo_alvo, evidencia) that no accepted relation settles."""
    key = lambda df: df.withColumn("_k", F.sha2(F.concat_ws("\x1f", fold_target(F.col("alvo")), "tipo_alvo", fold_name(F.col("evidencia"))), 256))
    return key(rejected).join(key(accepted).select("_k"), "_k", "left_anti").drop("_k")


def grounding_flags(summary: Column, evidence: Column) -> Column:
    """struct of what a summary claims without its evidence: absence, safety, certainty; and a nasal route
    of the evidence that it leaves out."""
    s, e = fold_name(summary), fold_name(evidence)
    only = lambda p: s.rlike(p) & ~e.rlike(p)
    return F.struct(
        only(r"\bnao (?:ha|existe\w*|foram?) (?:\w+ )?(?:interac|estudos|relatos|dados)|\bdesconhec\w+").alias("ausencia"),
        only(r"\bsegur[oa]s?\b|\bsem risco\b|\bpode ser usad[oa] sem\b").alias("seguranca"),
        (e.rlike(r"\bpodem?\b") & ~s.rlike(r"\bpodem?\b|\bpossivel\b|\bpossibilidade\b|\bcostuma\b|\btende\b")).alias("certeza"),
        (e.rlike(r"\bnasal\b") & ~s.rlike(r"\bnasal\b")).alias("via_nasal"),
    )


def unit_context(units: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Units with their neighbours and the last title (a short line of capitals or with a number and
    no final mark) before them."""
    w = Window.partitionBy(key).orderBy(order)
    letters = F.regexp_replace(F.col(text), r"[^\pL]", "")
    title = (F.length(text) <= 110) & ~F.col(text).rlike(r"[.;,:]$") & (((F.length(letters) >= 4) & (F.upper(letters) == letters)) | F.col(text).rlike(r"^\d{1,2}(?:\.\d{1,2})*[.)]?\s+\S"))
    return units.select(
        key, order, text, F.lag(text).over(w).alias("anterior"), F.lead(text).over(w).alias("seguinte"),
        F.last(F.when(title, F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("titulo"),
    )
