"""Ingredients of a composition: which values carry a dose, which follow an excipient label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.functions.text import fold_target, without_accents
from marisma.operators.catalog import key_words, without_salt

# Doses, labels of excipients, water to volume, notes behind an ingredient.
DOSE = r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|ui|%)(?:/\w+)?(?=\W|$)"
EXCIPIENT_LABEL = r"\b(?:excipientes?|veiculos?|componentes inativos|outros componentes)\b"
NEW_PRESENTATION = r"^(?:cada\b|componente\s+\d+\s*:|composic(?:ao|oes)\b)"
TO_VOLUME = r"\bq\.?\s*s\.?\s*p\.?"
NOTE = r"\s*\((?:equivalente|corresponde|correspondente|na forma de)\b[^)]*\)?"


def ingredient_name(value: Column) -> Column:
    """Name before the dose, without notes and leaders; empty if nothing is left."""
    bare = F.regexp_replace(value, rf"(?i){NOTE}", "")
    name = F.regexp_replace(F.regexp_replace(bare, rf"(?i){DOSE}.*$", ""), r"(?:[.…·]\s*){3,}.*$", "")
    return F.regexp_replace(F.trim(name), r"^[\s•*-]+|[\s.,;:-]+$", "")


def classify(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``values`` in their order with (nome, dose, papel): ATIVO for a dosed value outside a labelled
    excipient block, EXCIPIENTE for values of such a block, values to volume and values without a
    dose, ROTULO for the label lines themselves.  A new presentation ends a block.

    The block is carried from value to value by a window over one composition, whose length bounds
    it.  Null values are left out.
    """
    rows = values.where(F.col(value).isNotNull())
    text = without_accents(F.col(value))
    label, fresh = text.rlike(EXCIPIENT_LABEL), text.rlike(NEW_PRESENTATION)
    state = F.when(label, True).when(fresh, False)
    block = F.coalesce(F.last(state, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    unnoted = F.regexp_replace(F.col(value), rf"(?i){NOTE}", "")
    dose = F.nullif(F.regexp_extract(unnoted, rf"(?i)({DOSE})", 1), F.lit(""))
    role = F.when(label | fresh, "ROTULO").when(block | text.rlike(TO_VOLUME) | dose.isNull(), "EXCIPIENTE").otherwise("ATIVO")
    return rows.select(key, order, value, ingredient_name(F.col(value)).alias("nome"), dose.alias("dose"), role.alias("papel"))


def active_ingredients(classified: DataFrame, key: str, order: str) -> DataFrame:
    """(key, principios_ativos): different active names in order of appearance, "a; b; c"."""
    active = classified.where("papel = 'ATIVO' AND nome <> ''")
    first = active.groupBy(key, fold_target(F.col("nome")).alias("_f")).agg(F.min_by(F.struct(order, "nome"), order).alias("_n"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_n")), lambda x: x["nome"]), "; ").alias("principios_ativos"))


def unnamed_actives(classified: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Active values whose salt-free key is among none of the (key, name) of the registry."""
    folded = lambda c: without_salt(key_words(fold_target(F.regexp_replace(F.col(c), rf"(?i){NOTE}", ""))))
    known = names.where(F.col(name).isNotNull()).select(key, folded(name).alias("_k")).distinct()
    return classified.where("papel = 'ATIVO'").withColumn("_k", folded("nome")).join(known, [key, "_k"], "left_anti").drop("_k")


def resolved_name(name: Column, candidates: Column) -> Column:
    """A name as a candidate spells it: equal without accents and case, or the only candidate that has it
    as whole words; a dose behind it is left out for that.  Else the name itself, nothing is invented."""
    bare = lambda x: without_accents(F.trim(F.regexp_replace(x, r"\s+", " ")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), rf"(?i){NOTE}", ""), rf"(?i){DOSE}.*$", ""), r"^[\s*:;.]+|[\s*:;.(]+$", "")
    key = bare(plain)
    equal = F.filter(candidates, lambda c: bare(c) == key)
    whole = F.filter(candidates, lambda c: F.concat(F.lit(" "), bare(c), F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" "))))
    return F.when(F.size(equal) > 0, F.get(equal, F.lit(0))).when((F.size(whole) == 1) & (F.length(key) >= 3), F.get(whole, F.lit(0))).otherwise(plain)


def names_missing(values: DataFrame, key: str, text: str, candidates: DataFrame, name: str) -> DataFrame:
    """(key, faltam): whether a composition has lines of letters that are no label, dose, excipient and
    name no candidate, so that names beyond the candidates may be looked for."""
    known = candidates.groupBy(key).agg(F.collect_set(without_accents(F.col(name))).alias("_c"))
    rows = values.where(F.col(text).isNotNull()).join(known, key, "left").withColumn("_t", without_accents(F.col(text)))
    skipped = F.col("_t").rlike(r"^cada\b.*\bcontem\s*:?\s*$|^(?:componente|principios? ativos?|\W*equivalente)\b|\b(?:q\.?\s*s\.?\s*p\.?|excipiente|conservante|veiculo)\b") | ~F.col("_t").rlike("[a-z]{3}")
    named = F.coalesce(F.exists("_c", lambda c: F.col("_t").contains(c)), F.lit(False))
    return rows.groupBy(key).agg(F.bool_or(~skipped & ~named).alias("faltam"))


def identified_actives(identity: DataFrame, classified: DataFrame, key: str, name: str) -> DataFrame:
    """(key, nome) of the generic names before a composition that stand in one of its dosed lines."""
    asked = identity.where(F.col(name).isNotNull() & F.length(name).between(3, 120) & ~F.col(name).rlike(rf"(?i){DOSE}|[®™]")).select(key, F.col(name).alias("_n"))
    dosed = classified.where("papel = 'ATIVO'").select(key, F.concat(F.lit(" "), key_words(fold_target(F.col("nome"))), F.lit(" ")).alias("_l"))
    met = asked.join(dosed, key).where(F.col("_l").contains(F.concat(F.lit(" "), key_words(fold_target(F.col("_n"))), F.lit(" "))))
    return met.select(key, F.col("_n").alias("nome")).distinct()
