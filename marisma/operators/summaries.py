"""Short texts of relations: where each comes from, groups that share one, validity and checks."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.rules import clauses_about
from marisma.functions.text import fold_name, fold_target, not_blank
from marisma.functions.vocabulary import DECREASE, INCREASE

LITERAL_CHARS, LITERAL_COMMAS = 400, 4
CARD_LENGTH, GENERAL_LENGTH = (40, 600), (60, 1200)


def effect_key(evidence: Column, target: Column) -> Column:
    """Identity of an effect: the evidence, its clauses about the target and the last direction
    named before the target in them."""
    text, name = fold_name(evidence), fold_target(target)
    own = F.array_join(clauses_about(text, name), " ")
    before = F.when(F.instr(own, name) > 1, F.substring(own, F.lit(1), F.instr(own, name) - 1)).otherwise(F.lit(""))
    found = F.regexp_extract_all(before, F.lit(f"({INCREASE}|{DECREASE})"), F.lit(0))
    last = F.when(F.size(found) > 0, F.when(F.element_at(found, -1).rlike(INCREASE), "AUMENTO").otherwise("REDUCAO")).otherwise("")
    return F.sha2(F.concat_ws("\x1f", evidence, own, last), 256)


def card_origins(relations: DataFrame) -> DataFrame:
    """(id, origem): LITERAL if the evidence is short, no list and its clause is about this relation
    alone; REAPROVEITADO if another relation of the same run and effect has a card; else GERADO.

    Counts and flags are aggregates joined back on digests, so no window holds a hot evidence.
    """
    rows = relations.where(F.col("evidencia").isNotNull() & F.col("alvo").isNotNull())
    own = F.array_join(clauses_about(fold_name(F.col("evidencia")), fold_target(F.col("alvo"))), "\x1f")
    rows = rows.select("id", "processamento_id", "evidencia", not_blank(F.col("resumo_card")).alias("_card"), F.sha2(F.concat_ws("\x1f", "evidencia", own), 256).alias("_o"), effect_key(F.col("evidencia"), F.col("alvo")).alias("_e"))
    shared = rows.groupBy("processamento_id", "_o").agg(F.count("*").alias("_n"))
    carded = rows.groupBy("processamento_id", "_e").agg(F.count_if("_card").alias("_k"), F.count("*").alias("_g"))
    short = (F.length("evidencia") <= LITERAL_CHARS) & (F.length("evidencia") - F.length(F.replace("evidencia", F.lit(","), F.lit(""))) < LITERAL_COMMAS)
    rows = rows.join(shared, ["processamento_id", "_o"]).join(carded, ["processamento_id", "_e"])
    origin = F.when(short & (F.col("_n") == 1), "LITERAL").when((F.col("_g") > 1) & (F.col("_k") - F.col("_card").cast("int") > 0), "REAPROVEITADO").otherwise("GERADO")
    return rows.select("id", origin.alias("origem"))


def merged_lines(relations: DataFrame) -> DataFrame:
    """(processamento_id, molde, alvos, linha): summaries of a run that differ only by their target,
    said once with all names in order of appearance ("a, b e c")."""
    text, name = F.trim("resumo"), F.col("alvo")
    quoted = F.concat(F.lit(r"(?iu)(?<![\pL\pN])\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\pL\pN])"))
    once = F.size(F.regexp_extract_all(text, quoted, F.lit(0))) == 1
    mold = F.when(once, F.regexp_replace(text, quoted, F.lit("{alvo}"))).otherwise(text)
    rows = relations.where(F.col("resumo").isNotNull() & F.col("alvo").isNotNull() & (F.trim("alvo") != "")).select("processamento_id", mold.alias("molde"), "alvo", "id")
    first = rows.groupBy("processamento_id", "molde", "alvo").agg(F.min("id").alias("id"))
    grouped = first.groupBy("processamento_id", "molde").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "alvo"))), lambda x: x["alvo"]).alias("_a"))
    names = F.when(F.size("_a") == 1, F.element_at("_a", 1)).otherwise(F.concat(F.array_join(F.slice("_a", 1, F.greatest(F.size("_a") - 1, F.lit(1))), ", "), F.lit(" e "), F.element_at("_a", -1)))
    line = F.replace("molde", F.lit("{alvo}"), names)
    return grouped.select("processamento_id", "molde", F.size("_a").alias("alvos"), F.concat(F.upper(F.substring(line, 1, 1)), line.substr(F.lit(2), F.length(line))).alias("linha"))


def effect_paragraph(line: Column) -> Column:
    """1 increase, 2 decrease, 3 both or neither."""
    up, down = fold_name(line).rlike(INCREASE), fold_name(line).rlike(DECREASE)
    return F.when(up & ~down, 1).when(down & ~up, 2).otherwise(3)


def rewrite_units(relations: DataFrame) -> DataFrame:
    """(processamento_id, alvo, tipo_alvo, lider, registros, pendentes): relations with a card that
    are rewritten together; the smallest id leads."""
    rows = relations.where(not_blank(F.col("resumo_card")))
    pending = F.coalesce(F.get_json_object("reescrita_controle", "$.publicado.status") != "CONCLUIDO", F.lit(True)) | ~F.coalesce(not_blank(F.col("resumo_card_simples")), F.lit(False))
    return rows.groupBy("processamento_id", "alvo", "tipo_alvo").agg(F.min("id").alias("lider"), F.count("*").alias("registros"), F.count_if(pending).alias("pendentes"))


def consolidated(mentions: DataFrame, key: list[str], start: str, end: str, text: str) -> DataFrame:
    """Mentions of each key without those that repeat another's text or lie inside another's span;
    the widest and, among equals, the first is kept."""
    folded = mentions.withColumn("_t", F.sha2(fold_name(F.col(text)), 256))
    same = Window.partitionBy(*key, "_t").orderBy(F.desc(F.col(end) - F.col(start)), start)
    once = folded.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    wide = Window.partitionBy(*key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    kept = once.withColumn("_m", F.max(end).over(wide)).where(F.col("_m").isNull() | (F.col(end) > F.col("_m")))
    return kept.select(*mentions.columns)


def response_flags(text: Column, length: tuple[int, int] = CARD_LENGTH) -> Column:
    """struct of what makes a produced text unacceptable."""
    words = F.regexp_extract_all(fold_name(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 3), lambda i: F.array_join(F.slice(words, i, 4), " "))).otherwise(F.array())
    return F.struct(
        (~F.length(F.trim(text)).between(*length)).alias("tamanho"),
        text.rlike(r"(?m)^\s*(?:[-*•]|\d+[.)])\s").alias("lista"),
        text.rlike(r"(?i)^\s*[\[{]").alias("json"),
        (F.size(grams) - F.size(F.array_distinct(grams)) >= 2).alias("repeticao"),
        (~F.trim(text).rlike(r"[.!?)…]$")).alias("sem_fim"),
    )


def names_every_paragraph(text: Column, name: Column) -> Column:
    """Whether every paragraph names the entity."""
    return F.forall(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""), lambda p: fold_name(p).contains(fold_name(name)))


@F.pandas_udf(T.StringType())
def canonical_hash(values: pd.Series) -> pd.Series:
    """SHA-256 of a JSON document with sorted keys and no blanks; null for null or broken JSON."""

    def one(text: str | None) -> str | None:
        try:
            data = json.loads(text)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return values.map(one)


@F.pandas_udf(T.StringType())
def json_merge(old: pd.Series, new: pd.Series) -> pd.Series:
    """Top-level merge of two JSON objects, the new one winning; ``entrada_invalidada`` is dropped."""

    def one(a: str | None, b: str | None) -> str:
        merged = {**(json.loads(a) if a else {}), **(json.loads(b) if b else {})}
        merged.pop("entrada_invalidada", None)
        return json.dumps(merged, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return pd.Series([one(a, b) for a, b in zip(old, new)], index=old.index)


def plain_is_current(text: Column, control: Column, entry_hash: Column) -> Column:
    """Whether a plain text is still valid: published, not invalidated, for this very input."""
    get = lambda path: F.get_json_object(control, path)
    stale = F.coalesce(get("$.entrada_invalidada") == "true", F.lit(False))
    published = F.coalesce(get("$.publicado.status") == "CONCLUIDO", F.lit(False))
    same = F.coalesce(get("$.publicado.entrada_hash").isNull() | (get("$.publicado.entrada_hash") == entry_hash), F.lit(False))
    return F.coalesce(not_blank(text), F.lit(False)) & published & ~stale & same
