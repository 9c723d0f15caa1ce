"""Registered queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm import canonical, confusables, duplicates, leakage, neighbours, packing, scans, subjects, truncation
from marisma.session import table


def _typed_fields(spark: SparkSession, d: str) -> DataFrame:
    alvo = table(spark, d, "interacoes").select(F.lit("alvo").alias("campo"), F.col("id").alias("interacao_id"), F.col("alvo").alias("valor"))
    other = table(spark, d, "interacoes_medicamentos").select(F.lit("medicamento_relacionado").alias("campo"), "interacao_id", F.col("medicamento_relacionado").alias("valor"))
    return alvo.unionByName(other)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_fields(_typed_fields(spark, d), table(spark, d, "termos_referencia")).drop("score")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no entry, with the number of their rows."""
    found = canonical.map_fields(_typed_fields(spark, d), table(spark, d, "termos_referencia"))
    return found.where("termo_id = 0").groupBy("campo", "valor").agg(F.count("*").alias("linhas"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.defects(table(spark, d, "interacoes"), "id", ["alvo", "evidencia"]).select("id", "campo").distinct()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Originals of equal skeleton, for each of the two fields."""
    rows = table(spark, d, "interacoes")
    alvo, evidence = (confusables.skeleton_groups(rows, f).select(F.lit(f).alias("campo"), "*") for f in ("alvo", "evidencia"))
    return alvo.unionByName(evidence)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(table(spark, d, "interacoes"), "id", "evidencia")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.collapsed(table(spark, d, "interacoes"), "id", "evidencia")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    card = table(spark, d, "interacoes").select(F.lit("interacoes").alias("tabela"), "id", F.col("resumo_card_simples").alias("texto"), "resumo_modelo")
    general = table(spark, d, "processamentos_interacoes").select(F.lit("processamentos_interacoes").alias("tabela"), "id", F.col("resumo_geral").alias("texto"), "resumo_modelo")
    return card.unionByName(general)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_summaries(spark, d).drop("resumo_modelo"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_summaries(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "bulas_interacoes_embeddings"), "id", "embedding")


def _scan_texts(spark: SparkSession, d: str) -> DataFrame:
    section = table(spark, d, "bulas_interacoes").select(F.lit("bulas_interacoes").alias("tabela"), F.col("nome_normalizado").alias("chave"), F.col("trecho_interacoes").alias("texto"))
    evidence = table(spark, d, "interacoes").select(F.lit("interacoes").alias("tabela"), F.col("id").cast("string").alias("chave"), F.col("evidencia").alias("texto"))
    return section.unionByName(evidence)


def _scans(spark: SparkSession, d: str) -> scans.Repair:
    """The repair of both text columns; the catalogue's and the reference list's names are known words."""
    names = table(spark, d, "bulas").select(F.col("nome_normalizado").alias("nome"))
    terms = table(spark, d, "termos_referencia").select(F.col("termo").alias("nome"))
    known = names.unionByName(terms).select(F.explode(F.regexp_extract_all(F.lower("nome"), F.lit(r"[\pL\pN]+"), F.lit(0))).alias("palavra"))
    return scans.Repair(_scan_texts(spark, d), known)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).damage()


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return packing.pieces(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_items(spark, d)).withColumnRenamed("id", "doc_id")


def p8_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The optimal length buckets, and last, under limit 0, what the containers leave unused."""
    counts = packing.histogram(_items(spark, d))
    rows = packing.bucket_report(counts, packing.length_buckets(counts))
    used, _ = packing.fill_plan(counts)
    tokens = sum(s * c for s, c in counts.items())
    rows.append((0, sum(counts.values()), tokens, used, 1 - tokens / max(1, used * packing.CAPACITY)))
    return spark.createDataFrame(rows, "limite int, itens long, tokens long, recipientes long, sem_uso double")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "itens_avaliacao"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a copied or edited passage of an item, by the score of its alignment."""
    return leakage.edited_leaks(table(spark, d, "documents"), table(spark, d, "itens_avaliacao"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item that leaked, copied or edited, with its affected documents and best alignment."""
    found = p9_leaks(spark, d)
    return found.groupBy("item_id").agg(
        F.count("*").alias("documentos"), F.count_if(F.col("corrida") >= leakage.RUN).alias("literais"), F.max("corrida").alias("maior_corrida"), F.max("alinhamento").alias("maior_alinhamento")
    )


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "rotulos_areas"), table(spark, d, "areas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "area")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_groups, p3_found, p3_collapsed, p5_found, p5_rates, p6_found, p7_found, p7_repaired, p8_containers, p8_buckets, p9_found, p9_leaks, p9_items, p10_found, p10_composition)}


# The kinds of characters that TESTDATA.md names, written out: full-width forms and ligatures, combining
# marks, invisible characters, spaces other than U+0020, and a letter of another alphabet beside a Latin one.
_WIDE = r"\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{FB00}-\x{FB06}"
_INVISIBLE = r"\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}"
_BLANK = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_OTHER = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Georgian}\p{Coptic}]"
_P2 = rf"[{_WIDE}{_INVISIBLE}{_BLANK}\p{{M}}]|\p{{Latin}}{_OTHER}|{_OTHER}\p{{Latin}}"


def _sql_value(x: str) -> str:
    marked = x
    for sign, mark in (",", 57345), ("[.]", 57346):
        for _ in range(2):  # digits between two signs belong to both
            marked = rf"regexp_replace({marked}, '(\p{{N}}){sign}(\p{{N}})', '\1' || chr({mark}) || '\2', 'g')"
    return rf"regexp_replace({marked}, '[^\p{{L}}\p{{N}}\x{{e001}}\x{{e002}}]+', '', 'g')"


_P3_FIELDS = rf"""WITH t AS (SELECT id, lower(evidencia) AS e, string_split(regexp_replace(lower(evidencia), '(^|[^\p{{L}}\p{{N}}])({"|".join(duplicates.LABELS)})\s*[:\x{{ff1a}}]', '\1' || chr(57344) || '\2' || chr(57347), 'g'), chr(57344)) AS p
    FROM interacoes WHERE evidencia IS NOT NULL),
  k AS (SELECT id, CASE WHEN len(p) > 2 THEN list_sort(list_filter(list_transform(p, lambda x: CASE WHEN contains(x, chr(57347)) THEN split_part(x, chr(57347), 1) || ':' || {_sql_value("split_part(x, chr(57347), 2)")} ELSE {_sql_value("x")} END), lambda x: x <> ''))
    ELSE list_filter([{_sql_value("e")}], lambda x: x <> '') END AS campos FROM t)"""
_P3 = f"{_P3_FIELDS}, g AS (SELECT id, min(id) OVER (PARTITION BY campos) AS id_mantido FROM k WHERE len(campos) > 0) SELECT id_mantido, id AS id_copia FROM g WHERE id <> id_mantido"
_P3_COLLAPSED = f"{_P3_FIELDS} SELECT min(id) AS id_mantido, count(DISTINCT id) - 1 AS copias FROM k WHERE len(campos) > 0 GROUP BY campos"

_P6 = """WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM bulas_interacoes_embeddings
    WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n AS (SELECT a.id, b.id AS vizinho, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS k FROM v a JOIN v b ON a.id <> b.id)
SELECT DISTINCT least(id, vizinho) AS id_a, greatest(id, vizinho) AS id_b FROM n WHERE k <= 5"""

_P9 = rf"""WITH i AS (SELECT item_id, regexp_extract_all(lower(strip_accents(texto)), '[\p{{L}}\p{{N}}]+') AS w FROM itens_avaliacao),
  d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
  gi AS (SELECT item_id, array_to_string(w[k : k + {leakage.RUN - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {leakage.RUN - 2})) AS k FROM i)),
  gd AS (SELECT doc_id, array_to_string(w[k : k + {leakage.RUN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {leakage.RUN - 2})) AS k FROM d))
SELECT DISTINCT item_id, doc_id FROM gi JOIN gd USING (g)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can express on whole tables; the others are tested against brute force,
    round trips or held-out labels."""
    return {
        "p2_found": f"SELECT id, 'alvo' AS campo FROM interacoes WHERE regexp_matches(alvo, '{_P2}') UNION SELECT id, 'evidencia' FROM interacoes WHERE regexp_matches(evidencia, '{_P2}')",
        "p3_found": _P3,
        "p3_collapsed": _P3_COLLAPSED,
        "p6_found": _P6,
        "p9_found": _P9,
    }
