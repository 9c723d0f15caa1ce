"""Registered queries of selections, writes, queues and explanations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import text, vocabulary
from marisma.operators import answers, audit, chunks, explain, queue, selections, writes
from marisma.plans import runs
from marisma.queries import _CURRENT, _ELIGIBLE, _PAIRS, _POSITIVE, _REGISTERED, _SITUATION, _STATES, _fold, _quotation, _target, query
from marisma.queries_identify import _ENTRIES, _bare, _kw, _list
from marisma.session import table

_FILLED = "regexp_matches(coalesce({x}, ''), '[^\\s\\x{{85}}\\x{{A0}}\\x{{2028}}\\x{{2029}}]')"


def _filled(x: str) -> str:
    return _FILLED.format(x=x)


def _corpus(spark: SparkSession, d: str) -> answers.Corpus:
    return answers.Corpus.load(spark, d)


# ---------------------------------------------------------------- explanations

_COVERAGE = f"""n AS (SELECT
    (SELECT count(*) FROM bulas_interacoes s JOIN bulas b USING (nome_normalizado) WHERE {_ELIGIBLE}) AS elegiveis,
    (SELECT count(*) FROM vigentes v WHERE v.status = 'CONCLUIDO_SEM_RELACOES' OR EXISTS (SELECT 1 FROM interacoes i WHERE i.processamento_id = v.id)) AS concluidas,
    (SELECT count(*) FROM registrados r WHERE r.status = 'REVISAO_NECESSARIA' AND NOT EXISTS (SELECT 1 FROM vigentes v WHERE v.medicamento_origem = r.medicamento_origem)) AS em_revisao)"""


@query(f"""WITH {_CURRENT}, {_REGISTERED}, {_COVERAGE} SELECT elegiveis, concluidas + em_revisao AS analisadas, CASE WHEN elegiveis = 0 THEN 'Nenhum texto disponível para análise.'
    WHEN concluidas + em_revisao >= elegiveis AND em_revisao = 0 THEN 'Todos os textos disponíveis foram analisados.' WHEN concluidas + em_revisao >= elegiveis THEN 'Todos os textos foram analisados; parte aguarda revisão.'
    ELSE (concluidas + em_revisao) || ' de ' || elegiveis || ' textos analisados.' END AS mensagem FROM n""")
def coverage_message(spark: SparkSession, d: str) -> DataFrame:
    return explain.coverage_message(_corpus(spark, d)).select("elegiveis", "analisadas", "mensagem")


@query(f"""WITH {_POSITIVE}, {_SITUATION}, {_STATES}, n AS (SELECT medicamento_origem, count(*) AS relacoes, count(DISTINCT {_target("alvo")}) AS alvos FROM positivas GROUP BY 1)
  SELECT e.nome_normalizado, CASE WHEN n.alvos > 0 THEN n.relacoes || ' interações com ' || n.alvos || ' alvos.' WHEN e.conclusiva THEN 'Nenhuma interação identificada no texto.'
    ELSE 'Sem conclusão: a análise do texto não terminou.' END AS mensagem FROM estados e LEFT JOIN n ON n.medicamento_origem = e.nome_normalizado""")
def single_messages(spark: SparkSession, d: str) -> DataFrame:
    return explain.single_messages(_corpus(spark, d)).select("nome_normalizado", "mensagem")


@query(f"""WITH {_PAIRS}, {_SITUATION}, {_STATES}, n AS (SELECT a, b, count(*) FILTER (WHERE especie = 'ESPECIFICA') AS especificas, count(*) FILTER (WHERE especie = 'MENCAO') AS mencoes FROM linhas GROUP BY 1, 2),
    v AS (SELECT CASE WHEN coalesce(n.especificas, 0) > 0 THEN true WHEN coalesce(n.mencoes, 0) > 0 THEN NULL WHEN x.conclusiva AND y.conclusiva THEN false END AS identificada
      FROM pares p JOIN estados x ON x.nome_normalizado = p.a JOIN estados y ON y.nome_normalizado = p.b LEFT JOIN n ON n.a = p.a AND n.b = p.b)
  SELECT count(*) FILTER (WHERE identificada) AS sim, count(*) FILTER (WHERE NOT identificada) AS nao, count(*) FILTER (WHERE identificada IS NULL) AS sem_conclusao FROM v""")
def verdict_counters(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return explain.verdict_counters(c, answers.cited_pairs(c))


@query(f"""WITH {_PAIRS}, e AS (SELECT DISTINCT a, b, sentido, CASE WHEN sentido = 'BULA_A_CITA_B' THEN b ELSE a END AS outro, {_fold('alvo')} AS dito FROM linhas WHERE especie = 'ESPECIFICA'),
    g AS (SELECT a, b, sentido, outro, list(dito) AS ditos FROM e GROUP BY 1, 2, 3, 4),
    m AS (SELECT g.*, list_filter(list_transform(string_split(coalesce(principios_ativos, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM g JOIN bulas o ON o.nome_normalizado = g.outro),
    c AS (SELECT *, list_filter(p, lambda x: list_contains(ditos, {_fold('x')})) AS sim, list_filter(p, lambda x: NOT list_contains(ditos, {_fold('x')})) AS nao FROM m)
  SELECT a, b, sentido, len(p) AS componentes, array_to_string(sim, '; ') AS citados, CASE WHEN len(sim) > 0 THEN array_to_string(nao, '; ') ELSE '' END AS nao_citados, len(p) > 1 AND len(sim) > 0 AND len(nao) > 0 AS parcial FROM c""")
def component_explanation(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return explain.component_explanation(c, answers.cited_pairs(c))


@query(f"""WITH {_CURRENT}, r AS (SELECT i.id, i.medicamento_origem, {_fold('i.alvo')} AS alvo_normal, i.alvo, {_quotation('i.evidencia')} AS q, trim(i.resumo, ' ') AS s FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id),
    l AS (SELECT interacao_id AS id, medicamento_relacionado AS m FROM interacoes_medicamentos WHERE invalidado_em IS NULL), t AS (SELECT id, count(*) AS total FROM l GROUP BY 1)
  SELECT r.medicamento_origem, r.alvo_normal, arg_min(r.alvo, r.id) AS alvo, count(DISTINCT r.q) AS citacoes, count(DISTINCT r.s) AS resumos, greatest(count(DISTINCT l.m), coalesce(max(t.total), 0)) AS relacionados
  FROM r LEFT JOIN l ON l.id = r.id LEFT JOIN t ON t.id = r.id GROUP BY 1, 2""")
def target_groups(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    total = c.links.where("invalidado_em IS NULL").groupBy(F.col("interacao_id").alias("id")).agg(F.count("*").alias("total"))
    return explain.target_groups(c, total)


@query(f"WITH {_CURRENT} SELECT medicamento_origem, id AS processamento_id, resumo_geral AS resumo, CASE WHEN json_extract_string(reescrita_controle, '$.publicado.status') = 'CONCLUIDO' AND coalesce(json_extract_string(reescrita_controle, '$.entrada_invalidada') <> 'true', true) AND {_filled('resumo_geral_simples')} THEN resumo_geral_simples END AS simples FROM vigentes WHERE {_filled('resumo_geral')}")
def shown_summaries(spark: SparkSession, d: str) -> DataFrame:
    return explain.shown_summaries(_corpus(spark, d))


@query(f"""WITH h AS (SELECT processamento_id, id, sha256(concat_ws(chr(31), CAST(id AS VARCHAR), alvo, tipo_alvo, evidencia)) AS h, {_filled('resumo_card')} AS c FROM interacoes),
    g AS (SELECT processamento_id, count(*) AS relacoes, bool_and(c) AS c, sha256(array_to_string(list(h ORDER BY id), '')) AS identidade FROM h GROUP BY 1)
  SELECT g.processamento_id, g.relacoes, g.c AND {_filled('p.resumo_geral')} AS completo, g.identidade FROM g JOIN processamentos_interacoes p ON p.id = g.processamento_id""")
def run_snapshots(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d)
    return explain.snapshot(c.relations, c.runs)


@query("SELECT nome_normalizado, coalesce(length(trecho_interacoes) % 7 <> 0, false) AS coerente FROM bulas_interacoes")
def source_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Against hashes that a reader saw, of which every seventh length has changed since."""
    source = table(spark, d, "bulas_interacoes")
    seen = source.select("nome_normalizado", F.sha2(F.when(F.length("trecho_interacoes") % 7 == 0, F.concat("trecho_interacoes", F.lit(" "))).otherwise(F.col("trecho_interacoes")), 256).alias("hash_texto"))
    return explain.source_coherence(source, seen)


@query(rf"""WITH n AS (SELECT nome_normalizado, nome_anvisa AS nome, string_split_regex(nome_anvisa, '\s+') AS p, regexp_replace(nome_anvisa, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g') AS l FROM bulas WHERE nome_anvisa IS NOT NULL)
  SELECT nome_normalizado, CASE WHEN l = upper(l) OR l = lower(l) THEN array_to_string(list_transform(p, lambda w, i: CASE WHEN i > 1 AND lower(w) IN {_list(explain.SMALL_WORDS)} THEN lower(w) WHEN l = upper(l) AND length(w) <= 3 THEN w
    ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ') ELSE nome END AS nome FROM n""")
def readable_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bulas").where(F.col("nome_anvisa").isNotNull()).select("nome_normalizado", explain.readable_name(F.col("nome_anvisa")).alias("nome"))


@query(f"""WITH o AS (SELECT nome_normalizado AS n, row_number() OVER (ORDER BY nome_normalizado) AS p FROM bulas WHERE status = 'CONCLUIDO' QUALIFY p <= 40)
  SELECT x.p AS i, y.p AS j, least(x.n, y.n) AS a, greatest(x.n, y.n) AS b FROM o x JOIN o y ON x.p < y.p""")
def selection_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a selection of forty names, as a user makes one."""
    chosen = table(spark, d, "bulas").where("status = 'CONCLUIDO'").orderBy("nome_normalizado").limit(40)
    numbered = chosen.groupBy().agg(F.array_sort(F.collect_list("nome_normalizado")).alias("l")).select(F.posexplode("l").alias("p", "n"))
    return explain.selection_pairs(numbered.select((F.col("p") + 1).alias("p"), "n"), "p", "n")


@query(f"""WITH g AS (SELECT processamento_id, alvo, tipo_alvo, arg_min(medicamento_origem, id) AS origem, min(id) AS id, array_to_string(list_distinct(list(trim(resumo_card, ' '))), '') AS x, count(*) AS n FROM interacoes WHERE nullif(trim(resumo_card, ' '), '') IS NOT NULL GROUP BY 1, 2, 3)
  SELECT processamento_id, alvo, tipo_alvo, id, origem, n AS evidencias FROM g""")
def input_documents(spark: SparkSession, d: str) -> DataFrame:
    """Identity and size of the input document of each rewrite."""
    rows = explain.input_documents(table(spark, d, "interacoes"))
    count = F.size(F.from_json(F.get_json_object("entrada", "$.evidencias"), "array<map<string,string>>"))
    return rows.select("processamento_id", "alvo", "tipo_alvo", F.get_json_object("entrada", "$.id").cast("long").alias("id"), F.get_json_object("entrada", "$.origem").alias("origem"), count.alias("evidencias"))


# ---------------------------------------------------------------- selections


@query(f"""SELECT b.nome_normalizado, s.status_extracao IS NULL AS precisa_texto, NOT {_filled('b.principios_ativos')} OR NOT {_filled('b.composicao')} AS precisa_cadastro
  FROM bulas b LEFT JOIN bulas_interacoes s USING (nome_normalizado) WHERE b.status = 'CONCLUIDO' AND (s.status_extracao IS NULL OR NOT {_filled('b.principios_ativos')} OR NOT {_filled('b.composicao')})""")
def extraction_needs(spark: SparkSession, d: str) -> DataFrame:
    return selections.extraction_needs(table(spark, d, "bulas"), table(spark, d, "bulas_interacoes"))


@query(f"SELECT b.nome_normalizado, s.status_extracao FROM bulas b LEFT JOIN bulas_interacoes s USING (nome_normalizado) WHERE b.status = 'CONCLUIDO' AND (s.status_extracao IS NULL OR s.status_extracao IN {_list(selections.PENDING_EXTRACTION)})")
def pending_extractions(spark: SparkSession, d: str) -> DataFrame:
    return selections.pending_extractions(table(spark, d, "bulas"), table(spark, d, "bulas_interacoes"))


@query(f"SELECT s.nome_normalizado FROM bulas_interacoes s WHERE {_ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM bulas_interacoes_embeddings e WHERE e.nome_normalizado = s.nome_normalizado)")
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    return selections.pending_vectors(table(spark, d, "bulas_interacoes"), table(spark, d, "bulas_interacoes_embeddings"))


@query("SELECT nome_normalizado FROM bulas_interacoes_embeddings WHERE nome_normalizado IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(length(texto_chunk) % 5 <> 0, true))")
def unchanged_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Against a new chunking in which every fifth length has another hash."""
    own = table(spark, d, "bulas_interacoes_embeddings").where("nome_normalizado IS NOT NULL").select("nome_normalizado", "chunk_index", "texto_hash", "texto_chunk")
    again = own.withColumn("texto_hash", F.when(F.length("texto_chunk") % 5 == 0, F.concat("texto_hash", F.lit("x"))).otherwise(F.col("texto_hash")))
    return selections.unchanged_vectors(own, again)


@query(f"""WITH {_CURRENT}, {_REGISTERED}, c AS (SELECT processamento_id, bool_and({_filled('resumo_card')}) AS c FROM interacoes GROUP BY 1),
    r AS (SELECT b.nome_normalizado, coalesce(b.status = 'CONCLUIDO', false) AND {_filled('b.principios_ativos')} AND {_filled('b.composicao')} AS cadastro_ok, coalesce(s.status_extracao IN ('CONCLUIDO', 'SEM_SECAO_INTERACOES'), false) AS extracao_ok,
      s.status_extracao, v.status AS atual, coalesce(v.status, g.status) AS estado, coalesce(c.c AND {_filled('v.resumo_geral')}, false) AS cards_ok
      FROM bulas b LEFT JOIN bulas_interacoes s USING (nome_normalizado) LEFT JOIN vigentes v ON v.medicamento_origem = b.nome_normalizado LEFT JOIN c ON c.processamento_id = v.id LEFT JOIN registrados g ON g.medicamento_origem = b.nome_normalizado)
  SELECT nome_normalizado, cadastro_ok, extracao_ok, estado, cards_ok, cadastro_ok AND extracao_ok AND coalesce(status_extracao = 'SEM_SECAO_INTERACOES' OR atual = 'CONCLUIDO_SEM_RELACOES' OR (atual = 'CONCLUIDO_COM_RELACOES' AND cards_ok), false) AS pronto FROM r""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return selections.readiness(_corpus(spark, d))


@query("""SELECT i.id, (SELECT count(*) FROM interacoes j WHERE j.processamento_id = i.processamento_id AND j.alvo = i.alvo AND j.tipo_alvo = i.tipo_alvo AND nullif(trim(j.resumo_card, ' '), '') IS NOT NULL) AS irmaos,
    (SELECT min(j.id) FROM interacoes j WHERE j.processamento_id = i.processamento_id AND j.alvo = i.alvo AND j.tipo_alvo = i.tipo_alvo AND nullif(trim(j.resumo_card, ' '), '') IS NOT NULL) AS primeiro FROM interacoes i""")
def sibling_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = selections.siblings(table(spark, d, "interacoes"))
    listed = F.from_json("irmaos", "array<struct<id:bigint,resumo_card:string>>")
    return rows.select("id", F.coalesce(F.size(listed), F.lit(0)).alias("_n"), listed.alias("_l")).select("id", F.greatest("_n", F.lit(0)).alias("irmaos"), F.get("_l", F.lit(0))["id"].alias("primeiro"))


@query(f"""WITH {_CURRENT} SELECT i.id, string_agg(DISTINCT m.medicamento_relacionado, '; ' ORDER BY m.medicamento_relacionado) AS sinonimos
  FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id JOIN interacoes_medicamentos m ON m.interacao_id = i.id AND m.invalidado_em IS NULL
  JOIN bulas b ON b.nome_normalizado = m.medicamento_relacionado AND len(list_filter(list_transform(string_split(coalesce(b.principios_ativos, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '')) = 1
  WHERE EXISTS (SELECT 1 FROM bulas o WHERE o.nome_normalizado = i.medicamento_origem) GROUP BY 1""")
def single_substance_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return selections.single_substance_synonyms(_corpus(spark, d))


@query(f"""WITH {_CURRENT}, {_ENTRIES}, novas AS (SELECT nome_normalizado FROM bulas WHERE starts_with(nome_normalizado, 'm')),
    nk AS (SELECT k FROM nomes_k JOIN novas USING (nome_normalizado) UNION SELECT k FROM semsal JOIN novas USING (nome_normalizado) UNION SELECT s FROM semsal JOIN novas USING (nome_normalizado)),
    a AS (SELECT DISTINCT i.id, i.medicamento_origem, {_kw(_target('i.alvo'))} AS k FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id WHERE EXISTS (SELECT 1 FROM bulas o WHERE o.nome_normalizado = i.medicamento_origem)),
    b AS (SELECT *, CASE WHEN length(b) >= 4 AND b NOT IN {_list(vocabulary.ANIONS)} THEN b ELSE k END AS s FROM (SELECT *, {_bare('k')} AS b FROM a)),
    h AS (SELECT * FROM b WHERE k IN (SELECT k FROM nk) OR s IN (SELECT k FROM nk)),
    m AS (SELECT h.id, n.nome_normalizado, h.medicamento_origem, 0 AS p FROM h JOIN nomes_k n ON n.k = h.k UNION ALL SELECT h.id, e.nome_normalizado, h.medicamento_origem, 1 FROM h JOIN chaves e ON e.k = h.k
      UNION ALL SELECT h.id, e.nome_normalizado, h.medicamento_origem, 3 FROM h JOIN semsal e ON e.s = h.s)
  SELECT id, nome_normalizado AS medicamento_relacionado, CASE min(p) WHEN 0 THEN 'NOME_MEDICAMENTO_EXATO' WHEN 1 THEN 'PRINCIPIO_ATIVO_EXATO' ELSE 'PRINCIPIO_ATIVO_SEM_SAL' END AS criterio_vinculo
  FROM m WHERE nome_normalizado <> medicamento_origem GROUP BY 1, 2""")
def relinked(spark: SparkSession, d: str) -> DataFrame:
    """Links of the relations that entries with the initial m affect."""
    c = _corpus(spark, d)
    return selections.relinked(c, c.catalog.where(F.col("nome_normalizado").startswith("m")))


@query(f"""WITH {_CURRENT}, c AS (SELECT processamento_id, bool_or(NOT {_filled('resumo_card')}) AS sem, bool_or(coalesce(resumo_atualizado_em < TIMESTAMP '2025-06-01', false)) AS velho FROM interacoes GROUP BY 1)
  SELECT v.medicamento_origem, NOT {_filled('v.resumo_geral')} OR c.sem AS falta FROM vigentes v JOIN c ON c.processamento_id = v.id
  WHERE v.status = 'CONCLUIDO_COM_RELACOES' AND (NOT {_filled('v.resumo_geral')} OR c.sem OR coalesce(v.resumo_gerado_em < TIMESTAMP '2025-06-01', false) OR c.velho)""")
def pending_summaries(spark: SparkSession, d: str) -> DataFrame:
    return selections.pending_summaries(_corpus(spark, d), F.expr("timestamp_ntz'2025-06-01 00:00:00'"))


@query("""SELECT p.id FROM processamentos_interacoes p JOIN bulas b ON b.nome_normalizado = p.medicamento_origem WHERE p.status IS NOT DISTINCT FROM CASE WHEN b.tentativas IS NULL THEN p.status ELSE 'CONCLUIDO_COM_RELACOES' END
  AND p.versao_processamento IS NOT DISTINCT FROM CASE WHEN b.numero_registro IS NULL THEN NULL ELSE p.versao_processamento END""")
def strict_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose recorded identity of the source is the source's, null-safe."""
    own = table(spark, d, "processamentos_interacoes").join(table(spark, d, "bulas").select(F.col("nome_normalizado").alias("medicamento_origem"), "tentativas", "numero_registro"), "medicamento_origem")
    source = own.select(F.col("id").cast("string").alias("nome_normalizado"), F.when(F.col("tentativas").isNull(), F.col("status")).otherwise("CONCLUIDO_COM_RELACOES").alias("x"), F.when(F.col("numero_registro").isNotNull(), F.col("versao_processamento")).alias("y"))
    asked = own.select(F.col("id").cast("string").alias("medicamento_origem"), "id", "status", "versao_processamento")
    return selections.strict_current(asked, source, [("status", "x"), ("versao_processamento", "y")]).select("id")


@query("SELECT id, CAST(epoch_us(invalidado_em) - epoch_us(concluido_em) AS DOUBLE) / 1000000 AS segundos FROM processamentos_interacoes WHERE invalidado_em IS NOT NULL")
def validity_seconds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processamentos_interacoes").where("invalidado_em IS NOT NULL")
    return rows.select("id", selections.elapsed_seconds(F.col("concluido_em"), F.col("invalidado_em")).alias("segundos"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch(ts) * 1.0 WHEN 1 THEN floor(epoch(ts)) WHEN 2 THEN epoch(date_trunc('day', ts)) WHEN 3 THEN epoch(date_trunc('second', ts)) WHEN 4 THEN epoch(date_trunc('day', ts)) END AS lido
  FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)""")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of events written in six ways, one of them broken, and read again."""
    t = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 6
    written = (
        F.when(kind == 0, F.unix_millis(t).cast("string")).when(kind == 1, F.unix_seconds(t).cast("string")).when(kind == 2, F.date_format(t, "dd/MM/yyyy"))
        .when(kind == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXX")).when(kind == 4, F.date_format(t, "yyyy-MM-dd")).otherwise("ontem")
    )
    rows = table(spark, d, "events").select("event_id", selections.parsed_time(written).alias("_t"))
    return rows.select("event_id", (F.unix_micros("_t") / 1_000_000).alias("lido"))


# ---------------------------------------------------------------- writes

def _batch(spark: SparkSession, d: str) -> tuple:
    """A batch for every source: other version for most, a stale hash for every ninth length, up to two
    relations an origin and a repeated link."""
    c = _corpus(spark, d)
    n = F.length(F.coalesce("trecho_interacoes", F.lit("")))
    run = c.source.select(F.col("nome_normalizado").alias("medicamento_origem"), F.when(n % 4 == 0, "v1.2").otherwise("v9").alias("versao_processamento"), F.when(n % 9 == 0, "velho").otherwise(F.sha2("trecho_interacoes", 256)).alias("hash_texto"), F.lit("CONCLUIDO_COM_RELACOES").alias("status"))
    rel = c.source.select(F.col("nome_normalizado").alias("medicamento_origem"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ordem")).withColumn("alvo", F.concat(F.lit("alvo "), "ordem"))
    link = rel.select("medicamento_origem", "ordem", F.lit("x").alias("medicamento_relacionado"), F.explode(F.array(F.lit("B"), F.lit("A"))).alias("criterio_vinculo"))
    return writes.append_result(c.runs, c.relations, c.links, runs.registered_runs(c.runs, c.source), c.source, run, rel, link)


_BATCH = f"""{_REGISTERED}, e AS (SELECT s.nome_normalizado AS o, length(coalesce(s.trecho_interacoes, '')) AS n, s.trecho_interacoes AS t, CASE WHEN length(coalesce(s.trecho_interacoes, '')) % 4 = 0 THEN 'v1.2' ELSE 'v9' END AS v FROM bulas_interacoes s),
    j AS (SELECT e.*, CASE WHEN t IS NULL THEN 'FONTE_AUSENTE' WHEN n % 9 = 0 THEN 'FONTE_ALTERADA' WHEN r.versao_processamento = e.v THEN 'VERSAO_REGISTRADA' END AS motivo FROM e LEFT JOIN registrados r ON r.medicamento_origem = e.o),
    k AS (SELECT o, v, (SELECT max(id) FROM processamentos_interacoes) + row_number() OVER (ORDER BY o) AS id FROM j WHERE motivo IS NULL)"""


@query(f"WITH {_BATCH} SELECT o AS medicamento_origem, v AS versao_processamento, id, 'CONCLUIDO_COM_RELACOES' AS status FROM k")
def appended_runs(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)[0]


@query(f"""WITH {_BATCH}, r AS (SELECT k.o, k.id AS p, x.ordem, (SELECT max(id) FROM interacoes) + row_number() OVER (ORDER BY k.o, x.ordem) AS id FROM k CROSS JOIN (SELECT unnest([1, 2]) AS ordem) x)
  SELECT r.id, r.o AS medicamento_origem, r.p AS processamento_id, 'alvo ' || r.ordem AS alvo, 'x' AS medicamento_relacionado, 'A' AS criterio_vinculo FROM r""")
def appended_relations(spark: SparkSession, d: str) -> DataFrame:
    _, rel, link, _ = _batch(spark, d)
    return rel.join(link.withColumnRenamed("interacao_id", "id"), "id")


@query(f"WITH {_BATCH} SELECT o AS medicamento_origem, motivo FROM j WHERE motivo IS NOT NULL")
def refused_runs(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d)[3]


@query("""SELECT 500 + row_number() OVER (ORDER BY nome_normalizado) AS id, nome_normalizado AS medicamento_origem, 'FALHA' AS status, 'v9' AS versao_processamento, 0 AS quantidade_relacoes, 0 AS quantidade_rejeicoes
  FROM bulas_interacoes WHERE nullif(trim(trecho_interacoes, ' '), '') IS NULL""")
def failure_rows(spark: SparkSession, d: str) -> DataFrame:
    blank = table(spark, d, "bulas_interacoes").where(~F.coalesce(text.not_blank(F.col("trecho_interacoes")), F.lit(False)))
    return writes.failure_rows(blank, "v9", 500)


@query("SELECT nome_normalizado, status, tentativas, true AS existia FROM bulas UNION ALL SELECT '~' || nome_normalizado, 'NOVO', 1, false FROM bulas WHERE status = 'ERRO'")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas").select("nome_normalizado", "status", "tentativas").withColumn("existia", F.lit(True))
    fresh = old.where("status = 'ERRO'").select(F.concat(F.lit("~"), "nome_normalizado").alias("nome_normalizado"), F.lit("NOVO").alias("status"), F.lit(1).alias("tentativas"), F.lit(False).alias("existia"))
    known = old.withColumn("existia", F.lit(False))
    return writes.insert_if_absent(old, fresh.unionByName(known).unionByName(fresh), "nome_normalizado")[0]


@query("SELECT nome_normalizado, CASE WHEN status IN ('ERRO', 'PENDENTE') THEN 'REVISTO' ELSE status END AS status, tentativas FROM bulas")
def pending_only_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas").select("nome_normalizado", "status", "tentativas")
    new = old.select("nome_normalizado", F.lit("REVISTO").alias("status"))
    return writes.pending_only_upsert(old, new, "nome_normalizado", ["status"], "status", ("ERRO", "PENDENTE"))[0]


@query("SELECT nome_normalizado, CASE WHEN status = 'CONCLUIDO' THEN status ELSE 'ERRO' END AS status, CASE WHEN status = 'CONCLUIDO' THEN tentativas ELSE coalesce(tentativas, 0) + 1 END AS tentativas FROM bulas")
def attempt_counter(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas")
    return writes.count_attempts(old, old.select("nome_normalizado", F.lit("ERRO").alias("status")), "nome_normalizado")


@query("SELECT nome_normalizado, coalesce(CASE WHEN status = 'ERRO' THEN 'novo' END, expediente) AS expediente, coalesce(principios_ativos, numero_registro) AS numero_registro FROM (SELECT nome_normalizado, status, expediente, principios_ativos, numero_registro FROM bulas)")
def coalesce_update(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas")
    new = old.select("nome_normalizado", F.when(F.col("status") == "ERRO", "novo").alias("expediente"), F.col("principios_ativos").alias("numero_registro"))
    return writes.coalesce_update(old.select("nome_normalizado", "expediente", "numero_registro"), new, "nome_normalizado", ["expediente", "numero_registro"])


@query(f"WITH {_CURRENT} SELECT i.id, 'c' || i.id AS resumo_card FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id WHERE i.id % 3 <> 0")
def card_updates(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all relations, every third made from an evidence that has changed since."""
    c = _corpus(spark, d)
    cards = c.relations.select("id", "processamento_id", F.when(F.col("id") % 3 == 0, "outra").otherwise(F.col("evidencia")).alias("evidencia"), F.concat(F.lit("c"), "id").alias("resumo_card"))
    return writes.update_cards(c.relations, c.current(), cards)[0]


@query("""WITH m AS (SELECT DISTINCT processamento_id, alvo, tipo_alvo FROM interacoes WHERE resumo_status = 'FALHA' AND id % 2 = 0)
  SELECT i.id, 'true' AS invalidada, json_extract_string(i.reescrita_controle, '$.publicado.status') AS publicado FROM interacoes i WHERE EXISTS (SELECT 1 FROM m WHERE m.processamento_id = i.processamento_id AND m.alvo = i.alvo AND m.tipo_alvo = i.tipo_alvo)""")
def invalidated_rewrites(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    changed = rows.where("resumo_status = 'FALHA'").select("id", (F.col("id") % 2 != 0).alias("publica"))
    marked = writes.invalidate_rewrites(rows, changed)
    state = F.coalesce(F.get_json_object("controle", "$.publicado.status"), F.get_json_object(F.get_json_object("controle", "$.publicado"), "$.status"))
    return marked.select("id", F.get_json_object("controle", "$.entrada_invalidada").alias("invalidada"), state.alias("publicado"))


@query("""WITH n AS (SELECT nome_normalizado, chunk_index, texto_chunk || '!' AS t FROM bulas_interacoes_embeddings WHERE chunk_index = 0 AND nome_normalizado < 'm')
  SELECT nome_normalizado, chunk_index, t AS texto_chunk FROM n UNION ALL SELECT e.nome_normalizado, e.chunk_index, e.texto_chunk FROM bulas_interacoes_embeddings e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.nome_normalizado = e.nome_normalizado)""")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas_interacoes_embeddings").select("nome_normalizado", "chunk_index", "texto_chunk")
    new = old.where("chunk_index = 0 AND nome_normalizado < 'm'").withColumn("texto_chunk", F.concat("texto_chunk", F.lit("!")))
    return writes.replace_chunks(old, new)


@query(r"SELECT count(*) AS total, count(*) FILTER (WHERE status_extracao = 'REVISAO_MANUAL') AS fracos, round(count(*) FILTER (WHERE status_extracao = 'REVISAO_MANUAL') / CAST(nullif(count(*) FILTER (WHERE status_extracao = 'CONCLUIDO'), 0) AS DOUBLE), 6) AS parte, coalesce(count(*) FILTER (WHERE status_extracao = 'REVISAO_MANUAL') / CAST(nullif(count(*) FILTER (WHERE status_extracao = 'CONCLUIDO'), 0) AS DOUBLE) > 0.2, false) AS alarme FROM bulas_interacoes")
def quality_alarm(spark: SparkSession, d: str) -> DataFrame:
    return audit.quality_alarm(table(spark, d, "bulas_interacoes"), F.col("status_extracao") == "REVISAO_MANUAL", F.col("status_extracao") == "CONCLUIDO")


# ---------------------------------------------------------------- queue (on events, as no table holds one)

_QUEUE = """fila AS (SELECT event_id AS id, 'n' || (user_id % 97) AS nome_normalizado, CASE WHEN event_id % 11 = 0 THEN 'n' || (user_id % 89) END AS nome_confirmado, CASE WHEN event_id % 5 = 0 AND event_id > 40 THEN event_id - 5 - 5 * (event_id % 3) END AS principal_id,
    CASE event_type WHEN 'click' THEN 'AGUARDANDO' WHEN 'view' THEN 'EM_PROCESSAMENTO' ELSE 'CONCLUIDO' END AS estado, CAST(event_id % 5 AS INTEGER) AS tentativas, ts AS criado_em, ts AS disponivel_em FROM events)"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    id_, user = F.col("event_id"), F.col("user_id")
    state = F.when(F.col("event_type") == "click", "AGUARDANDO").when(F.col("event_type") == "view", "EM_PROCESSAMENTO").otherwise("CONCLUIDO")
    return table(spark, d, "events").select(
        id_.alias("id"), F.concat(F.lit("n"), user % 97).alias("nome_normalizado"), F.when(id_ % 11 == 0, F.concat(F.lit("n"), user % 89)).alias("nome_confirmado"), F.when((id_ % 5 == 0) & (id_ > 40), id_ - 5 - 5 * (id_ % 3)).alias("principal_id"),
        state.alias("estado"), (id_ % 5).cast("int").alias("tentativas"), F.col("ts").alias("criado_em"), F.col("ts").alias("disponivel_em"),
    )


@query(f"""WITH {_QUEUE}, p AS (SELECT event_id AS pedido, 'n' || (event_id % 120) AS nome_normalizado FROM events WHERE event_id % 7 = 0), c AS (SELECT DISTINCT 'n' || (100 + length(nome_normalizado)) AS n FROM bulas),
    a AS (SELECT n, arg_min(id, (criado_em, id)) AS id FROM (SELECT nome_normalizado AS n, id, criado_em FROM fila WHERE principal_id IS NULL AND estado IN {_list(queue.ACTIVE)}
      UNION SELECT nome_confirmado, id, criado_em FROM fila WHERE nome_confirmado IS NOT NULL AND principal_id IS NULL AND estado IN {_list(queue.ACTIVE)}) GROUP BY 1),
    f AS (SELECT nome_normalizado, min(pedido) AS m FROM p GROUP BY 1)
  SELECT p.pedido, p.nome_normalizado, CASE WHEN a.id IS NOT NULL THEN a.id WHEN c.n IS NULL THEN f.m END AS destino, CASE WHEN a.id IS NOT NULL THEN 'EXISTENTE' WHEN c.n IS NOT NULL THEN 'CADASTRADO' WHEN p.pedido = f.m THEN 'NOVO' ELSE 'REPETIDO' END AS decisao
  FROM p LEFT JOIN a ON a.n = p.nome_normalizado LEFT JOIN c ON c.n = p.nome_normalizado JOIN f ON f.nome_normalizado = p.nome_normalizado""")
def queue_accept(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("pedido"), F.concat(F.lit("n"), F.col("event_id") % 120).alias("nome_normalizado"))
    known = table(spark, d, "bulas").select(F.concat(F.lit("n"), 100 + F.length("nome_normalizado")).alias("nome_normalizado"))
    return queue.accept(asked, _queue(spark, d), known)


@query(f"""WITH RECURSIVE {_QUEUE}, r AS (SELECT id, coalesce(principal_id, id) AS fim, CASE WHEN principal_id IS NULL THEN 0 ELSE 1 END AS saltos, principal_id IS NOT NULL AS segue FROM fila
    UNION ALL SELECT r.id, coalesce(f.principal_id, f.id), CASE WHEN f.principal_id IS NULL THEN r.saltos ELSE r.saltos + 1 END, f.principal_id IS NOT NULL FROM r JOIN fila f ON f.id = r.fim WHERE r.segue AND r.saltos < 16),
    u AS (SELECT id, arg_max(fim, saltos) AS fim, max(saltos) AS saltos FROM r GROUP BY 1)
  SELECT u.id, CASE WHEN f.id IS NOT NULL THEN u.fim END AS final, u.saltos FROM u LEFT JOIN fila f ON f.id = u.fim AND f.principal_id IS NULL""")
def queue_redirects(spark: SparkSession, d: str) -> DataFrame:
    return queue.followed(_queue(spark, d))


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN estado = 'EM_PROCESSAMENTO' AND principal_id IS NULL THEN CASE WHEN tentativas >= 3 THEN 'FALHA' ELSE 'AGUARDANDO' END ELSE estado END AS estado FROM fila")
def queue_recovery(spark: SparkSession, d: str) -> DataFrame:
    return queue.recovered(_queue(spark, d)).select("id", "estado")


@query(f"WITH {_QUEUE} SELECT id, 'EM_PROCESSAMENTO' AS estado, tentativas + 1 AS tentativas FROM fila WHERE estado = 'AGUARDANDO' AND principal_id IS NULL AND disponivel_em <= TIMESTAMP '2030-01-01' AND tentativas < 3 ORDER BY criado_em, id LIMIT 20")
def queue_reservable(spark: SparkSession, d: str) -> DataFrame:
    return queue.reservable(_queue(spark, d), F.expr("timestamp_ntz'2030-01-01 00:00:00'"), 20).select("id", "estado", "tentativas")


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN id % 4 = 0 THEN 'AGUARDANDO' ELSE estado END AS estado, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2030-01-01 00:01:30' ELSE disponivel_em END AS disponivel_em FROM fila")
def queue_reschedule(spark: SparkSession, d: str) -> DataFrame:
    own = _queue(spark, d)
    return queue.rescheduled(own, own.where("id % 4 = 0"), F.expr("timestamp_ntz'2030-01-01 00:00:00'"), 90).select("id", "estado", "disponivel_em")


@query(f"WITH {_QUEUE} SELECT estado, count(*) AS pedidos, sum(tentativas) AS tentativas, round(count(*) / CAST((SELECT count(*) FROM fila) AS DOUBLE), 6) AS parte FROM fila GROUP BY 1")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    return queue.attempts_by_state(_queue(spark, d))


# ---------------------------------------------------------------- audits of data that breaks every rule


@query("""WITH x AS (SELECT id, CASE WHEN id % 7 = 0 THEN quantidade_janelas + 1 ELSE janelas_concluidas END AS jc, quantidade_janelas AS qj, CASE WHEN id % 11 = 0 THEN 'INVENTADO' ELSE status END AS s, CASE WHEN id % 13 = 0 THEN 0 ELSE quantidade_relacoes END AS qr, CASE WHEN id % 17 = 0 THEN '  ' ELSE versao_processamento END AS v FROM processamentos_interacoes)
  SELECT id, regra FROM (SELECT id, unnest([CASE WHEN coalesce(jc >= 0 AND jc <= qj AND (jc = qj OR s = 'FALHA'), true) THEN NULL ELSE 'janelas' END,
    CASE WHEN coalesce(CASE WHEN s = 'CONCLUIDO_COM_RELACOES' THEN qr > 0 WHEN s = 'CONCLUIDO_SEM_RELACOES' THEN qr = 0 END, true) THEN NULL ELSE 'relacoes' END,
    CASE WHEN coalesce(s IN ('CONCLUIDO_COM_RELACOES', 'CONCLUIDO_SEM_RELACOES', 'REVISAO_NECESSARIA', 'FALHA'), true) THEN NULL ELSE 'status' END, CASE WHEN coalesce(trim(v, ' ') <> '', true) THEN NULL ELSE 'versao' END]) AS regra FROM x) WHERE regra IS NOT NULL""")
def broken_check_audit(spark: SparkSession, d: str) -> DataFrame:
    from marisma.schemas import run_checks

    id_ = F.col("id")
    rows = table(spark, d, "processamentos_interacoes").withColumns({
        "janelas_concluidas": F.when(id_ % 7 == 0, F.col("quantidade_janelas") + 1).otherwise(F.col("janelas_concluidas")), "status": F.when(id_ % 11 == 0, "INVENTADO").otherwise(F.col("status")),
        "quantidade_relacoes": F.when(id_ % 13 == 0, 0).otherwise(F.col("quantidade_relacoes")), "versao_processamento": F.when(id_ % 17 == 0, "  ").otherwise(F.col("versao_processamento")),
    })
    return audit.check_violations(rows, "id", run_checks())


@query("SELECT id, processamento_id FROM interacoes WHERE id % 19 = 0")
def broken_origin_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes").withColumn("medicamento_origem", F.when(F.col("id") % 19 == 0, F.concat("medicamento_origem", F.lit("?"))).otherwise(F.col("medicamento_origem")))
    return audit.origin_mismatches(rows, table(spark, d, "processamentos_interacoes"))


@query("SELECT id FROM processamentos_interacoes WHERE id % 23 = 0")
def moved_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose origin, which never may change, changed."""
    old = table(spark, d, "processamentos_interacoes")
    new = old.withColumn("medicamento_origem", F.when(F.col("id") % 23 == 0, F.concat("medicamento_origem", F.lit("?"))).otherwise(F.col("medicamento_origem")))
    return audit.changed_rows(old, new, "id", ["medicamento_origem"])


@query("SELECT label, i AS posicao, round(x / n, 5) AS media FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2))")
def unit_mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    means = chunks.unit_mean(table(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("media").alias("posicao", "_m")).select("label", "posicao", F.round("_m", 5).alias("media"))
