"""Registered queries of the engine's own operators, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import rules, text, vocabulary
from marisma.operators import answers, audit, chunks, composition, packed, passages, sections, summaries, validate, writes
from marisma.plans import runs
from marisma.schemas import run_checks
from marisma.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- SQL shared by the oracles

_SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _fold(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '{_SPACES}', ' ', 'g'))"


def _target(x: str) -> str:
    bare = _fold(f"regexp_replace({x}, '[®™©]', ' ', 'g')")
    border = r"""[\s.,;:!?()\[\]{}"''*…-]+"""
    return f"regexp_replace({bare}, '^{border}|{border}$', '', 'g')"


def _quotation(x: str) -> str:
    return f"lower(regexp_replace({x}, '{_SPACES}', '', 'g'))"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9]+')"


def _padded(x: str) -> str:
    return f"(' ' || array_to_string({_words(x)}, ' ') || ' ')"


def _in(values: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_ELIGIBLE = "status_extracao = 'CONCLUIDO' AND nullif(trim(trecho_interacoes, ' '), '') IS NOT NULL"


def _latest(name: str, status: tuple[str, ...]) -> str:
    return f"""{name} AS (
      SELECT * EXCLUDE (rn) FROM (
        SELECT p.*, row_number() OVER (PARTITION BY p.medicamento_origem ORDER BY p.id DESC) AS rn
        FROM processamentos_interacoes p
        WHERE p.invalidado_em IS NULL AND p.status IN {_in(status)}
          AND EXISTS (SELECT 1 FROM bulas_interacoes s WHERE s.nome_normalizado = p.medicamento_origem AND {_ELIGIBLE}))
      WHERE rn = 1)"""


_CURRENT = _latest("vigentes", runs.DONE)
_REGISTERED = _latest("registrados", (*runs.DONE, "REVISAO_NECESSARIA"))

_RELEVANT = f"list_filter({{w}}, lambda x: length(x) >= 3 AND NOT list_contains({list(vocabulary.STOP_WORDS)!r}, x))"
_DEHYPHEN = r"regexp_replace(coalesce({x}, ''), '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')"
_CLAUSES = r"list_filter(string_split_regex({x}, '{end}'), lambda c: trim(c) <> '')"


def _not_positive(evidence: str, target: str) -> str:
    """CTE body columns: _f folded evidence, _t folded target -> expression over them."""
    words = _RELEVANT.format(w=_words("_t"))
    own = _CLAUSES.format(x="_f", end=vocabulary.CLAUSE_END.replace("'", "''"))
    inside = lambda c, t: f"(len({_words(t)}) > 0 AND contains({_padded(c)}, {_padded(t)}))"
    names = f"({inside('c', '_t')} OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT {inside('c', 'w')})) = 0))"
    return f"""SELECT *, (len(list_filter(proprias, lambda c: regexp_matches(c, '{vocabulary.ABSENCE}'))) > 0
                     AND len(list_filter(proprias, lambda c: regexp_matches(c, '{vocabulary.RECOMMENDATION}'))) = 0) AS nao_positiva
      FROM (SELECT *, CASE WHEN len(citam) > 0 THEN citam ELSE [_f] END AS proprias
            FROM (SELECT *, list_filter({own}, lambda c: {names}) AS citam
                  FROM (SELECT i.*, {_fold(_DEHYPHEN.format(x=evidence))} AS _f, {_target(f"coalesce({target}, '')")} AS _t FROM interacoes i)))"""


_POSITIVE = f"""{_CURRENT}, julgadas AS ({_not_positive("i.evidencia", "i.alvo")}),
    positivas AS (SELECT j.* FROM julgadas j JOIN vigentes v ON v.id = j.processamento_id
                  WHERE NOT j.nao_positiva AND EXISTS (SELECT 1 FROM bulas b WHERE b.nome_normalizado = j.medicamento_origem))"""

_DISPLAY = "coalesce(nullif(trim({t}nome_anvisa, ' '), ''), {t}nome_normalizado)"
_SITUATION = f"""situacao AS (
    SELECT b.nome_normalizado, {_DISPLAY.format(t="b.")} AS nome_exibicao, b.status AS status_bula,
      s.nome_normalizado IS NOT NULL AS tem_extracao, s.status_extracao,
      coalesce(nullif(trim(s.trecho_interacoes, ' '), '') IS NOT NULL, false) AS tem_texto,
      v.id AS processamento_id, v.status AS status_processamento,
      (SELECT p.status FROM processamentos_interacoes p WHERE p.medicamento_origem = b.nome_normalizado AND p.invalidado_em IS NULL ORDER BY p.id DESC LIMIT 1) AS ultimo_status,
      EXISTS (SELECT 1 FROM interacoes i WHERE i.processamento_id = v.id) AS tem_mencoes,
      EXISTS (SELECT 1 FROM processamentos_interacoes r WHERE r.medicamento_origem = b.nome_normalizado AND r.invalidado_em IS NOT NULL) AS tem_retirada
    FROM bulas b LEFT JOIN bulas_interacoes s USING (nome_normalizado)
    LEFT JOIN vigentes v ON v.medicamento_origem = b.nome_normalizado)"""
_STATES = f"""estados AS (
    SELECT *, estado = 'CONCLUIDO_SEM_RELACOES' OR (estado = 'CONCLUIDO_COM_RELACOES' AND tem_mencoes) AS conclusiva
    FROM (SELECT *, CASE
      WHEN processamento_id IS NOT NULL THEN status_processamento
      WHEN status_bula IS DISTINCT FROM 'CONCLUIDO' THEN 'SEM_BULA'
      WHEN NOT tem_extracao THEN 'EXTRACAO_INDISPONIVEL'
      WHEN status_extracao = 'SEM_SECAO_INTERACOES' THEN 'SEM_TOPICO_INTERACOES'
      WHEN status_extracao IS DISTINCT FROM 'CONCLUIDO' OR NOT tem_texto THEN 'EXTRACAO_INDISPONIVEL'
      WHEN ultimo_status = 'FALHA' THEN 'FALHA'
      WHEN ultimo_status = 'REVISAO_NECESSARIA' THEN 'REVISAO_NECESSARIA'
      WHEN tem_retirada THEN 'RETIRADO' ELSE 'NAO_PROCESSADO' END AS estado FROM situacao))"""

_SETS = rf"""nomes AS (
    SELECT nome_normalizado, list_filter(list_transform(
      list_concat([nome_normalizado, coalesce(nome_anvisa, '')], list_filter(list_transform(string_split(coalesce(principios_ativos, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '')),
      lambda x: list_filter({_words(_fold("x"))}, lambda w: length(w) >= 3)), lambda s: len(s) > 0) AS conjuntos FROM bulas)"""
_PAIRS = f"""{_POSITIVE}, correntes AS (
      SELECT i.* FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id WHERE EXISTS (SELECT 1 FROM bulas b WHERE b.nome_normalizado = i.medicamento_origem)),
    pares AS (SELECT DISTINCT least(i.medicamento_origem, m.medicamento_relacionado) AS a, greatest(i.medicamento_origem, m.medicamento_relacionado) AS b
      FROM correntes i JOIN interacoes_medicamentos m ON m.interacao_id = i.id AND m.invalidado_em IS NULL
      JOIN bulas o ON o.nome_normalizado = m.medicamento_relacionado WHERE i.medicamento_origem <> m.medicamento_relacionado),
    sentidos AS (SELECT a, b, a AS origem, b AS outro, 'BULA_A_CITA_B' AS sentido FROM pares UNION ALL SELECT a, b, b, a, 'BULA_B_CITA_A' FROM pares),
    {_SETS},
    linhas AS (
      SELECT * FROM (
        SELECT s.a, s.b, s.sentido, p.medicamento_origem, p.id, p.processamento_id, p.alvo, p.tipo_alvo, p.resumo, p.evidencia, m.criterio_vinculo,
          CASE WHEN m.criterio_vinculo IS NOT NULL THEN 'ESPECIFICA' WHEN p.tipo_alvo = 'CLASSE_FARMACOLOGICA' THEN 'ALERTA'
               WHEN len(list_filter({_words(_fold("p.alvo"))}, lambda w: length(w) >= 3)) > 0
                AND len(list_filter(n.conjuntos, lambda c: list_has_all(c, list_filter({_words(_fold("p.alvo"))}, lambda w: length(w) >= 3)))) > 0 THEN 'MENCAO' END AS especie,
          m.interacao_id IS NOT NULL OR p.tipo_alvo IN {_in(answers.MENTION_TYPES)} AS vale
        FROM sentidos s JOIN positivas p ON p.medicamento_origem = s.origem
        LEFT JOIN interacoes_medicamentos m ON m.interacao_id = p.id AND m.invalidado_em IS NULL AND m.medicamento_relacionado = s.outro
        LEFT JOIN nomes n ON n.nome_normalizado = s.outro)
      WHERE vale AND especie IS NOT NULL)"""


# ---------------------------------------------------------------- packed fields (problem 4)


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(table(spark, d, "bulas"), "nome_normalizado", ["principios_ativos", "composicao"])


@query()
def p4_marks(spark: SparkSession, d: str) -> DataFrame:
    """The score of every candidate mark in every source."""
    return packed.score_marks(table(spark, d, "bulas"), "nome_normalizado", ["principios_ativos", "composicao"])


# ---------------------------------------------------------------- runs and what is current

_RUN_COLUMNS = ("id", "medicamento_origem", "status", "versao_processamento", "quantidade_relacoes")


@query(f"WITH {_CURRENT} SELECT {', '.join(_RUN_COLUMNS)} FROM vigentes")
def current_runs(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    return c.current().select(*_RUN_COLUMNS)


@query(f"WITH {_REGISTERED} SELECT {', '.join(_RUN_COLUMNS)} FROM registrados")
def registered_runs(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    return runs.registered_runs(c.runs, c.source).select(*_RUN_COLUMNS)


@query(f"WITH {_CURRENT} SELECT p.id, p.medicamento_origem, p.status, p.quantidade_relacoes, p.quantidade_rejeicoes, v.id IS NOT NULL AS vigente FROM processamentos_interacoes p LEFT JOIN vigentes v ON v.id = p.id")
def history_with_flag(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    return runs.history_with_flag(c.runs, c.source)


@query(f"""WITH {_REGISTERED} SELECT s.nome_normalizado, sha256(s.trecho_interacoes) AS hash_texto,
    EXISTS (SELECT 1 FROM processamentos_interacoes p WHERE p.medicamento_origem = s.nome_normalizado) AS ja_processado
  FROM bulas_interacoes s WHERE {_ELIGIBLE}
    AND NOT EXISTS (SELECT 1 FROM registrados r WHERE r.medicamento_origem = s.nome_normalizado AND r.versao_processamento = 'v1.2')""")
def pending_sources(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    return runs.pending_sources(c.runs, c.source, "v1.2")


@query(f"""WITH {_REGISTERED}, novos AS (SELECT DISTINCT medicamento_origem, 'v1.2' AS versao_processamento FROM processamentos_interacoes)
  SELECT n.* FROM novos n WHERE NOT EXISTS (SELECT 1 FROM registrados r WHERE r.medicamento_origem = n.medicamento_origem AND r.versao_processamento = n.versao_processamento)""")
def append_new_versions(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    incoming = c.runs.select("medicamento_origem", F.lit("v1.2").alias("versao_processamento")).distinct()
    return writes.new_runs(runs.registered_runs(c.runs, c.source), incoming).select("medicamento_origem", "versao_processamento")


# ---------------------------------------------------------------- situation, coverage, answers


@query(f"WITH {_CURRENT}, {_SITUATION}, {_STATES} SELECT nome_normalizado, nome_exibicao, status_bula, tem_extracao, status_extracao, tem_texto, processamento_id, status_processamento, ultimo_status, tem_mencoes, tem_retirada, estado, conclusiva FROM estados")
def situation_state(spark: SparkSession, d: str) -> DataFrame:
    return answers.states(answers.Corpus.load(spark, d))


@query(f"""WITH {_CURRENT}, {_REGISTERED}, n AS (SELECT
    (SELECT count(*) FROM bulas_interacoes s JOIN bulas b USING (nome_normalizado) WHERE {_ELIGIBLE}) AS elegiveis,
    (SELECT count(*) FROM vigentes v WHERE v.status = 'CONCLUIDO_SEM_RELACOES' OR EXISTS (SELECT 1 FROM interacoes i WHERE i.processamento_id = v.id)) AS concluidas,
    (SELECT count(*) FROM registrados r WHERE r.status = 'REVISAO_NECESSARIA' AND NOT EXISTS (SELECT 1 FROM vigentes v WHERE v.medicamento_origem = r.medicamento_origem)) AS em_revisao)
  SELECT *, concluidas + em_revisao AS analisadas, elegiveis > 0 AND concluidas + em_revisao >= elegiveis AS corpus_completo,
    elegiveis > 0 AND concluidas + em_revisao >= elegiveis AND em_revisao = 0 AS lista_exaustiva FROM n""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return answers.coverage(answers.Corpus.load(spark, d))


@query(f"""WITH {_POSITIVE}, n AS (SELECT id, medicamento_origem, alvo, tipo_alvo, resumo,
      row_number() OVER (PARTITION BY medicamento_origem ORDER BY id) AS posicao, count(*) OVER (PARTITION BY medicamento_origem) AS total FROM positivas)
  SELECT *, CAST(ceil(total / 5) AS BIGINT) AS paginas FROM n WHERE posicao > 5 AND posicao <= 10""")
def single_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of five of every origin."""
    return answers.single_page(answers.Corpus.load(spark, d), None, 2, 5)


@query(f"""WITH {_POSITIVE}, {_SITUATION}, {_STATES}, n AS (SELECT medicamento_origem, count(*) AS relacoes, count(DISTINCT {_target("alvo")}) AS alvos FROM positivas GROUP BY 1)
  SELECT e.nome_normalizado, e.estado, coalesce(n.relacoes, 0) AS relacoes, coalesce(n.alvos, 0) AS alvos,
    CASE WHEN coalesce(n.alvos, 0) > 0 THEN true WHEN e.conclusiva THEN false END AS identificada
  FROM estados e LEFT JOIN n ON n.medicamento_origem = e.nome_normalizado""")
def single_answers(spark: SparkSession, d: str) -> DataFrame:
    return answers.single_answers(answers.Corpus.load(spark, d))


@query(f"""SELECT interacao_id, posicao, medicamento_relacionado, nome_exibicao, criterio_vinculo, total FROM (
    SELECT m.interacao_id, m.medicamento_relacionado, {_DISPLAY.format(t="b.")} AS nome_exibicao, m.criterio_vinculo,
      count(*) OVER (PARTITION BY m.interacao_id) AS total,
      row_number() OVER (PARTITION BY m.interacao_id ORDER BY m.medicamento_relacionado, m.criterio_vinculo NULLS FIRST) AS posicao
    FROM interacoes_medicamentos m JOIN bulas b ON b.nome_normalizado = m.medicamento_relacionado WHERE m.invalidado_em IS NULL) WHERE posicao <= 2""")
def related_topk(spark: SparkSession, d: str) -> DataFrame:
    return answers.related_topk(answers.Corpus.load(spark, d), 2)


@query(f"""WITH {_PAIRS}, primeiros AS (
      SELECT a, b, especie, sentido, medicamento_origem, processamento_id, {_quotation("evidencia")} AS q, {_fold("alvo")} AS fa, tipo_alvo, {_quotation("resumo")} AS r, criterio_vinculo, min(id) AS id
      FROM linhas GROUP BY ALL)
  SELECT a, b, especie, sentido, medicamento_origem, processamento_id, min(id) AS primeiro, count(*) AS itens, array_to_string(list_sort(list(id)), ',') AS ids
  FROM primeiros GROUP BY a, b, especie, sentido, medicamento_origem, processamento_id, q""")
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every pair that a current relation links, both directions in one plan."""
    c = answers.Corpus.load(spark, d)
    return answers.pair_evidence(c, answers.cited_pairs(c))


@query(f"""WITH {_PAIRS}, {_SITUATION}, {_STATES}, n AS (SELECT a, b, count(*) FILTER (WHERE especie = 'ESPECIFICA') AS especificas, count(*) FILTER (WHERE especie = 'ALERTA') AS alertas,
      count(*) FILTER (WHERE especie = 'MENCAO') AS mencoes FROM linhas GROUP BY 1, 2)
  SELECT p.a, p.b, coalesce(n.especificas, 0) AS especificas, coalesce(n.alertas, 0) AS alertas, coalesce(n.mencoes, 0) AS mencoes, x.conclusiva AND y.conclusiva AS completa,
    CASE WHEN coalesce(n.especificas, 0) > 0 THEN true WHEN coalesce(n.mencoes, 0) > 0 THEN NULL WHEN x.conclusiva AND y.conclusiva THEN false END AS identificada
  FROM pares p JOIN estados x ON x.nome_normalizado = p.a JOIN estados y ON y.nome_normalizado = p.b LEFT JOIN n ON n.a = p.a AND n.b = p.b""")
def pair_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = answers.Corpus.load(spark, d)
    return answers.pair_verdicts(c, answers.cited_pairs(c))


@query(f"""SELECT nome_normalizado, {_DISPLAY.format(t="")} AS nome_exibicao,
    CASE WHEN starts_with(nome_normalizado, 'ba') THEN 0 WHEN contains(nome_normalizado, ' ba') THEN 1 ELSE 2 END AS ordem
  FROM bulas WHERE status = 'CONCLUIDO' AND contains(nome_normalizado, 'ba') ORDER BY ordem, nome_normalizado LIMIT 20""")
def suggest_literal(spark: SparkSession, d: str) -> DataFrame:
    return answers.suggest(answers.Corpus.load(spark, d), "ba", 20)


@query("""WITH p AS (SELECT nome_normalizado, len(string_split(nome_normalizado, ' ')) AS palavras,
      list_min(flatten(list_transform(string_split(nome_normalizado, ' '), lambda w: list_transform(range(6, 11), lambda k: levenshtein(left(w, k), 'rerexamn'))))) AS distancia
    FROM bulas WHERE status = 'CONCLUIDO')
  SELECT nome_normalizado, distancia, palavras FROM p WHERE distancia <= 2 ORDER BY distancia, palavras, nome_normalizado LIMIT 10""")
def suggest_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return answers.suggest_fuzzy(answers.Corpus.load(spark, d), "rerexamn", 10)


@query(f"""WITH {_CURRENT}, n AS (SELECT interacao_id AS id, count(*) AS k, string_agg(medicamento_relacionado, ', ' ORDER BY medicamento_relacionado) AS nomes
      FROM interacoes_medicamentos WHERE invalidado_em IS NULL AND medicamento_relacionado IS NOT NULL GROUP BY 1)
  SELECT i.id, i.tipo_alvo, left(i.evidencia, 160) AS evidencia, coalesce(n.k, 0) AS vinculos_ativos, n.nomes AS medicamentos_relacionados
  FROM interacoes i JOIN vigentes v ON v.id = i.processamento_id LEFT JOIN n ON n.id = i.id""")
def relation_links_agg(spark: SparkSession, d: str) -> DataFrame:
    return answers.relation_links(answers.Corpus.load(spark, d))


@query(f"""WITH {_CURRENT} SELECT m.medicamento_relacionado, count(*) AS citacoes, count(DISTINCT i.medicamento_origem) AS origens
  FROM interacoes_medicamentos m JOIN interacoes i ON i.id = m.interacao_id JOIN vigentes v ON v.id = i.processamento_id WHERE m.invalidado_em IS NULL GROUP BY 1""")
def who_cites(spark: SparkSession, d: str) -> DataFrame:
    return answers.who_cites(answers.Corpus.load(spark, d))


@query(f"WITH {_CURRENT} SELECT i.id, contains(s.trecho_interacoes, i.evidencia) AS literal FROM vigentes v JOIN interacoes i ON i.processamento_id = v.id JOIN bulas_interacoes s ON s.nome_normalizado = v.medicamento_origem")
def literal_evidence(spark: SparkSession, d: str) -> DataFrame:
    return answers.literal_evidence(answers.Corpus.load(spark, d))


@query("SELECT interacao_id, medicamento_relacionado, criterio_vinculo, invalidado_em FROM interacoes_medicamentos WHERE invalidado_em IS NOT NULL")
def invalidated_links(spark: SparkSession, d: str) -> DataFrame:
    return answers.invalidated_links(answers.Corpus.load(spark, d))


# ---------------------------------------------------------------- metrics


@query("SELECT status, count(*) AS n, round(CAST(sum(tempo_total_segundos) * 1000 AS DOUBLE) / count(tempo_total_segundos)) / 1000 AS media, min(tempo_total_segundos) AS menor, max(tempo_total_segundos) AS maior FROM bulas GROUP BY 1")
def status_metrics(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("tempo_total_segundos")
    return table(spark, d, "bulas").groupBy("status").agg(F.count("*").alias("n"), (F.round((F.sum(seconds) * 1000).cast("double") / F.count(seconds)) / 1000).alias("media"), F.min(seconds).alias("menor"), F.max(seconds).alias("maior"))


@query("""SELECT modelo, status, count(*) AS execucoes, sum(chamadas_llm) AS chamadas, count(*) FILTER (WHERE quantidade_rejeicoes > 0) AS com_rejeicao,
    round(sum(quantidade_rejeicoes) / CAST(nullif(sum(quantidade_relacoes + quantidade_rejeicoes), 0) AS DOUBLE), 6) AS taxa, max(pico_memoria_mb) AS maior_memoria
  FROM processamentos_interacoes GROUP BY 1, 2""")
def call_metrics(spark: SparkSession, d: str) -> DataFrame:
    rate = F.try_divide(F.sum("quantidade_rejeicoes"), F.sum(F.col("quantidade_relacoes") + F.col("quantidade_rejeicoes")))
    return table(spark, d, "processamentos_interacoes").groupBy("modelo", "status").agg(
        F.count("*").alias("execucoes"), F.sum("chamadas_llm").alias("chamadas"), F.count_if(F.col("quantidade_rejeicoes") > 0).alias("com_rejeicao"),
        F.round(rate, 6).alias("taxa"), F.max("pico_memoria_mb").alias("maior_memoria"),
    )


@query("SELECT medicamento_origem, max(id) AS id, arg_max(status, id) AS status, arg_max(modelo, (concluido_em, lpad(CAST(id AS VARCHAR), 30, '0'))) AS modelo_recente FROM processamentos_interacoes GROUP BY 1")
def latest_composite(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("concluido_em", F.lpad(F.col("id").cast("string"), 30, "0"))
    return table(spark, d, "processamentos_interacoes").groupBy("medicamento_origem").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"), F.max_by("modelo", key).alias("modelo_recente"))


@query("SELECT id, json_extract_string(reescrita_controle, '$.publicado.status') AS publicado, coalesce(json_extract_string(reescrita_controle, '$.publicado.status') = 'CONCLUIDO', false) AS atual FROM interacoes")
def json_flags(spark: SparkSession, d: str) -> DataFrame:
    state = F.get_json_object("reescrita_controle", "$.publicado.status")
    return table(spark, d, "interacoes").select("id", state.alias("publicado"), F.coalesce(state == "CONCLUIDO", F.lit(False)).alias("atual"))


# ---------------------------------------------------------------- writes

_LINKS = """d AS (SELECT interacao_id, medicamento_relacionado, min(criterio) AS c FROM (
      SELECT i.id AS interacao_id, i.medicamento_origem AS medicamento_relacionado, 'NOME_MEDICAMENTO_EXATO' AS criterio FROM interacoes i
      UNION ALL SELECT m.interacao_id, m.medicamento_relacionado, 'PRINCIPIO_ATIVO_EXATO' FROM interacoes_medicamentos m WHERE m.criterio_vinculo IN ('PRINCIPIO_ATIVO_EXATO', 'PRINCIPIO_ATIVO_SEM_SAL')) GROUP BY 1, 2),
    e AS (SELECT interacao_id, medicamento_relacionado, criterio_vinculo, invalidado_em FROM (
      SELECT *, row_number() OVER (PARTITION BY interacao_id, medicamento_relacionado ORDER BY invalidado_em IS NOT NULL, coalesce(criterio_vinculo, ''), invalidado_em) AS rn FROM interacoes_medicamentos) WHERE rn = 1)"""


@query(f"""WITH {_LINKS}, r AS (SELECT coalesce(d.interacao_id, e.interacao_id) AS interacao_id, coalesce(d.medicamento_relacionado, e.medicamento_relacionado) AS medicamento_relacionado,
      CASE WHEN d.interacao_id IS NOT NULL THEN d.c ELSE e.criterio_vinculo END AS criterio_vinculo,
      CASE WHEN d.interacao_id IS NOT NULL AND e.interacao_id IS NULL THEN 'CRIAR' WHEN d.interacao_id IS NOT NULL AND e.invalidado_em IS NOT NULL THEN 'REATIVAR'
           WHEN d.interacao_id IS NOT NULL AND d.c IS DISTINCT FROM e.criterio_vinculo THEN 'ATUALIZAR' WHEN d.interacao_id IS NOT NULL THEN 'MANTER' WHEN e.invalidado_em IS NULL THEN 'INVALIDAR' END AS acao
    FROM d FULL JOIN e ON d.interacao_id = e.interacao_id AND d.medicamento_relacionado = e.medicamento_relacionado)
  SELECT * FROM r WHERE acao IS NOT NULL""")
def link_sync(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "interacoes_medicamentos")
    own = table(spark, d, "interacoes").select(F.col("id").alias("interacao_id"), F.col("medicamento_origem").alias("medicamento_relacionado"), F.lit("NOME_MEDICAMENTO_EXATO").alias("criterio_vinculo"))
    again = links.where(F.col("criterio_vinculo").isin("PRINCIPIO_ATIVO_EXATO", "PRINCIPIO_ATIVO_SEM_SAL")).select("interacao_id", "medicamento_relacionado", F.lit("PRINCIPIO_ATIVO_EXATO").alias("criterio_vinculo"))
    return writes.sync_links(own.unionByName(again), links)


@query("""WITH n AS (SELECT nome_normalizado, upper(status) || '_NOVO' AS status, coalesce(tentativas, 0) + 1 AS tentativas FROM bulas WHERE status <> 'SEM_BULA')
  SELECT b.nome_normalizado, CASE WHEN n.nome_normalizado IS NOT NULL AND b.status IN ('PENDENTE', 'ERRO') THEN n.status ELSE b.status END AS status,
    CASE WHEN n.nome_normalizado IS NOT NULL AND b.status IN ('PENDENTE', 'ERRO') THEN n.tentativas ELSE b.tentativas END AS tentativas FROM bulas b LEFT JOIN n USING (nome_normalizado)""")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas").select("nome_normalizado", "status", "tentativas")
    new = old.where("status <> 'SEM_BULA'").select("nome_normalizado", F.concat(F.upper("status"), F.lit("_NOVO")).alias("status"), (F.coalesce("tentativas", F.lit(0)) + 1).alias("tentativas"))
    return writes.guarded_upsert(old, new, "nome_normalizado", ["status", "tentativas"], F.col("o.status").isin("PENDENTE", "ERRO"))


@query("""SELECT b.nome_normalizado, CASE WHEN nullif(trim(b.principios_ativos, ' '), '') IS NULL THEN coalesce(b.nome_normalizado, b.principios_ativos) ELSE b.principios_ativos END AS principios_ativos FROM bulas b""")
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas").select("nome_normalizado", "principios_ativos")
    new = old.select("nome_normalizado", F.col("nome_normalizado").alias("principios_ativos"))
    return writes.fill_nulls(old, new, "nome_normalizado", ["principios_ativos"])


@query("SELECT evento, user_id, 1000 + row_number() OVER (ORDER BY user_id, evento) AS id FROM (SELECT event_id AS evento, user_id FROM events)")
def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    return writes.assign_ids(table(spark, d, "events").select(F.col("event_id").alias("evento"), "user_id"), ["user_id", "evento"], 1000)


@query("SELECT event_id AS id, 1 AS tentativas FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 50")
def queue_reserve(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("criado_em"), F.when(F.col("event_type") == "click", "PENDENTE").otherwise("FEITO").alias("estado"), F.lit(0).alias("tentativas"))
    return writes.reserve(queue, 50)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(invalidado_em, TIMESTAMP '2030-01-01') ELSE invalidado_em END AS invalidado_em FROM processamentos_interacoes")
def soft_invalidation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processamentos_interacoes")
    return writes.invalidate(rows, rows.where("id % 3 = 0").select("id"), F.expr("timestamp_ntz'2030-01-01 00:00:00'")).select("id", "invalidado_em")


# ---------------------------------------------------------------- audits


@query("SELECT interacao_id, medicamento_relacionado, count(*) AS n FROM interacoes_medicamentos GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, d, "interacoes_medicamentos"), ["interacao_id", "medicamento_relacionado"])


@query("SELECT m.medicamento_relacionado, count(*) AS n FROM interacoes_medicamentos m WHERE m.medicamento_relacionado IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bulas b WHERE b.nome_normalizado = m.medicamento_relacionado) GROUP BY 1")
def fk_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.orphans(table(spark, d, "interacoes_medicamentos"), "medicamento_relacionado", table(spark, d, "bulas"), "nome_normalizado")


@query("""SELECT id, regra FROM (SELECT id, unnest([
      CASE WHEN coalesce(janelas_concluidas >= 0 AND janelas_concluidas <= quantidade_janelas AND (janelas_concluidas = quantidade_janelas OR status = 'FALHA'), true) THEN NULL ELSE 'janelas' END,
      CASE WHEN coalesce(CASE WHEN status = 'CONCLUIDO_COM_RELACOES' THEN quantidade_relacoes > 0 WHEN status = 'CONCLUIDO_SEM_RELACOES' THEN quantidade_relacoes = 0 END, true) THEN NULL ELSE 'relacoes' END,
      CASE WHEN coalesce(status IN ('CONCLUIDO_COM_RELACOES', 'CONCLUIDO_SEM_RELACOES', 'REVISAO_NECESSARIA', 'FALHA'), true) THEN NULL ELSE 'status' END,
      CASE WHEN coalesce(trim(versao_processamento, ' ') <> '', true) THEN NULL ELSE 'versao' END]) AS regra FROM processamentos_interacoes) WHERE regra IS NOT NULL""")
def check_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.check_violations(table(spark, d, "processamentos_interacoes"), "id", run_checks())


@query("SELECT i.id, i.processamento_id FROM interacoes i JOIN processamentos_interacoes p ON p.id = i.processamento_id WHERE i.medicamento_origem IS DISTINCT FROM p.medicamento_origem")
def origin_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.origin_mismatches(table(spark, d, "interacoes"), table(spark, d, "processamentos_interacoes"))


@query("""WITH m AS (SELECT DISTINCT processamento_id, alvo, tipo_alvo FROM interacoes WHERE resumo_status = 'FALHA')
  SELECT i.id, i.processamento_id FROM interacoes i WHERE EXISTS (SELECT 1 FROM m WHERE m.processamento_id = i.processamento_id AND m.alvo = i.alvo AND m.tipo_alvo = i.tipo_alvo)""")
def invalidation_cascade(spark: SparkSession, d: str) -> DataFrame:
    relations = table(spark, d, "interacoes")
    return audit.invalidation_cascade(relations, relations.where("resumo_status = 'FALHA'"))


@query("""SELECT s.nome_normalizado FROM bulas_interacoes s WHERE length(s.trecho_interacoes) > 1500
  AND EXISTS (SELECT 1 FROM processamentos_interacoes p WHERE p.medicamento_origem = s.nome_normalizado AND p.invalidado_em IS NULL)""")
def source_protection(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "bulas_interacoes")
    new = old.withColumn("trecho_interacoes", F.when(F.length("trecho_interacoes") > 1500, F.concat("trecho_interacoes", F.lit("."))).otherwise(F.col("trecho_interacoes")))
    return audit.protected_sources(old, new, table(spark, d, "processamentos_interacoes"))


@query("""WITH h AS (SELECT md5(concat_ws(chr(31), coalesce(CAST(id AS VARCHAR), chr(0)), coalesce(status, chr(0)), coalesce(CAST(chamadas_llm AS VARCHAR), chr(0)))) AS m FROM processamentos_interacoes)
  SELECT count(*) AS linhas, sum(CAST(('0x' || left(m, 8)) AS BIGINT)) AS soma_a, sum(CAST(('0x' || substr(m, 9, 8)) AS BIGINT)) AS soma_b FROM h""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    sums = audit.table_fingerprint(table(spark, d, "processamentos_interacoes"), "id", ["status", "chamadas_llm"])
    return sums.select("linhas", F.col("soma_a").cast("long").alias("soma_a"), F.col("soma_b").cast("long").alias("soma_b"))


@query(f"SELECT status_extracao, count(*) AS fontes, count(*) FILTER (WHERE nullif(trim(trecho_interacoes, ' '), '') IS NOT NULL) AS com_texto FROM bulas_interacoes GROUP BY 1")
def source_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.eligible_share(table(spark, d, "bulas_interacoes"))


# ---------------------------------------------------------------- text


@query(f"SELECT id, {_fold('alvo')} AS nome, {_target('alvo')} AS alvo_normal, {_quotation('resumo')} AS chave FROM interacoes")
def name_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    return rows.select("id", text.fold_name(F.col("alvo")).alias("nome"), text.fold_target(F.col("alvo")).alias("alvo_normal"), text.quotation_key(F.col("resumo")).alias("chave"))


@query(f"""SELECT nome, count(*) AS vezes, arg_min(nome_anvisa, nome_normalizado) AS original FROM (
    SELECT {_fold('nome_anvisa')} AS nome, nome_anvisa, nome_normalizado FROM bulas WHERE nome_anvisa IS NOT NULL) WHERE nome <> '' GROUP BY 1""")
def import_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bulas").where(F.col("nome_anvisa").isNotNull()).withColumn("nome", text.fold_name(F.col("nome_anvisa"))).where("nome <> ''")
    return rows.groupBy("nome").agg(F.count("*").alias("vezes"), F.min_by("nome_anvisa", "nome_normalizado").alias("original"))


@query(f"SELECT id, len({_words(_fold('evidencia'))}) AS palavras, array_to_string({_RELEVANT.format(w=_words(_fold('alvo')))}, ' ') AS relevantes FROM interacoes")
def relevant_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    return rows.select("id", F.size(text.plain_words(text.fold_name(F.col("evidencia")))).alias("palavras"), F.array_join(text.relevant_words(text.fold_name(F.col("alvo"))), " ").alias("relevantes"))


@query(rf"""SELECT nome_normalizado, coalesce(nullif(left(s, 100), ''), left(sha256(nome_normalizado), 12)) AS slug FROM (
    SELECT nome_normalizado, regexp_replace(regexp_replace({_fold('nome_normalizado')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM bulas)""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bulas").select("nome_normalizado", text.slug(F.col("nome_normalizado")).alias("slug"))


@query(f"WITH j AS ({_not_positive('i.evidencia', 'i.alvo')}) SELECT id, nao_positiva FROM j")
def absence_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interacoes").select("id", rules.is_not_positive(F.col("evidencia"), F.col("alvo")).alias("nao_positiva"))





@query(f"""SELECT direcao, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(f, '{vocabulary.INCREASE}') THEN 'AUMENTO' WHEN regexp_matches(f, '{vocabulary.DECREASE}') THEN 'REDUCAO' ELSE 'OUTRO' END AS direcao
  FROM (SELECT {_fold('resumo')} AS f FROM interacoes)) GROUP BY 1""")
def effect_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interacoes").groupBy(rules.effect_direction(text.fold_name(F.col("resumo"))).alias("direcao")).agg(F.count("*").alias("n"))


@query("""SELECT molde, count(*) AS n, min(id) AS primeiro FROM (SELECT id, replace(lower(resumo), lower(alvo), '{alvo}') AS molde FROM interacoes
  WHERE length(alvo) > 0 AND (length(resumo) - length(replace(lower(resumo), lower(alvo), ''))) = length(alvo)) GROUP BY 1""")
def template_groups(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that differ only by their target, where the target occurs once."""
    low, target = F.lower("resumo"), F.lower("alvo")
    once = (F.length("alvo") > 0) & (F.length("resumo") - F.length(F.replace(low, target, F.lit(""))) == F.length("alvo"))
    rows = table(spark, d, "interacoes").where(once).select("id", F.replace(low, target, F.lit("{alvo}")).alias("molde"))
    return rows.groupBy("molde").agg(F.count("*").alias("n"), F.min("id").alias("primeiro"))



@query(r"""WITH s AS (SELECT nome_normalizado, trecho_interacoes AS t FROM bulas_interacoes WHERE nullif(trim(trecho_interacoes, ' '), '') IS NOT NULL),
    p AS (SELECT nome_normalizado, string_split(regexp_replace(regexp_replace(regexp_replace(t, '\n[ \t]*\n', chr(1), 'g'), '\n([ \t]*[-•▪●◦*])', chr(1) || '\1', 'g'),
      '([.;])\s+([A-ZÁÉÍÓÚÂÊÔÃÕÇ\d•▪●◦*-])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS v FROM s),
    n AS (SELECT nome_normalizado, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS trecho FROM p)
  SELECT nome_normalizado, trecho, trim(x, E' \n\r\t') AS texto FROM n WHERE trim(x, E' \n\r\t') <> ''""")
def text_passages(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "bulas_interacoes"), "nome_normalizado", "trecho_interacoes")



@query(rf"""SELECT id, regexp_matches(s, '{{a}}') AND NOT regexp_matches(e, '{{a}}') AS ausencia, regexp_matches(s, '{{b}}') AND NOT regexp_matches(e, '{{b}}') AS seguranca,
    regexp_matches(e, '\bpodem?\b') AND NOT regexp_matches(s, '\bpodem?\b|\bpossivel\b|\bpossibilidade\b|\bcostuma\b|\btende\b') AS certeza, regexp_matches(e, '\bnasal\b') AND NOT regexp_matches(s, '\bnasal\b') AS via_nasal
  FROM (SELECT id, {_fold('resumo')} AS s, {_fold('evidencia')} AS e FROM interacoes)""".replace("{a}", r"\bnao (?:ha|existe\w*|foram?) (?:\w+ )?(?:interac|estudos|relatos|dados)|\bdesconhec\w+").replace("{b}", r"\bsegur[oa]s?\b|\bsem risco\b|\bpode ser usad[oa] sem\b"))
def summary_grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    return rows.select("id", validate.grounding_flags(F.col("resumo"), F.col("evidencia")).alias("_f")).select("id", "_f.*")


@query("""WITH l AS (SELECT nome_normalizado, list_filter(string_split_regex(trecho_interacoes, '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS v FROM bulas_interacoes WHERE trecho_interacoes IS NOT NULL),
    u AS (SELECT nome_normalizado AS doc, unnest(v) AS texto, generate_subscripts(v, 1) - 1 AS n FROM l),
    t AS (SELECT *, regexp_replace(texto, '[^\\p{L}]', '', 'g') AS k FROM u),
    m AS (SELECT doc, n, texto, CASE WHEN length(texto) <= 110 AND NOT regexp_matches(texto, '[.;,:]$')
      AND ((length(k) >= 4 AND upper(k) = k) OR regexp_matches(texto, '^\\d{1,2}(?:\\.\\d{1,2})*[.)]?\\s+\\S')) THEN texto END AS titular FROM t)
  SELECT doc, n, texto, lag(texto) OVER w AS anterior, lead(texto) OVER w AS seguinte,
    last_value(titular IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS titulo
  FROM m WINDOW w AS (PARTITION BY doc ORDER BY n)""".replace("\\\\", "\\"))
def unit_context(spark: SparkSession, d: str) -> DataFrame:
    return validate.unit_context(_lines(spark, d), "doc", "n", "texto")








# ---------------------------------------------------------------- line documents and summaries


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return sections.line_table(table(spark, d, "bulas_interacoes"), "nome_normalizado", "trecho_interacoes")




@query(r"""WITH l AS (SELECT nome_normalizado AS doc, list_filter(string_split_regex(trecho_interacoes, '\r?\n'), lambda x: trim(x, ' ') <> '') AS v FROM bulas_interacoes WHERE trecho_interacoes IS NOT NULL)
  SELECT doc, len(v) AS linhas, list_max(list_transform(v, lambda x: length(x))) AS maior FROM l WHERE len(v) > 0""")
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc").agg(F.count("*").alias("linhas"), F.max(F.length("texto")).alias("maior"))


def _composition(spark: SparkSession, d: str) -> DataFrame:
    values = packed.unpack(table(spark, d, "bulas"), "nome_normalizado", ["composicao"])
    return composition.classify(values, "nome_normalizado", "posicao", "valor")


@query()
def composition_roles(spark: SparkSession, d: str) -> DataFrame:
    return _composition(spark, d)


@query()
def active_ingredients(spark: SparkSession, d: str) -> DataFrame:
    return composition.active_ingredients(_composition(spark, d), "nome_normalizado", "posicao")


@query()
def unnamed_actives(spark: SparkSession, d: str) -> DataFrame:
    """Active values of the composition that the registry's ingredient list does not name."""
    names = packed.unpack(table(spark, d, "bulas"), "nome_normalizado", ["principios_ativos"]).select("nome_normalizado", "valor")
    return composition.unnamed_actives(_composition(spark, d), "nome_normalizado", names, "valor")


_ABOUT = f"""(SELECT *, CASE WHEN len(citam) > 0 THEN citam ELSE [f] END AS proprias FROM (SELECT *, list_filter({_CLAUSES.format(x='f', end=vocabulary.CLAUSE_END)}, lambda c: (len({_words('t')}) > 0 AND contains({_padded('c')}, {_padded('t')}))
    OR (len({_RELEVANT.format(w=_words('t'))}) > 0 AND len(list_filter({_RELEVANT.format(w=_words('t'))}, lambda w: NOT contains({_padded('c')}, {_padded('w')}))) = 0)) AS citam
  FROM (SELECT id, processamento_id, evidencia, resumo_card, {_fold('evidencia')} AS f, {_target('alvo')} AS t FROM interacoes WHERE evidencia IS NOT NULL AND alvo IS NOT NULL)))"""


@query(f"""WITH p AS (SELECT *, array_to_string(proprias, chr(31)) AS o, array_to_string(proprias, ' ') AS texto, coalesce(nullif(trim(resumo_card, ' '), '') IS NOT NULL, false) AS card FROM {_ABOUT}),
    d AS (SELECT *, regexp_extract_all(CASE WHEN instr(texto, t) > 1 THEN substr(texto, 1, instr(texto, t) - 1) ELSE '' END, '{vocabulary.INCREASE}|{vocabulary.DECREASE}') AS v FROM p),
    k AS (SELECT *, CASE WHEN len(v) = 0 THEN '' WHEN regexp_matches(v[len(v)], '{vocabulary.INCREASE}') THEN 'AUMENTO' ELSE 'REDUCAO' END AS direcao FROM d),
    n AS (SELECT *, count(*) OVER (PARTITION BY processamento_id, evidencia, o) AS iguais, count(*) FILTER (WHERE card) OVER (PARTITION BY processamento_id, evidencia, texto, direcao) AS cards, count(*) OVER (PARTITION BY processamento_id, evidencia, texto, direcao) AS grupo FROM k)
  SELECT id, CASE WHEN length(evidencia) <= 400 AND length(evidencia) - length(replace(evidencia, ',', '')) < 4 AND iguais = 1 THEN 'LITERAL' WHEN grupo > 1 AND cards - CAST(card AS INTEGER) > 0 THEN 'REAPROVEITADO' ELSE 'GERADO' END AS origem FROM n""")
def card_origins(spark: SparkSession, d: str) -> DataFrame:
    return summaries.card_origins(table(spark, d, "interacoes"))


@query()
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries.merged_lines(table(spark, d, "interacoes"))
    return rows.withColumn("paragrafo", summaries.effect_paragraph(F.col("linha")))


@query("""SELECT processamento_id, alvo, tipo_alvo, min(id) AS lider, count(*) AS registros,
    count(*) FILTER (WHERE coalesce(json_extract_string(reescrita_controle, '$.publicado.status') <> 'CONCLUIDO', true) OR nullif(trim(resumo_card_simples, ' '), '') IS NULL) AS pendentes
  FROM interacoes WHERE nullif(trim(resumo_card, ' '), '') IS NOT NULL GROUP BY 1, 2, 3""")
def rewrite_units(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rewrite_units(table(spark, d, "interacoes"))


@query("""WITH m AS (SELECT user_id, event_type, event_id AS ini, event_id + CAST(floor(value) AS BIGINT) % 50 AS fim FROM events)
  SELECT user_id, event_type, ini, fim FROM (SELECT *, max(fim) OVER (PARTITION BY user_id, event_type ORDER BY ini, fim DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM m) WHERE mx IS NULL OR fim > mx""")
def consolidated_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("ini"), (F.col("event_id") + F.floor("value") % 50).alias("fim"))
    kept = summaries.consolidated(rows.withColumn("_x", F.col("ini").cast("string")), ["user_id", "event_type"], "ini", "fim", "_x")
    return kept.drop("_x")


@query(rf"""SELECT id, NOT length(trim(t, ' ')) BETWEEN 40 AND 600 AS tamanho, regexp_matches(t, '(?m)^\s*(?:[-*•]|\d+[.)])\s') AS lista, regexp_matches(t, '^\s*[\[{{]') AS json, len(g) - len(list_distinct(g)) >= 2 AS repeticao, NOT regexp_matches(trim(t, ' '), '[.!?)…]$') AS sem_fim
  FROM (SELECT id, t, list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT id, resumo_card_simples AS t, {_words(_fold('resumo_card_simples'))} AS w FROM interacoes WHERE resumo_card_simples IS NOT NULL))""")
def response_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes").where(F.col("resumo_card_simples").isNotNull())
    return rows.select("id", summaries.response_flags(F.col("resumo_card_simples")).alias("_f")).select("id", "_f.*")


@query("""SELECT id, coalesce(nullif(trim(resumo_card_simples, ' '), '') IS NOT NULL AND json_extract_string(reescrita_controle, '$.publicado.status') = 'CONCLUIDO'
    AND coalesce(json_extract_string(reescrita_controle, '$.entrada_invalidada') <> 'true', true), false) AS atual FROM interacoes""")
def plain_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    return rows.select("id", summaries.plain_is_current(F.col("resumo_card_simples"), F.col("reescrita_controle"), F.sha2("evidencia", 256)).alias("atual"))


@query("""SELECT id, controle, sha256(controle) AS hash FROM (SELECT id, CAST(json_merge_patch(coalesce(nullif(reescrita_controle, ''), '{}'), '{"entrada_invalidada":null,"ultima_tentativa":{"status":"PENDENTE"}}') AS VARCHAR) AS controle FROM interacoes)""")
def control_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    merged = summaries.json_merge(F.col("reescrita_controle"), F.lit('{"ultima_tentativa":{"status":"PENDENTE"}}'))
    return rows.select("id", merged.alias("controle")).withColumn("hash", summaries.canonical_hash("controle"))


# ---------------------------------------------------------------- chunks and vectors


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 64 THEN 1 ELSE CAST(ceil((len(w) - 64) / 48.0) AS BIGINT) + 1 END)) AS chunk_index FROM w WHERE len(w) > 0)
  SELECT doc_id, chunk_index, len(w[chunk_index * 48 + 1 : chunk_index * 48 + 64]) AS tokens FROM n""".replace("\\\\", "\\"))
def chunks_sliding(spark: SparkSession, d: str) -> DataFrame:
    return chunks.sliding_chunks(table(spark, d, "documents"), "doc_id", "text", 64, 16).select("doc_id", "chunk_index", "tokens")


@query("SELECT id, sha256(concat_ws(chr(31), nome_normalizado, CAST(chunk_index AS VARCHAR), texto_chunk)) AS hash FROM bulas_interacoes_embeddings")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bulas_interacoes_embeddings").select("id", chunks.chunk_hash(F.col("nome_normalizado"), F.col("chunk_index"), F.col("texto_chunk")).alias("hash"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norma FROM embeddings")
def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(chunks.norm(F.col("embedding")), 4).alias("norma"))


@query("""SELECT id, CASE WHEN embedding IS NULL THEN 'NULO' WHEN len(embedding) <> 384 THEN 'DIMENSAO' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'NAO_FINITO'
    WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'ZERO' ELSE 'OK' END AS estado FROM bulas_interacoes_embeddings""")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bulas_interacoes_embeddings").select("id", chunks.vector_state(F.col("embedding"), 384).alias("estado"))


@query("""SELECT s.nome_normalizado, coalesce(count(DISTINCT c.chunk_index), 0) AS blocos, coalesce(max(c.chunk_index) + 1 = count(DISTINCT c.chunk_index), false) AS continuo
  FROM (SELECT DISTINCT nome_normalizado FROM bulas_interacoes) s LEFT JOIN bulas_interacoes_embeddings c USING (nome_normalizado) GROUP BY 1""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_coverage(table(spark, d, "bulas_interacoes_embeddings"), table(spark, d, "bulas_interacoes"))


@query("""SELECT label, i AS posicao, round(avg(CAST(x AS DOUBLE)), 5) AS media FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    means = chunks.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("media").alias("posicao", "_m")).select("label", "posicao", F.round("_m", 5).alias("media"))


@query(r"""WITH p AS (SELECT nome_normalizado, trecho, trim(x, E' \n\r\t') AS texto FROM (SELECT nome_normalizado, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS trecho FROM (
      SELECT nome_normalizado, string_split(regexp_replace(regexp_replace(regexp_replace(trecho_interacoes, '\n[ \t]*\n', chr(1), 'g'), '\n([ \t]*[-•▪●◦*])', chr(1) || '\1', 'g'), '([.;])\s+([A-ZÁÉÍÓÚÂÊÔÃÕÇ\d•▪●◦*-])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS v
      FROM bulas_interacoes WHERE nullif(trim(trecho_interacoes, ' '), '') IS NOT NULL)) WHERE trim(x, E' \n\r\t') <> ''),
    n AS (SELECT nome_normalizado, trecho, len(string_split_regex(texto, '\s+')) AS n, row_number() OVER (PARTITION BY nome_normalizado ORDER BY trecho) - 1 AS i FROM p),
    l AS (SELECT nome_normalizado, list({'n': n, 'soma': n, 'i': i, 'cortes': [i]} ORDER BY i) AS l FROM n GROUP BY 1)
  SELECT nome_normalizado, len(l) AS trechos, array_to_string(list_reduce(l, lambda a, x: {'n': x.n, 'soma': CASE WHEN a.soma + x.n > 120 THEN x.n ELSE a.soma + x.n END, 'i': x.i, 'cortes': CASE WHEN a.soma + x.n > 120 THEN list_concat(a.cortes, [x.i]) ELSE a.cortes END}).cortes, ',') AS inicios FROM l""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Passages of each text packed in order into windows of 120 words."""
    parts = passages.passages(table(spark, d, "bulas_interacoes"), "nome_normalizado", "trecho_interacoes")
    sizes = parts.select("nome_normalizado", "trecho", F.size(F.split("texto", r"\s+")).alias("_n"))
    listed = sizes.groupBy("nome_normalizado").agg(F.array_sort(F.collect_list(F.struct("trecho", "_n"))).alias("_l"))
    cuts = chunks.token_windows(F.transform("_l", lambda x: x["_n"]), 120)
    return listed.select("nome_normalizado", F.size("_l").alias("trechos"), F.array_join(cuts, ",").alias("inicios"))


# The other modules register theirs in the same tables.
from marisma import queries_identify, queries_history, queries_texts  # noqa: E402, F401, I001


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
