"""Registered queries of identification, resolution and summary rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import rules, text, vocabulary
from marisma.operators import catalog, identify, passages, validate
from marisma.plans import runs
from marisma.queries import _CLAUSES, _DEHYPHEN, _RELEVANT, _fold, _padded, _target, _words, query
from marisma.session import spread, table

# ---------------------------------------------------------------- SQL of the catalogue


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _kw(x: str) -> str:
    return f"array_to_string({_words(x)}, ' ')"


def _bare(k: str) -> str:
    b = f"regexp_replace({k}, '{vocabulary.SALT_BEFORE}', '')"
    for _ in range(4):
        b = f"regexp_replace({b}, '{vocabulary.SALT_AFTER}', '')"
    return b


_NOTE = r"^([^()]+?)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*$"
_ENTRIES = rf"""ingredientes AS (SELECT nome_normalizado, x, unnest([{_target('x')}, {_target(f"coalesce(nullif(regexp_extract(trim(x, ' '), '{_NOTE}', 1), ''), x)")}]) AS k
      FROM (SELECT nome_normalizado, unnest(list_filter(list_transform(string_split(coalesce(principios_ativos, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS x FROM bulas)),
    chaves AS (SELECT DISTINCT nome_normalizado, x, k FROM (SELECT nome_normalizado, x, {_kw("unnest([k, CASE WHEN length(k) > 5 THEN regexp_replace(k, '[ ]* base$', '') ELSE k END])")} AS k FROM ingredientes) WHERE k <> ''),
    semsal AS (SELECT *, CASE WHEN length(b) >= 4 AND b NOT IN {_list(vocabulary.ANIONS)} THEN b ELSE k END AS s FROM (SELECT *, {_bare('k')} AS b FROM chaves)),
    nomes_k AS (SELECT DISTINCT nome_normalizado, k FROM (SELECT nome_normalizado, unnest([{_kw(_target('nome_normalizado'))}, {_kw(_target("coalesce(nome_anvisa, '')"))}]) AS k FROM bulas) WHERE k <> ''),
    termos AS (SELECT termo, CASE WHEN max(p) = 1 THEN 'PRINCIPIO_ATIVO' ELSE 'MEDICAMENTO' END AS tipo
      FROM (SELECT k AS termo, 0 AS p FROM nomes_k UNION ALL SELECT k, 1 FROM semsal UNION ALL SELECT s, 1 FROM semsal) WHERE length(termo) >= 3 AND NOT regexp_matches(termo, '^[0-9 ]+$') GROUP BY 1),
    termos_b AS (SELECT *, CASE WHEN length(b) >= 4 AND b NOT IN {_list(vocabulary.ANIONS)} THEN b ELSE termo END AS s FROM (SELECT *, {_bare('termo')} AS b FROM termos)),
    entradas AS (SELECT k AS termo, 'MEDICAMENTO' AS tipo, nome_normalizado FROM nomes_k UNION SELECT k, 'PRINCIPIO_ATIVO', nome_normalizado FROM semsal
      UNION SELECT t.termo, t.tipo, e.nome_normalizado FROM termos_b t JOIN semsal e ON e.s = t.s WHERE t.tipo = 'PRINCIPIO_ATIVO'),
    proprias AS (SELECT b.nome_normalizado, coalesce(list_sort(list(DISTINCT m.s) FILTER (WHERE m.s IS NOT NULL)), []) AS so FROM bulas b
      LEFT JOIN (SELECT nome_normalizado, x, arg_min(s, (length(k), k)) AS s FROM semsal GROUP BY 1, 2) m USING (nome_normalizado) GROUP BY 1)"""

_PASSAGES = r"""trechos AS (SELECT nome_normalizado, trecho, trim(x, E' \n\r\t') AS texto FROM (
      SELECT nome_normalizado, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS trecho FROM (
        SELECT nome_normalizado, string_split(regexp_replace(regexp_replace(regexp_replace(trecho_interacoes, '\n[ \t]*\n', chr(1), 'g'), '\n([ \t]*[-•▪●◦*])', chr(1) || '\1', 'g'),
          '([.;])\s+([A-ZÁÉÍÓÚÂÊÔÃÕÇ\d•▪●◦*-])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS v FROM bulas_interacoes WHERE nullif(trim(trecho_interacoes, ' '), '') IS NOT NULL)) WHERE trim(x, E' \n\r\t') <> '')"""
_MATCHES = f"""{_ENTRIES}, {_PASSAGES},
    palavras_t AS (SELECT nome_normalizado, trecho, {_words(_fold(_DEHYPHEN.format(x="texto")))} AS w FROM trechos),
    candidatos AS (SELECT p.nome_normalizado, p.trecho, p.i AS inicio, p.n AS palavras, t.termo, t.tipo
      FROM (SELECT *, unnest(range(1, least(16, len(w) - i) + 1)) AS n FROM (SELECT *, unnest(range(0, len(w))) AS i FROM palavras_t)) p JOIN termos t ON t.termo = array_to_string(w[i + 1 : i + n], ' ')),
    maiores AS (SELECT * FROM candidatos QUALIFY row_number() OVER (PARTITION BY nome_normalizado, trecho, inicio ORDER BY palavras DESC) = 1),
    ligados AS (SELECT a.*, min(b.inicio) AS prox, row_number() OVER (PARTITION BY a.nome_normalizado, a.trecho ORDER BY a.inicio) = 1 AS primeiro FROM maiores a
      LEFT JOIN maiores b ON b.nome_normalizado = a.nome_normalizado AND b.trecho = a.trecho AND b.inicio >= a.inicio + a.palavras GROUP BY a.nome_normalizado, a.trecho, a.inicio, a.palavras, a.termo, a.tipo),
    achados AS (SELECT nome_normalizado, trecho, inicio, palavras, termo, tipo, prox FROM ligados WHERE primeiro
      UNION ALL SELECT l.nome_normalizado, l.trecho, l.inicio, l.palavras, l.termo, l.tipo, l.prox FROM achados r JOIN ligados l ON l.nome_normalizado = r.nome_normalizado AND l.trecho = r.trecho AND l.inicio = r.prox)"""

_LETTER = f"A-Za-z0-9{text._ACCENTED}{text._ACCENTED.upper()}"
_DENIES = f"{vocabulary.ABSENCE}|{vocabulary.EXTRA_ABSENCE}"
_MENTIONS = rf"""{_MATCHES},
    lidos AS (SELECT a.*, t.texto, {_fold(_DEHYPHEN.format(x="t.texto"))} AS f, string_split(regexp_replace({_fold(_DEHYPHEN.format(x="t.texto"))}, '([a-z0-9]+)', chr(1) || '\1', 'g'), chr(1)) AS p,
      string_split(regexp_replace({_DEHYPHEN.format(x="t.texto")}, '([{_LETTER}][{_LETTER}\p{{M}}]*)', chr(1) || '\1', 'g'), chr(1)) AS o FROM achados a JOIN trechos t USING (nome_normalizado, trecho)),
    partes AS (SELECT *, array_to_string(p[1 : inicio + 1], '') AS antes, array_to_string(p[inicio + 2 : len(p)], '') AS resto, {_words('f')} AS w,
      length(regexp_replace(array_to_string(p[inicio + 2 : inicio + palavras + 1], ''), '[^a-z0-9]+$', '')) AS tam,
      regexp_replace(array_to_string(o[inicio + 2 : inicio + palavras + 1], ''), '[^{_LETTER}\p{{M}}]+$', '') AS escrito FROM lidos),
    oracoes AS (SELECT *, right(regexp_replace(antes, '(?s)^.*(?:{vocabulary.CLAUSE_END})', ''), 250) || left(coalesce(nullif(regexp_extract(resto, '(?s)^(.*?(?:{vocabulary.CLAUSE_END}))', 1), ''), resto), tam + 250) AS oracao,
      trim(regexp_replace(escrito, '\s+', ' ', 'g')) AS mostrado FROM partes),
    juizo AS (SELECT q.nome_normalizado, q.termo, q.tipo, count(e.nome_normalizado) > 0 AS outros, any_value(s.so) AS so,
        coalesce(any_value(len(s.so)) > 0 AND bool_and(len(se.so) > 0 AND list_has_all(s.so, se.so)), false) AS mesma
      FROM (SELECT DISTINCT nome_normalizado, termo, tipo FROM achados) q LEFT JOIN proprias s ON s.nome_normalizado = q.nome_normalizado
      LEFT JOIN entradas e ON e.termo = q.termo AND e.tipo = q.tipo AND e.nome_normalizado <> q.nome_normalizado LEFT JOIN proprias se ON se.nome_normalizado = e.nome_normalizado GROUP BY 1, 2, 3),
    proprios AS (SELECT nome_normalizado, list(string_split(k, ' ')) AS nomes FROM (SELECT nome_normalizado, k FROM nomes_k UNION SELECT nome_normalizado, k FROM chaves) GROUP BY 1),
    mencoes AS (SELECT o.nome_normalizado, trecho, inicio, palavras, o.termo, o.tipo, texto,
      CASE WHEN len(o) = len(p) AND {_kw(_target('mostrado'))} = o.termo THEN mostrado ELSE o.termo END AS alvo,
      CASE WHEN o.termo IN {_list(identify.ignored_terms())} THEN ['ALVO_GENERICO', 'Termo da lista de ignorados.']
        WHEN len(list_filter(coalesce(n.nomes, []), lambda x: list_has_all(x, string_split(o.termo, ' ')))) > 0 THEN ['ALVO_E_ORIGEM', 'Nome da própria origem.']
        WHEN len(list_filter(coalesce(j.so, []), lambda s: len(list_filter({list(vocabulary.ENANTIOMER_PREFIXES)!r}, lambda x: x || s = o.termo OR x || o.termo = s)) > 0)) > 0 THEN ['ALVO_E_ORIGEM', 'Enantiômero ou racemato da origem.']
        WHEN regexp_matches(f, '{vocabulary.EXCIPIENTS}') THEN ['ALVO_GENERICO', 'Aviso de excipientes.']
        WHEN regexp_matches(antes, '{vocabulary.EXCEPTION}[^:;.()]*$') THEN ['RELACAO_NAO_POSITIVA', 'Citado como exceção.']
        WHEN o.termo IN {_list(vocabulary.CONTEXTUAL)} AND (list_has_any(w[greatest(1, inicio - 3) : inicio], {list(vocabulary.CONTEXT_BEFORE)!r}) OR coalesce(w[inicio + palavras + 1] IN {_list(vocabulary.CONTEXT_AFTER)}, false)) THEN ['ALVO_GENERICO', 'Parâmetro do organismo.']
        WHEN regexp_matches(oracao, '{_q(_DENIES)}') THEN ['RELACAO_NAO_POSITIVA', 'Interação negada na oração.']
        WHEN NOT coalesce(j.outros, false) THEN ['ALVO_INVALIDO', 'Nenhuma entrada além da origem.']
        WHEN j.mesma THEN ['ALVO_E_ORIGEM', 'Outro nome da substância da origem.'] END AS v
      FROM oracoes o LEFT JOIN proprios n ON n.nome_normalizado = o.nome_normalizado LEFT JOIN juizo j ON j.nome_normalizado = o.nome_normalizado AND j.termo = o.termo AND j.tipo = o.tipo
      WHERE length(o.termo) >= 4 OR (len(o) = len(p) AND escrito = upper(escrito) AND regexp_matches(escrito, '\p{{L}}')
        AND length(regexp_replace(texto, '[^\p{{Lu}}]', '', 'g')) <= 0.6 * length(regexp_replace(texto, '[^\p{{L}}]', '', 'g'))))"""
_COMPACT = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[-•▪●◦* ]+|[-•▪●◦* ]+$', '', 'g')"
_ACCEPTED = rf"""{_MENTIONS}, aceitas AS (SELECT *, lower({_COMPACT.format(x='texto')}) AS q FROM mencoes WHERE v IS NULL),
    primeiras AS (SELECT nome_normalizado, termo, tipo, q, arg_min({{'trecho': trecho, 'inicio': inicio, 'alvo': alvo, 'evidencia': texto}}, (trecho, inicio)) AS m FROM aceitas GROUP BY 1, 2, 3, 4),
    relacoes AS (SELECT nome_normalizado, termo, m.alvo AS alvo, tipo AS tipo_alvo, m.trecho AS trecho, m.evidencia AS evidencia, q, row_number() OVER (PARTITION BY nome_normalizado, termo ORDER BY m.trecho, m.inicio) AS ordem FROM primeiras QUALIFY ordem <= 3)"""
_SUMMARY = rf"""(SELECT *, CASE WHEN length(r) > 300 THEN regexp_replace(CASE WHEN contains(left(r, 299), ' ') THEN regexp_replace(left(r, 299), '(?s)\s[^\s]*$', '') ELSE left(r, 299) END, '[ ,;:]+$', '') || '…' ELSE r END AS resumo
      FROM (SELECT *, coalesce(nullif({_COMPACT.format(x="CASE WHEN c > 0 AND c <= 161 AND a > 0 AND a < c AND length(regexp_replace(d, '[^\\p{L}\\p{N}_]', '', 'g')) >= 10 THEN d ELSE evidencia END".replace(chr(92) * 2, chr(92)))}, ''), {_COMPACT.format(x='evidencia')}) AS r
        FROM (SELECT *, instr(evidencia, ':') AS c, instr(evidencia, alvo) AS a, substr(evidencia, instr(evidencia, ':') + 1) AS d FROM relacoes)))"""


# ---------------------------------------------------------------- identification


@query(f"WITH {_ENTRIES} SELECT termo, tipo FROM termos")
def dictionary_terms(spark: SparkSession, d: str) -> DataFrame:
    return catalog.terms(table(spark, d, "bulas"))


@query(f"WITH {_ENTRIES} SELECT nome_normalizado, array_to_string(so, ';') AS substancias FROM proprias")
def entry_substances(spark: SparkSession, d: str) -> DataFrame:
    return catalog.substances(table(spark, d, "bulas")).select("nome_normalizado", F.array_join("substancias", ";").alias("substancias"))


@query(f"WITH RECURSIVE {_MATCHES} SELECT nome_normalizado, trecho, inicio, palavras, termo, tipo FROM achados")
def dictionary_matches(spark: SparkSession, d: str) -> DataFrame:
    source = spread(table(spark, d, "bulas_interacoes").select("nome_normalizado", "trecho_interacoes"))
    parts = passages.passages(source, "nome_normalizado", "trecho_interacoes")
    return identify.dictionary_matches(parts, "nome_normalizado", catalog.terms(table(spark, d, "bulas")))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return identify.identify(table(spark, d, "bulas_interacoes"), table(spark, d, "bulas"))


@query(f"WITH RECURSIVE {_MENTIONS} SELECT nome_normalizado, trecho, inicio, palavras, termo, tipo, alvo, v[1] AS motivo, v[2] AS detalhe FROM mencoes")
def identified_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).drop("texto")


@query(f"WITH RECURSIVE {_ACCEPTED} SELECT nome_normalizado, termo, alvo, tipo_alvo, trecho, ordem, evidencia, resumo FROM {_SUMMARY}")
def identified_relations(spark: SparkSession, d: str) -> DataFrame:
    return identify.relations(_found(spark, d))


@query(f"WITH RECURSIVE {_ACCEPTED} SELECT nome_normalizado, termo, ordem, true AS no_texto, true AS cita FROM relacoes")
def evidence_cut(spark: SparkSession, d: str) -> DataFrame:
    """Whether the evidence of each relation stands in its source, and the target in the evidence."""
    rows = identify.relations(_found(spark, d)).join(table(spark, d, "bulas_interacoes").select("nome_normalizado", "trecho_interacoes"), "nome_normalizado")
    words = text.plain_words(text.fold_name(F.regexp_replace("evidencia", identify._HYPHENATED, "")))
    cited = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(F.concat(F.lit(" "), "termo", F.lit(" ")))
    return rows.select("nome_normalizado", "termo", "ordem", (F.instr("trecho_interacoes", F.col("evidencia")) > 0).alias("no_texto"), cited.alias("cita"))


@query(f"""WITH RECURSIVE {_ACCEPTED}, c AS (SELECT nome_normalizado, count(*) AS n FROM relacoes GROUP BY 1),
    o AS (SELECT a.nome_normalizado, count(*) AS n FROM aceitas a WHERE NOT EXISTS (SELECT 1 FROM relacoes r WHERE r.nome_normalizado = a.nome_normalizado AND r.termo = a.termo AND r.q = a.q) GROUP BY 1)
  SELECT s.nome_normalizado, CASE WHEN nullif(trim(s.trecho_interacoes, ' '), '') IS NULL THEN 'FALHA' WHEN c.n IS NULL THEN 'CONCLUIDO_SEM_RELACOES' ELSE 'CONCLUIDO_COM_RELACOES' END AS status,
    coalesce(c.n, 0) AS relacoes, CASE WHEN o.n > 0 THEN o.n || ' ocorrência(s) além de 3 trechos por nome.' END AS aviso
  FROM bulas_interacoes s LEFT JOIN c USING (nome_normalizado) LEFT JOIN o USING (nome_normalizado)""")
def identification_status(spark: SparkSession, d: str) -> DataFrame:
    return identify.run_status(table(spark, d, "bulas_interacoes"), identify.counts(_found(spark, d)))


@query(f"WITH RECURSIVE {_MENTIONS} SELECT coalesce(v[1], 'ACEITO') AS motivo, count(*) AS n FROM mencoes GROUP BY 1")
def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy(F.coalesce("motivo", F.lit("ACEITO")).alias("motivo")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_MENTIONS} SELECT nome_normalizado, v[1] AS motivo, termo, v[2] AS detalhe, arg_min(tipo, (trecho, inicio)) AS tipo, min(trecho) AS trecho FROM mencoes WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4")
def stored_rejections(spark: SparkSession, d: str) -> DataFrame:
    return identify.rejections(_found(spark, d))


@query(f"""WITH {_ENTRIES}, a AS (SELECT id, medicamento_origem, {_kw(_target('alvo'))} AS k FROM interacoes),
    b AS (SELECT *, CASE WHEN length(b) >= 4 AND b NOT IN {_list(vocabulary.ANIONS)} THEN b ELSE k END AS s FROM (SELECT *, {_bare('k')} AS b FROM a)),
    m AS (SELECT b.id, n.nome_normalizado, b.medicamento_origem, 0 AS p FROM b JOIN nomes_k n ON n.k = b.k UNION ALL SELECT b.id, e.nome_normalizado, b.medicamento_origem, 1 FROM b JOIN chaves e ON e.k = b.k
      UNION ALL SELECT b.id, e.nome_normalizado, b.medicamento_origem, 3 FROM b JOIN semsal e ON e.s = b.s)
  SELECT id, nome_normalizado AS medicamento_relacionado, CASE min(p) WHEN 0 THEN 'NOME_MEDICAMENTO_EXATO' WHEN 1 THEN 'PRINCIPIO_ATIVO_EXATO' ELSE 'PRINCIPIO_ATIVO_SEM_SAL' END AS criterio_vinculo
  FROM m WHERE nome_normalizado <> coalesce(medicamento_origem, '') GROUP BY 1, 2""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes").select("id", "medicamento_origem", "alvo")
    return catalog.resolve(rows, table(spark, d, "bulas"), "alvo", "medicamento_origem").select("id", "medicamento_relacionado", "criterio_vinculo")


@query(f"""WITH {_ENTRIES}, l AS (SELECT DISTINCT termo || chr(9) || tipo AS l FROM termos), p AS (SELECT left(sha256(l), 2) AS p, sha256(array_to_string(list_sort(list(l)), E'\\n')) AS h FROM l GROUP BY 1)
  SELECT sha256(array_to_string(list_sort(list(p || h)), E'\\n')) AS versao FROM p""")
def version_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return runs.version_fingerprint(catalog.terms(table(spark, d, "bulas")), F.col("termo"), F.col("tipo"))


# ---------------------------------------------------------------- rules on summaries

_NUMBERS = r"list_distinct(list_transform(regexp_extract_all({f}, '{p}', 0), lambda m: replace(regexp_extract(m, '\d+(?:[.,]\d+)?'), '.', ',')))"
# The SQL engine has no look-ahead: the letter that must not follow is read instead.
_QUANTITY = _q(vocabulary.QUANTITY.replace("(?![a-z])", "(?:[^a-z]|$)"))
_NEEDED = _NUMBERS.format(f="{f}", p=_QUANTITY)
_SAID = _NUMBERS.format(f="{f}", p=r"\d+(?:[.,]\d+)?")


@query(f"SELECT id, array_to_string(list_sort({_NEEDED.format(f='e')}), ' ') AS quantidades FROM (SELECT id, {_fold('evidencia')} AS e FROM interacoes)")
def evidence_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Doses, quantities and frequencies of each evidence."""
    amounts = F.array_sort(rules.amounts(text.fold_name(F.col("evidencia"))))
    return table(spark, d, "interacoes").select("id", F.array_join(amounts, " ").alias("quantidades"))


@query(f"SELECT id, array_to_string(list_sort(list_filter({_NEEDED.format(f='e')}, lambda x: NOT list_contains({_SAID.format(f='s')}, x))), ' ') AS perdidas FROM (SELECT id, {_fold('evidencia')} AS e, {_fold(chr(99) + 'oalesce(resumo, ' + chr(39) * 2 + ')')} AS s FROM interacoes)")
def summary_missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of the evidence that its summary lost; a null summary lost all."""
    lost = rules.missing_amounts(F.coalesce("resumo", F.lit("")), F.col("evidencia"))
    return table(spark, d, "interacoes").select("id", F.array_join(lost, " ").alias("perdidas"))


_GENERIC = list(vocabulary.GENERIC_WORDS)
_SUPPORT = f"""CASE WHEN len(sw) > 0 THEN len(list_filter(sw, lambda x: list_contains(list_transform(ew, lambda y: left(y, 5)), left(x, 5)))) / CAST(len(sw) AS DOUBLE) END"""
_LETTERS = "list_filter(regexp_extract_all({f}, '[a-z]+'), lambda x: length(x) >= 4{more})"


@query(f"""SELECT id, round({_SUPPORT}, 6) AS apoio FROM (SELECT id, {_LETTERS.format(f=_fold('resumo'), more=f' AND NOT list_contains({_GENERIC!r}, x)')} AS sw, {_LETTERS.format(f=_fold('evidencia'), more='')} AS ew FROM interacoes)""")
def lexical_support(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interacoes").select("id", F.round(rules.lexical_support(F.col("resumo"), F.col("evidencia")), 6).alias("apoio"))


_ROUTES = f"list_transform(list_filter(list_concat(regexp_extract_all({{f}}, '{vocabulary.ROUTE}', 1), regexp_extract_all({{f}}, '{vocabulary.ROUTE}', 2)), lambda r: r <> ''), lambda r: left(r, 6))"
_FLAGS = f"""SELECT *, regexp_matches(o, '{vocabulary.NEGATION}') AND NOT regexp_matches(s, '{vocabulary.RESTRICTION}') AS negacao_perdida,
      len(list_filter({_NEEDED.format(f='o')}, lambda x: NOT list_contains({_SAID.format(f='s')}, x))) > 0 AS quantidade_perdida,
      regexp_matches(o, '{vocabulary.QUALITATIVE_DOSE}') AND NOT regexp_matches(s, '{vocabulary.DOSE_IN_SUMMARY}') AS condicao_perdida,
      len(list_filter({_ROUTES.format(f='o')}, lambda r: NOT contains(s, r))) > 0 AS via_perdida,
      len(list_filter(regexp_extract_all(s, '{vocabulary.SEVERITY}', 1), lambda g: NOT contains(e, left(g, 5)))) > 0 AS gravidade_inventada,
      (regexp_matches(s, '{vocabulary.INCREASE}') AND NOT regexp_matches(e, '{vocabulary.INCREASE}')) OR (regexp_matches(s, '{vocabulary.DECREASE}') AND NOT regexp_matches(e, '{vocabulary.DECREASE}')) AS direcao_inventada,
      coalesce({_SUPPORT}, 1.0) < 0.5 AS pouco_apoio FROM {{rows}}"""
_WORD_LISTS = f"{_LETTERS.format(f='s', more=f' AND NOT list_contains({_GENERIC!r}, x)')} AS sw, {_LETTERS.format(f='e', more='')} AS ew"


@query(f"""SELECT id, negacao_perdida, quantidade_perdida, condicao_perdida, via_perdida, gravidade_inventada, direcao_inventada, pouco_apoio
  FROM ({_FLAGS.format(rows=f"(SELECT *, e AS o, {_WORD_LISTS} FROM (SELECT id, {_fold('resumo')} AS s, {_fold('evidencia')} AS e FROM interacoes))")})""")
def summary_fidelity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes")
    return rows.select("id", rules.fidelity_flags(F.col("resumo"), F.col("evidencia")).alias("_f")).select("id", "_f.*")


def _verdict_rows() -> str:
    words = _RELEVANT.format(w=_words("t"))
    inside = lambda c, t: f"(len({_words(t)}) > 0 AND contains({_padded(c)}, {_padded(t)}))"
    names = lambda c: f"({inside(c, 't')} OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT {inside(c, 'w')})) = 0))"
    own = _CLAUSES.format(x="e", end=_q(vocabulary.CLAUSE_END))
    own_h = _CLAUSES.format(x="h", end=_q(vocabulary.CLAUSE_END))
    return f"""(SELECT *, CASE WHEN len(citam) > 0 THEN array_to_string(citam, ' ') ELSE e END AS o, {names('e')} AS citado, {_WORD_LISTS},
        CASE WHEN len(citam_h) > 0 THEN citam_h ELSE [h] END AS ph
      FROM (SELECT *, list_filter({own}, lambda c: {names('c')}) AS citam, list_filter({own_h}, lambda c: {names('c')}) AS citam_h
        FROM (SELECT id, medicamento_origem, tipo_alvo, coalesce(alvo, '') AS alvo, coalesce(evidencia, '') AS evidencia, trim(coalesce(resumo, ''), ' ') AS resumo, {_fold("coalesce(resumo, '')")} AS s, {_fold("coalesce(evidencia, '')")} AS e,
          {_fold(_DEHYPHEN.format(x='evidencia'))} AS h, {_target("coalesce(alvo, '')")} AS t FROM interacoes)))"""


@query(f"""WITH n AS (SELECT nome_normalizado, list_filter(list_transform(list_concat([nome_normalizado, coalesce(nome_anvisa, '')], list_filter(list_transform(string_split(coalesce(principios_ativos, ''), ';'), lambda x: trim(x, ' ')), lambda x: x <> '')),
      lambda x: {_words(_target('x'))}), lambda s: len(s) > 0) AS nomes FROM bulas),
    f AS ({_FLAGS.format(rows=_verdict_rows())})
  SELECT id, CASE WHEN NOT regexp_matches(alvo, '\\p{{L}}') OR length(alvo) > 150 OR resumo = '' OR length(resumo) > 300 THEN 'ALVO_INVALIDO'
    WHEN len(list_filter(coalesce(n.nomes, []), lambda x: list_has_all(x, string_split({_kw('t')}, ' ')))) > 0 THEN 'ALVO_E_ORIGEM'
    WHEN coalesce(({_words('t')})[1] IN {_list(vocabulary.GENERIC_HEADS)}, false) AND NOT coalesce(tipo_alvo = 'EXAME_LABORATORIAL', false) THEN 'ALVO_GENERICO'
    WHEN trim(evidencia, ' ') = '' THEN 'EVIDENCIA_NAO_ENCONTRADA' WHEN NOT citado THEN 'ALVO_AUSENTE_NA_EVIDENCIA'
    WHEN len(list_filter(ph, lambda c: regexp_matches(c, '{_q(vocabulary.ABSENCE)}'))) > 0 AND len(list_filter(ph, lambda c: regexp_matches(c, '{vocabulary.RECOMMENDATION}'))) = 0 THEN 'RELACAO_NAO_POSITIVA'
    WHEN negacao_perdida THEN 'RESUMO_OMITE_NEGACAO' WHEN quantidade_perdida OR condicao_perdida THEN 'RESUMO_OMITE_QUANTIDADE' WHEN via_perdida THEN 'RESUMO_OMITE_VIA'
    WHEN gravidade_inventada THEN 'RESUMO_INVENTA_GRAVIDADE' WHEN direcao_inventada THEN 'RESUMO_INVENTA_EFEITO' WHEN pouco_apoio THEN 'RESUMO_SEM_APOIO_NA_EVIDENCIA' END AS motivo
  FROM f LEFT JOIN n ON n.nome_normalizado = f.medicamento_origem""".replace("\\\\", "\\"))
def target_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return validate.target_verdicts(table(spark, d, "interacoes"), table(spark, d, "bulas"))
