"""Registered queries of units, sections, compositions and rewritten texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import rules, text, vocabulary
from marisma.operators import composition, layout, rewrites, sections, segments, summaries
from marisma.queries import ORACLES, _CLAUSES, _RELEVANT, _composition, _fold, _lines, _padded, _target, _words, query
from marisma.queries_identify import _NEEDED, _NUMBERS, _ROUTES, _SAID, _list, _q
from marisma.session import spread, table

# ---------------------------------------------------------------- units and windows


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "interacoes").select("id", "alvo", "resumo", "evidencia", "resumo_card"))


@query("SELECT nome_normalizado, true AS cobre, true AS recorte FROM bulas_interacoes WHERE regexp_matches(trecho_interacoes, '\\S')")
def unit_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the units of each text hold all of its letters, and each is a slice of it."""
    rows = table(spark, d, "bulas_interacoes").select("nome_normalizado", "trecho_interacoes")
    units = segments.unit_table(rows, "nome_normalizado", "trecho_interacoes").join(rows, "nome_normalizado")
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    told = units.groupBy("nome_normalizado").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("indice", "texto"))), lambda x: x["texto"]), "").alias("_t"), F.first("trecho_interacoes").alias("_o"),
        F.bool_and(F.instr("trecho_interacoes", F.col("texto")) > 0).alias("recorte"),
    )
    return told.select("nome_normalizado", (bare(F.col("_t")) == bare(F.col("_o"))).alias("cobre"), "recorte")


@query("SELECT nome_normalizado, 0 AS fora, true AS cabem FROM bulas_interacoes WHERE regexp_matches(trecho_interacoes, '\\S')")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Units of each text outside all windows of 120 words, and whether windows keep the budget."""
    rows = segments.unit_table(table(spark, d, "bulas_interacoes"), "nome_normalizado", "trecho_interacoes")
    listed = rows.groupBy("nome_normalizado").agg(F.transform(F.array_sort(F.collect_list(F.struct("indice", F.size(F.split("texto", r"\s+")).alias("n")))), lambda x: x["n"]).alias("_n"))
    listed = listed.withColumn("_w", segments.token_windows(120, 30)("_n"))
    size = lambda w: F.aggregate(F.slice("_n", w["ini"] + 1, w["fim"] - w["ini"]), F.lit(0), lambda a, x: a + x)
    return listed.select("nome_normalizado", F.size(segments.uncovered(F.col("_n"), F.col("_w"))).alias("fora"), F.forall("_w", lambda w: (size(w) <= 120) | (w["fim"] - w["ini"] == 1)).alias("cabem"))


@query(f"""SELECT id, coalesce(len(string_split({_fold('evidencia')}, {_fold('alvo')})) - 1, 0) AS marcas FROM interacoes WHERE length({_fold('alvo')}) = length(alvo) AND length({_fold('evidencia')}) = length(evidencia) AND length(alvo) > 0
  AND strip_accents(lower(evidencia)) = {_fold('evidencia')} AND NOT regexp_matches(evidencia || alvo, '[^\\x{{20}}-\\x{{7e}}\\x{{a1}}-\\x{{17f}}]')""")
def highlight_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each target is highlighted in its evidence, where folding keeps all characters."""
    rows = _evidence(spark, d)
    e, a = F.col("evidencia"), F.col("alvo")
    same = (F.length(text.fold_name(a)) == F.length(a)) & (F.length(text.fold_name(e)) == F.length(e)) & (F.length(a) > 0) & (text.without_accents(e) == text.fold_name(e)) & ~F.concat(e, a).rlike(r"[^\x{20}-\x{7e}\x{a1}-\x{17f}]")
    return rows.where(same).select("id", F.size(segments.highlights(e, F.array(a))).alias("marcas"))


@query()
def numbered_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.unit_table(table(spark, d, "bulas_interacoes"), "nome_normalizado", "trecho_interacoes")
    listed = rows.groupBy("nome_normalizado").agg(F.array_sort(F.collect_list(F.struct("indice", "texto", "titulo"))).alias("_u"))
    return listed.select("nome_normalizado", segments.numbered_sentences(F.transform("_u", lambda u: F.struct(u["texto"].alias("texto"), u["titulo"].alias("titulo")))).alias("frases"))


@query("SELECT nome_normalizado, lower(regexp_replace(coalesce(numero_registro, ''), '\\D', '', 'g')) AS digitos FROM bulas WHERE regexp_matches(coalesce(numero_registro, ''), '\\d')")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bulas").select("nome_normalizado", layout.file_name(F.col("nome_normalizado"), F.col("numero_registro")).alias("_f"))
    return rows.where(F.col("_f").isNotNull()).select("nome_normalizado", F.regexp_extract("_f", r"_(\d+)_profissional\.pdf$", 1).alias("digitos"))


# ---------------------------------------------------------------- sections

_LINE = rf"""trim(regexp_replace(replace(regexp_replace(texto, '[\x{{00a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'), chr(173), ''), '[–—]', '-', 'g'), ' ')"""
_SECTION_LINES = rf"""crus AS (SELECT nome_normalizado AS doc, list_filter(string_split_regex(trecho_interacoes, '\r?\n'), lambda x: trim(x, ' ') <> '') AS v FROM bulas_interacoes WHERE trecho_interacoes IS NOT NULL),
    l0 AS (SELECT doc, unnest(v) AS texto, generate_subscripts(v, 1) - 1 AS n FROM crus),
    l1 AS (SELECT *, trim(regexp_replace({_LINE}, '(\w)[.·]{{2,}}(\w)', '\1 \2', 'g'), ' ') AS x FROM l0),
    linhas AS (SELECT doc, n, n // 60 AS pagina, texto, lower(strip_accents(trim(regexp_replace(CASE WHEN regexp_extract(x, '^(\d{{1,2}})\.\s+\d{{1,2}}\.', 1) <> '' AND regexp_extract(x, '^(\d{{1,2}})\.\s+\d{{1,2}}\.', 1) = regexp_extract(x, '^\d{{1,2}}\.\s+(\d{{1,2}})\.', 1)
        THEN regexp_replace(x, '^(\d{{1,2}})\.\s+\d{{1,2}}\.\s*', '\1. ') ELSE x END, '\s+', ' ', 'g')))) AS normal FROM l1),
    paginas AS (SELECT doc, pagina, string_agg(normal, ' ' ORDER BY n) AS t FROM linhas GROUP BY 1, 2),
    administrativas AS (SELECT doc, pagina FROM paginas WHERE len(list_filter({list(vocabulary.ADMIN_HEADERS)!r}, lambda m: contains(t, m))) >= 3
      OR (len(list_filter({list(vocabulary.ADMIN_FORMAL)!r}, lambda m: contains(t, m))) > 0 AND (contains(t, 'notificacao') OR contains(t, 'inclusao inicial')) AND (contains(t, 'rdc') OR contains(t, 'expediente'))
        AND len(regexp_extract_all(t, '\b\d{{2}}/\d{{2}}/\d{{4}}\b')) >= 2 AND len(list_filter({list(vocabulary.ADMIN_LABELS)!r}, lambda m: regexp_matches(t, '\b' || m || '\b'))) >= 1)),
    formas AS (SELECT *, concat_ws(' ', normal, lead(normal) OVER w) AS duas, concat_ws(' ', normal, lead(normal) OVER w, lead(normal, 2) OVER w) AS tres,
        coalesce(max(CAST(regexp_matches(normal, '{sections.TOC_LABEL}') AS INTEGER)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 0) = 1
          OR sum(CAST(regexp_matches(texto, '{sections.TOC_ENTRY}') AS INTEGER)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) >= 2 AS indice FROM linhas WINDOW w AS (PARTITION BY doc ORDER BY n)),
    achadas AS (SELECT doc, n, CASE WHEN regexp_matches(tres, '{sections.TITLE}') THEN 3 WHEN regexp_matches(duas, '{sections.TITLE}') THEN 2 WHEN regexp_matches(normal, '{sections.TITLE}') THEN 1 END AS linhas,
        CASE WHEN regexp_matches(tres, '{sections.TITLE}') THEN tres WHEN regexp_matches(duas, '{sections.TITLE}') THEN duas ELSE normal END AS titulo FROM formas f
      WHERE NOT indice AND NOT EXISTS (SELECT 1 FROM administrativas a WHERE a.doc = f.doc AND a.pagina = f.pagina)),
    primeiras AS (SELECT *, TRY_CAST(nullif(regexp_extract(titulo, '{sections.NUMBERED}', 1), '') AS INTEGER) AS numero FROM (
      SELECT *, max(n + linhas) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM achadas WHERE linhas IS NOT NULL) WHERE coalesce(antes, 0) <= n),
    capitulos AS (SELECT doc, n, normal FROM linhas WHERE regexp_matches(normal, '{sections.NUMBERED}') AND upper(texto) = texto AND regexp_matches(texto, '\p{{L}}')),
    titulos AS (SELECT doc, n, linhas, titulo, numero FROM (SELECT p.*, (SELECT arg_max(c.normal, c.n) FROM capitulos c WHERE c.doc = p.doc AND c.n < p.n) AS pai, max(CAST(numero IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc) = 1 AS algum FROM primeiras p)
      WHERE NOT (algum AND numero IS NULL AND len(list_filter({list(vocabulary.PARENT_TOPICS)!r}, lambda x: contains(coalesce(pai, ''), x))) > 0))"""
_MAIN = rf"regexp_replace(regexp_replace({{x}}, '^\s*\d\d?(?:\s*[.)-]\s*|\s+)', ''), '^[ .:?-]+|[ .:?-]+$', '', 'g') IN {_list(vocabulary.MAIN_TITLES)}"


@query(f"WITH {_SECTION_LINES} SELECT * FROM titulos")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    return sections.title_lines(_lines(spark, d))


@query(rf"""WITH {_SECTION_LINES},
    principais AS (SELECT doc, n, TRY_CAST(nullif(regexp_extract(normal, '{sections.NUMBERED}', 1), '') AS INTEGER) AS numero FROM (
      SELECT *, regexp_replace(texto, '^\s*\d{{1,2}}\s*\)\s*', '') AS aberto, concat_ws(' ', lag(texto, 3) OVER w, lag(texto, 2) OVER w, lag(texto) OVER w) AS atras FROM linhas WINDOW w AS (PARTITION BY doc ORDER BY n))
      WHERE ({_MAIN.format(x='normal')} OR (regexp_matches(normal, '{sections.NUMBERED}') AND upper(texto) = texto AND regexp_matches(texto, '\p{{L}}'))) AND NOT regexp_matches(normal, '^\d+\.\d')
        AND length(replace(aberto, ')', '')) >= length(replace(aberto, '(', '')) AND length(replace(aberto, ']', '')) >= length(replace(aberto, '[', '')) AND NOT regexp_matches(atras, '(?i)\([^)]*(?:vide|veja|ver|consulte)[^)]*$')),
    faixas AS (SELECT t.doc, t.n AS inicio, t.linhas, t.titulo, coalesce((SELECT min(p.n) FROM principais p WHERE p.doc = t.doc AND p.n >= t.n + t.linhas AND (p.numero IS NULL OR t.numero IS NULL OR p.numero > t.numero)), (SELECT max(n) + 1 FROM linhas l WHERE l.doc = t.doc)) AS fim FROM titulos t),
    corpos AS (SELECT f.doc, f.inicio, f.fim, f.titulo, string_agg(l.texto, chr(10) ORDER BY l.n) AS texto, coalesce(list(l.normal ORDER BY l.n) FILTER (WHERE l.n >= f.inicio + f.linhas), []) AS p FROM faixas f JOIN linhas l ON l.doc = f.doc AND l.n >= f.inicio AND l.n < f.fim GROUP BY ALL),
    conteudos AS (SELECT *, regexp_replace(array_to_string(p, ' '), '^[ :.–—-]+|[ :.–—-]+$', '', 'g') AS c FROM corpos)
  SELECT doc, inicio, fim, titulo, texto, CASE WHEN c IN {_list(vocabulary.SHORT_ANSWERS)} THEN 'RESPOSTA_CURTA'
    WHEN length(regexp_replace(c, '\s', '', 'g')) < 20 OR c = titulo OR (len(p) > 0 AND len(list_filter(p, lambda x: NOT (regexp_matches(x, '{sections.TITLE}') OR {_MAIN.format(x='x')} OR regexp_matches(x, '^[\d\s./:-]+$')))) = 0) THEN 'SOMENTE_TITULO'
    WHEN len(regexp_extract_all(c, '[a-z]+')) > 0 AND ((regexp_matches(c, '\b(?:rdc|notificacao|expediente)\b') AND (regexp_matches(c, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b') OR regexp_matches(c, '\b(?:cx|fr|emb|hosp|plas|ct)\b')))
      OR (len(list_filter(regexp_extract_all(c, '[a-z]+'), lambda w: NOT list_contains({sorted(set(vocabulary.LABEL_WORDS.split()))!r}, w))) = 0 AND regexp_matches(c, '\b(?:cx|fr|emb|hosp|plas|ct)\b') AND (regexp_matches(c, '\b(?:mg|ml|mcg)\b') OR regexp_matches(c, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b')))) THEN 'SOMENTE_ROTULOS' ELSE 'OK' END AS estado FROM conteudos""")
def section_extraction(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(_lines(spark, d))


@query(f"""WITH s AS ({ORACLES["section_extraction"]}),
    t AS (SELECT nome_normalizado AS doc, status_extracao, coalesce(list_sum(list_transform(list_filter(string_split_regex(trecho_interacoes, '\\r?\\n'), lambda x: trim(x, ' ') <> ''), lambda x: length(x))), 0) AS n FROM bulas_interacoes),
    v AS (SELECT doc, count(*) FILTER (WHERE estado IN ('OK', 'RESPOSTA_CURTA')) AS validas, bool_and(estado IN ('SOMENTE_TITULO', 'SOMENTE_ROTULOS')) AS so FROM s GROUP BY 1)
  SELECT t.doc, CASE WHEN t.status_extracao = 'ERRO' THEN 'PDF_INVALIDO' WHEN t.n < 40 THEN 'PDF_SEM_TEXTO' WHEN v.doc IS NULL THEN 'SEM_SECAO_INTERACOES' WHEN v.validas = 0 THEN CASE WHEN v.so THEN 'SECAO_SOMENTE_TITULO' ELSE 'REVISAO_MANUAL' END ELSE 'CONCLUIDO' END AS status
  FROM t LEFT JOIN v ON v.doc = t.doc""")
def extraction_statuses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "bulas_interacoes").select(F.col("nome_normalizado").alias("doc"), F.when(F.col("status_extracao") == "ERRO", "PDF_INVALIDO").alias("falha"), F.lit(0).alias("paginas_ocr"))
    return sections.extraction_status(docs, _lines(spark, d)).select("doc", "status")


# ---------------------------------------------------------------- compositions


@query(rf"SELECT nome_normalizado, posicao FROM (SELECT nome_normalizado, unnest(list_filter(list_transform(regexp_split_to_array(composicao, '\n'), lambda x, i: CASE WHEN regexp_matches(x, '(?i)\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|ui|%)') THEN i - 1 END), lambda i: i IS NOT NULL)) AS posicao FROM bulas WHERE composicao IS NOT NULL)")
def dosed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of compositions that state a dose."""
    lines = table(spark, d, "bulas").where(F.col("composicao").isNotNull()).select("nome_normalizado", F.posexplode(F.split("composicao", "\n")).alias("posicao", "_l"))
    return lines.where(F.col("_l").rlike(r"(?i)\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|ui|%)")).select("nome_normalizado", "posicao")


@query()
def resolved_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """Active names of compositions as the registry's list spells them."""
    names = table(spark, d, "bulas").select("nome_normalizado", text.list_of(F.col("principios_ativos")).alias("_c"))
    rows = _composition(spark, d).where("papel = 'ATIVO' AND nome <> ''").join(names, "nome_normalizado")
    return rows.select("nome_normalizado", "posicao", composition.resolved_name(F.col("nome"), F.col("_c")).alias("nome"))


# ---------------------------------------------------------------- rewritten texts


def _chain(x: str, pairs) -> str:
    for pattern, plain in pairs:
        x = f"regexp_replace({x}, '{_q(pattern)}', '{plain}', 'g')"
    return x


_PLAIN = _chain(_fold("{x}"), rewrites.WORDINGS)
_FREQUENT = r"\b\d+\s+vez(?:es)?\s+(?:ao|por)\s+(?:dia|semana)\b|\ba\s+cada\s+\d+(?:[.,]\d+)?\s*(?:horas?|h|dias?)\b"
_CLINICAL = "list_sort(" + _NUMBERS.replace("{f}", _chain("{f}", [(p, " ") for p in (*rewrites._NO_AMOUNT, _FREQUENT)]).replace("{2}", "{{2}}").replace("{1,2}", "{{1,2}}").replace("{1,4}", "{{1,4}}")).replace("{p}", r"\d+(?:[.,]\d+)?") + ")"
_LIMITED = "list_sort(list_distinct(list_concat(" + ", ".join(f"list_transform(regexp_extract_all({{f}}, '{p}', 1), lambda n: '{k} ' || replace(n, '.', ','))" for k, p in rewrites.LIMITS[:2]) + ", list_concat(" + ", ".join(f"list_transform(regexp_extract_all({{f}}, '{p}', 1), lambda n: '{k} ' || replace(n, '.', ','))" for k, p in rewrites.LIMITS[2:]) + "))))"


@query(f"SELECT id, {_PLAIN.replace('{x}', 'evidencia')} AS texto FROM interacoes")
def plain_wordings(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("id", rewrites.plain_wording(F.col("evidencia")).alias("texto"))


@query(f"SELECT id, array_to_string({_CLINICAL.replace('{f}', 'f').replace('{{', '{').replace('}}', '}')}, ' ') AS numeros, array_to_string({_LIMITED.replace('{f}', 'f')}, ' ') AS limites FROM (SELECT id, {_fold('evidencia')} AS f FROM interacoes)")
def clinical_numbers(spark: SparkSession, d: str) -> DataFrame:
    f = text.fold_name(F.col("evidencia"))
    return _evidence(spark, d).select("id", F.array_join(rewrites.clinical_numbers(f), " ").alias("numeros"), F.array_join(rewrites.limits(f), " ").alias("limites"))


_EVERY = "array_to_string(list_sort(list_distinct(regexp_extract_all(f, '{p}'))), '|')"


@query(rf"""SELECT id, array_to_string(list_sort({_NEEDED.format(f='f')}), '|') AS doses, {_EVERY.replace('{p}', r'\d+(?:[.,]\d+)?\s*%')} AS percentuais,
    {_EVERY.replace('{p}', r'\b(?:idosos?|criancas?|gestantes?|lactantes?|adultos?|pacientes com [a-z]+)\b')} AS populacoes FROM (SELECT id, {_fold('evidencia')} AS f FROM interacoes)""")
def kept_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).select("id", rewrites.kept_facts(F.col("evidencia")).alias("_f"))
    return rows.select("id", *[F.array_join(f"_f.{c}", "|").alias(c) for c in ("doses", "percentuais", "populacoes")])


@query(r"""SELECT id, regexp_matches(evidencia, '[↑↓↔|]') AS tabela, (length(evidencia) - length(replace(evidencia, ',', ''))) >= 4 AND NOT regexp_matches(FOLD, '\b(?:aument|diminu|reduz|potencializ|inib|risco|efeito|evit|contraindic|interfer|alter|toxic)\w*') AS lista_sem_efeito,
    len(regexp_extract_all(FOLD, '[a-z0-9]+')) < 3 AS vazio FROM interacoes""".replace("FOLD", _fold("evidencia")))
def input_problems(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("id", rewrites.input_problems(F.col("evidencia")).alias("_f")).select("id", "_f.*")


_CARD = "(SELECT id, resumo_card AS t, {a} AS f, {b} AS s FROM interacoes WHERE resumo_card IS NOT NULL)"
_PAIR = _CARD.format(a=_fold("resumo_card"), b=_fold("evidencia"))


def _term(x: str, y: str) -> str:
    return f"contains({_padded(x)}, {_padded(y)})"


@query(rf"""SELECT id, NOT length(t) BETWEEN 40 AND 600 AS tamanho, regexp_matches(t, '(?m)^\s*(?:\d+[.)]|[-*])\s') OR len(regexp_extract_all(t, '\b\d{{1,2}}[.)]\s+[A-ZÀ-Ú]')) >= 2 AS lista,
    regexp_matches(t, '(?i)[{{}}\[\]`]|<\|.*?\|>|(?:system|assistant|user)\s*:|"texto"\s*:') AS marcacao,
    len(list_filter({list(rewrites.ECHOES)!r}, lambda e: contains(f, e))) > 0 AS eco, len(list_filter({list(rewrites.CERTAINTY)!r}, lambda c: {_term('f', 'c')} AND NOT {_term('s', 'c')})) > 0 AS certeza,
    len(list_filter(regexp_extract_all(f, '{vocabulary.SEVERITY}', 1), lambda g: NOT contains(s, left(g, 5)))) > 0 AS gravidade FROM {_PAIR}""")
def response_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).where(F.col("resumo_card").isNotNull()).select("id", rewrites.response_problems(F.col("resumo_card"), F.col("evidencia")).alias("_f"))
    return rows.select("id", *[f"_f.{c}" for c in ("tamanho", "lista", "marcacao", "eco", "certeza", "gravidade")])


_PLAIN_PAIR = _CARD.format(a=_PLAIN.replace("{x}", "resumo_card"), b=_PLAIN.replace("{x}", "evidencia"))
_C = lambda v: _CLINICAL.replace("{f}", v).replace("{{", "{").replace("}}", "}")
_L = lambda v: _LIMITED.replace("{f}", v)


@query(rf"""SELECT id, len(list_filter({_C('f')}, lambda x: NOT list_contains({_C('s')}, x))) > 0 AS numero_novo, len(list_filter({_NEEDED.format(f='s')}, lambda x: NOT list_contains({_SAID.format(f='f')}, x))) > 0 AS quantidade_perdida,
    {_L('f')} <> {_L('s')} AS limite, len(list_filter({_ROUTES.format(f='s')}, lambda r: NOT contains(f, r))) > 0 AS via,
    regexp_matches(s, '{rewrites.RESTRICTED}') AND NOT regexp_matches(f, '{rewrites.RESTRICTED}|\bevit\w*') AS restricao,
    regexp_matches(s, '\bpodem?\b') AND NOT regexp_matches(f, '\bpodem?\b|\bpossivel\b|\bpossibilidade\b') AS possibilidade FROM {_PLAIN_PAIR}""")
def rewrite_fidelity(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).where(F.col("resumo_card").isNotNull()).select("id", rewrites.fidelity(F.col("resumo_card"), F.col("evidencia")).alias("_f"))
    return rows.select("id", *[f"_f.{c}" for c in ("numero_novo", "quantidade_perdida", "limite", "via", "restricao", "possibilidade")])


@query()
def rewrite_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d).where(F.col("resumo_card").isNotNull())
    return rows.groupBy(F.coalesce(rewrites.rewrite_verdict(F.col("resumo_card"), F.col("evidencia")), F.lit("ACEITO")).alias("motivo")).agg(F.count("*").alias("n"))


@query()
def cleaned_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("id", rewrites.cleaned(F.col("evidencia")).alias("texto"))


@query()
def relation_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes").select("id", "medicamento_origem", "alvo", "evidencia")
    names = F.array(text.fold_name(F.col("medicamento_origem")), text.fold_target(F.coalesce("alvo", F.lit(""))))
    return spread(rows).select("id", F.array_join(rewrites.relation_signatures(rewrites.plain_wording(F.col("evidencia")), names), " ").alias("assinaturas"))


@query(f"""SELECT id, CASE WHEN len(c) > 0 THEN array_to_string(c, ' ') ELSE f END AS texto FROM (SELECT id, f, list_filter({_CLAUSES.format(x='f', end=_q(vocabulary.CLAUSE_END))}, lambda c: (len({_words('t')}) > 0 AND contains({_padded('c')}, {_padded('t')}))
    OR (len({_RELEVANT.format(w=_words('t'))}) > 0 AND len(list_filter({_RELEVANT.format(w=_words('t'))}, lambda w: NOT contains({_padded('c')}, {_padded('w')}))) = 0)) AS c
  FROM (SELECT id, {_fold('evidencia')} AS f, {_target("coalesce(alvo, '')")} AS t FROM interacoes))""")
def clauses_about(spark: SparkSession, d: str) -> DataFrame:
    own = rules.clauses_about(text.fold_name(F.col("evidencia")), text.fold_target(F.coalesce("alvo", F.lit(""))))
    return _evidence(spark, d).select("id", F.array_join(own, " ").alias("texto"))


@query(f"""WITH u AS (SELECT processamento_id, alvo, tipo_alvo, count(*) AS total, count(*) FILTER (WHERE json_extract_string(reescrita_controle, '$.publicado.status') = 'CONCLUIDO') AS feitos, count(*) FILTER (WHERE resumo_status = 'FALHA') AS falhas FROM interacoes GROUP BY 1, 2, 3)
  SELECT processamento_id, alvo, tipo_alvo, CASE WHEN total > 0 AND feitos = total THEN 'CONCLUIDO' WHEN feitos > 0 THEN 'PARCIAL' WHEN falhas > 0 THEN 'FALHA' ELSE 'PENDENTE' END AS estado FROM u""")
def rewrite_states(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.get_json_object("reescrita_controle", "$.publicado.status") == "CONCLUIDO")
    rows = table(spark, d, "interacoes").groupBy("processamento_id", "alvo", "tipo_alvo").agg(F.count("*").alias("_t"), done.alias("_d"), F.count_if(F.col("resumo_status") == "FALHA").alias("_f"))
    return rows.select("processamento_id", "alvo", "tipo_alvo", rewrites.run_state(F.col("_t"), F.col("_d"), F.col("_f")).alias("estado"))


@query("SELECT id, regexp_matches(t, '(?m)^\\s*(?:[-*•]|\\d+[.)])\\s') AS lista, NOT length(trim(t, ' ')) BETWEEN 40 AND 600 AS tamanho, regexp_matches(t, '^\\s*[\\[{]') AS json, NOT regexp_matches(trim(t, ' '), '[.!?)…]$') AS sem_fim FROM (SELECT id, resumo_card_simples AS t FROM interacoes WHERE resumo_card_simples IS NOT NULL)")
def plain_card_form(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "interacoes").where(F.col("resumo_card_simples").isNotNull()).select("id", summaries.response_flags(F.col("resumo_card_simples")).alias("_f"))
    return rows.select("id", "_f.lista", "_f.tamanho", "_f.json", "_f.sem_fim")

