"""Read-only questions over catalogue, sources, runs, relations and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marisma.functions.rules import is_not_positive
from marisma.functions.text import display_name, fold_name, fold_target, list_of, not_blank, plain_words, quotation_key
from marisma.plans.runs import current_runs, eligible, registered_runs
from marisma.session import cut_lineage, table

# Target types whose unlinked mentions count in a pair.
MENTION_TYPES = ("CLASSE_FARMACOLOGICA", "PRINCIPIO_ATIVO", "MEDICAMENTO")
ORIGIN = "medicamento_origem"


@dataclass(frozen=True)
class Corpus:
    """The five tables."""

    catalog: DataFrame
    source: DataFrame
    runs: DataFrame
    relations: DataFrame
    links: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, d: str) -> Corpus:
        return cls(*(table(spark, d, n) for n in ("bulas", "bulas_interacoes", "processamentos_interacoes", "interacoes", "interacoes_medicamentos")))

    def current(self) -> DataFrame:
        return current_runs(self.runs, self.source)

    def current_relations(self) -> DataFrame:
        """Relations of current runs whose origin is in the catalogue."""
        run = self.current().select(F.col("id").alias("processamento_id"))
        known = self.catalog.select(F.col("nome_normalizado").alias(ORIGIN))
        return self.relations.join(run, "processamento_id", "left_semi").join(known, ORIGIN, "left_semi")


def situation(c: Corpus) -> DataFrame:
    """One row per catalogue entry: what is known of its source and runs."""
    key = F.col("nome_normalizado")
    catalog = c.catalog.select("nome_normalizado", display_name(F.col("nome_anvisa"), key).alias("nome_exibicao"), F.col("status").alias("status_bula"))
    source = c.source.select("nome_normalizado", F.lit(True).alias("_e"), "status_extracao", not_blank(F.col("trecho_interacoes")).alias("_t"))
    with_mentions = c.relations.select(F.col("processamento_id").alias("_id")).distinct().withColumn("_m", F.lit(True))
    current = c.current().select(F.col(ORIGIN).alias("nome_normalizado"), F.col("id").alias("processamento_id"), F.col("status").alias("status_processamento"))
    current = current.join(with_mentions, F.col("processamento_id") == F.col("_id"), "left").drop("_id")
    history = c.runs.groupBy(F.col(ORIGIN).alias("nome_normalizado")).agg(
        F.expr("max_by(status, id) FILTER (WHERE invalidado_em IS NULL)").alias("ultimo_status"), F.bool_or(F.col("invalidado_em").isNotNull()).alias("_r")
    )
    rows = catalog.join(source, "nome_normalizado", "left").join(current, "nome_normalizado", "left").join(history, "nome_normalizado", "left")
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    return rows.select(
        "nome_normalizado", "nome_exibicao", "status_bula", flag("_e").alias("tem_extracao"), "status_extracao", flag("_t").alias("tem_texto"),
        "processamento_id", "status_processamento", "ultimo_status", flag("_m").alias("tem_mencoes"), flag("_r").alias("tem_retirada"),
    )


def analysis_state(busy: Column | None = None) -> Column:
    """State of a situation row by precedence."""
    running = F.coalesce(busy, F.lit(False)) if busy is not None else F.lit(False)
    no_text = (~F.col("status_extracao").eqNullSafe("CONCLUIDO")) | ~F.col("tem_texto")
    return (
        F.when(F.col("processamento_id").isNotNull(), F.col("status_processamento"))
        .when(running, "EM_PROCESSAMENTO")
        .when(~F.col("status_bula").eqNullSafe("CONCLUIDO"), "SEM_BULA")
        .when(~F.col("tem_extracao"), "EXTRACAO_INDISPONIVEL")
        .when(F.col("status_extracao") == "SEM_SECAO_INTERACOES", "SEM_TOPICO_INTERACOES")
        .when(no_text, "EXTRACAO_INDISPONIVEL")
        .when(F.col("ultimo_status") == "FALHA", "FALHA")
        .when(F.col("ultimo_status") == "REVISAO_NECESSARIA", "REVISAO_NECESSARIA")
        .when(F.col("tem_retirada"), "RETIRADO")
        .otherwise("NAO_PROCESSADO")
    )


def states(c: Corpus, busy: DataFrame | None = None) -> DataFrame:
    """Situation with its state and whether it permits a negative conclusion."""
    rows = situation(c)
    if busy is not None:
        rows = rows.join(busy.select("nome_normalizado", F.lit(True).alias("_b")).distinct(), "nome_normalizado", "left")
    rows = rows.withColumn("estado", analysis_state(F.col("_b") if busy is not None else None))
    conclusive = (F.col("estado") == "CONCLUIDO_SEM_RELACOES") | ((F.col("estado") == "CONCLUIDO_COM_RELACOES") & F.col("tem_mencoes"))
    return rows.withColumn("conclusiva", conclusive).drop("_b")


def coverage(c: Corpus) -> DataFrame:
    """One row: eligible, concluded, under review, and what follows from them."""
    sources = eligible(c.source).join(c.catalog.select("nome_normalizado"), "nome_normalizado", "left_semi").agg(F.count("*").alias("elegiveis"))
    current = c.current()
    having = c.relations.select(F.col("processamento_id").alias("id")).distinct().withColumn("_m", F.lit(True))
    done = current.join(having, "id", "left").agg(F.count_if((F.col("status") == "CONCLUIDO_SEM_RELACOES") | F.col("_m").isNotNull()).alias("concluidas"))
    review = registered_runs(c.runs, c.source).where("status = 'REVISAO_NECESSARIA'").join(current.select(ORIGIN), ORIGIN, "left_anti").agg(F.count("*").alias("em_revisao"))
    # Three aggregates of one row each.
    one = sources.crossJoin(done).crossJoin(review)
    analysed = F.col("concluidas") + F.col("em_revisao")
    complete = (F.col("elegiveis") > 0) & (analysed >= F.col("elegiveis"))
    return one.select("elegiveis", "concluidas", "em_revisao", analysed.alias("analisadas"), complete.alias("corpus_completo"), (complete & (F.col("em_revisao") == 0)).alias("lista_exaustiva"))


def positive_relations(c: Corpus) -> DataFrame:
    """Current relations that state an interaction."""
    return c.current_relations().where(~is_not_positive(F.col("evidencia"), F.col("alvo")))


def single_page(c: Corpus, origins: list[str] | None, page: int, size: int) -> DataFrame:
    """One page of the relations of each asked origin (all if None); filtered before paging."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and 1 <= size <= 100")
    rows = positive_relations(c)
    if origins is not None:
        rows = rows.where(F.col(ORIGIN).isin(*origins))
    # Narrow rows are counted, and numbered no further than the page: the group limit cuts before the
    # shuffle.  The wide columns of the page are joined to the ids that are kept.
    narrow = cut_lineage(rows.select("id", ORIGIN))
    total = narrow.groupBy(ORIGIN).agg(F.count("*").alias("total"))
    numbered = narrow.withColumn("posicao", F.row_number().over(Window.partitionBy(ORIGIN).orderBy("id"))).where(F.col("posicao") <= page * size)
    kept = numbered.where(F.col("posicao") > (page - 1) * size).join(total, ORIGIN)
    wide = c.relations.select("id", "alvo", "tipo_alvo", "resumo")
    return kept.join(wide, "id").select("id", ORIGIN, "alvo", "tipo_alvo", "resumo", "posicao", "total", F.ceil(F.col("total") / size).cast("long").alias("paginas"))


def single_answers(c: Corpus) -> DataFrame:
    """Verdict of every entry alone: true, false or null (no conclusion)."""
    counted = positive_relations(c).groupBy(F.col(ORIGIN).alias("nome_normalizado")).agg(F.count("*").alias("relacoes"), F.count_distinct(fold_target(F.col("alvo"))).alias("alvos"))
    rows = states(c).select("nome_normalizado", "estado", "conclusiva").join(counted, "nome_normalizado", "left")
    verdict = F.when(F.coalesce("alvos", F.lit(0)) > 0, True).when(F.col("conclusiva"), False)
    return rows.select("nome_normalizado", "estado", F.coalesce("relacoes", F.lit(0)).alias("relacoes"), F.coalesce("alvos", F.lit(0)).alias("alvos"), verdict.alias("identificada"))


def related_topk(c: Corpus, k: int = 20) -> DataFrame:
    """First k related entries of each relation by name, and their total.

    A relation links few entries, but a hot one is cut by the window's group limit before it moves.
    """
    known = c.catalog.select(F.col("nome_normalizado").alias("medicamento_relacionado"), display_name(F.col("nome_anvisa"), F.col("nome_normalizado")).alias("nome_exibicao"))
    active = c.links.where(F.col("invalidado_em").isNull()).join(known, "medicamento_relacionado")
    total = active.groupBy("interacao_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("interacao_id").orderBy("medicamento_relacionado", F.col("criterio_vinculo").asc_nulls_first())
    first = active.withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= k)
    return first.join(total, "interacao_id").select("interacao_id", "posicao", "medicamento_relacionado", "nome_exibicao", "criterio_vinculo", "total")


def _word_sets(c: Corpus) -> DataFrame:
    """(nome_normalizado, conjuntos): the words of the name, the display name and each ingredient."""
    words = lambda x: F.array_distinct(F.filter(plain_words(fold_name(x)), lambda w: F.length(w) >= 3))
    names = F.array(words(F.col("nome_normalizado")), words(F.coalesce("nome_anvisa", F.lit(""))))
    sets = F.filter(F.concat(names, F.transform(list_of(F.col("principios_ativos")), words)), lambda s: F.size(s) > 0)
    return c.catalog.select("nome_normalizado", sets.alias("conjuntos"))


def pair_rows(c: Corpus, pairs: DataFrame) -> DataFrame:
    """Every relation that tells something of a pair (a, b), with its kind and evidence group.

    ``pairs`` has a, b, a < b.  Both directions are one plan: a pair is two (origin, other) rows.
    Linked relations meet their pair by origin and linked name, unlinked mentions by origin and a word
    of the other's names; only class alerts, which hold for every pair of their origin, meet by the
    origin alone.  All of that is over narrow rows; texts are joined to the ids that are left.
    """
    ordered = pairs.where("a <> b").distinct()
    way = ordered.select("a", "b", F.col("a").alias(ORIGIN), F.col("b").alias("outro"), F.lit("BULA_A_CITA_B").alias("sentido")).unionByName(
        ordered.select("a", "b", F.col("b").alias(ORIGIN), F.col("a").alias("outro"), F.lit("BULA_B_CITA_A").alias("sentido"))
    )
    way = cut_lineage(way)
    target = F.array_distinct(F.filter(plain_words(fold_name(F.col("alvo"))), lambda w: F.length(w) >= 3))
    narrow = cut_lineage(positive_relations(c).select("id", ORIGIN, "tipo_alvo", target.alias("_alvo")))
    active = c.links.where(F.col("invalidado_em").isNull()).select(F.col("interacao_id").alias("id"), F.col("medicamento_relacionado").alias("outro"), F.col("criterio_vinculo").alias("criterio"))
    linked = cut_lineage(narrow.join(active, "id").join(way, [ORIGIN, "outro"]))
    specific = linked.where(F.col("criterio").isNotNull()).withColumn("especie", F.lit("ESPECIFICA"))
    alert = narrow.where("tipo_alvo = 'CLASSE_FARMACOLOGICA'").join(way, ORIGIN).join(linked.select("id", "outro"), ["id", "outro"], "left_anti")
    sets = _word_sets(c).withColumnRenamed("nome_normalizado", "outro")
    words = way.join(sets, "outro").select(*way.columns, "conjuntos", F.explode(F.array_distinct(F.flatten("conjuntos"))).alias("_p"))
    unlinked = narrow.where(F.col("tipo_alvo").isin(*[t for t in MENTION_TYPES if t != "CLASSE_FARMACOLOGICA"]) & (F.size("_alvo") > 0))
    named = F.exists("conjuntos", lambda s: F.size(F.array_except("_alvo", s)) == 0)
    mention = unlinked.withColumn("_p", F.get("_alvo", F.lit(0))).join(words, [ORIGIN, "_p"]).where(named).join(linked.select("id", "outro"), ["id", "outro"], "left_anti")
    # A link without criterion is none, but its relation counts whatever its type.
    loose = linked.where(F.col("criterio").isNull()).join(sets, "outro", "left")
    kind = F.when(F.col("tipo_alvo") == "CLASSE_FARMACOLOGICA", "ALERTA").when((F.size("_alvo") > 0) & F.coalesce(named, F.lit(False)), "MENCAO")
    loose = loose.withColumn("especie", kind).where(F.col("especie").isNotNull())
    kept = ["a", "b", "sentido", ORIGIN, "especie", "id"]
    none = F.lit(None).cast("string").alias("criterio_vinculo")
    rows = specific.select(*kept, F.col("criterio").alias("criterio_vinculo")).unionByName(alert.withColumn("especie", F.lit("ALERTA")).select(*kept, none))
    rows = rows.unionByName(mention.withColumn("especie", F.lit("MENCAO")).select(*kept, none)).unionByName(loose.select(*kept, none))
    text = c.relations.select("id", "processamento_id", "alvo", "tipo_alvo", "resumo", "evidencia", quotation_key(F.col("evidencia")).alias("_q"))
    return rows.join(text, "id")


def pair_evidence(c: Corpus, pairs: DataFrame) -> DataFrame:
    """Evidence groups of each pair: one row per kind, direction, run and quotation, with the ids of
    its different items in order."""
    rows = pair_rows(c, pairs)
    group = ["a", "b", "especie", "sentido", ORIGIN, "processamento_id", "_q"]
    item = [*group, fold_name(F.col("alvo")).alias("_a"), "tipo_alvo", quotation_key(F.col("resumo")).alias("_r"), "criterio_vinculo"]
    first = rows.groupBy(*item).agg(F.min("id").alias("id"))
    return first.groupBy(*group).agg(F.min("id").alias("primeiro"), F.count("*").alias("itens"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).drop("_q")


def pair_verdicts(c: Corpus, pairs: DataFrame) -> DataFrame:
    """Three-valued verdict of each pair: null is 'no conclusion' and never becomes false."""
    kinds = pair_rows(c, pairs).groupBy("a", "b").agg(*[F.count_if(F.col("especie") == k).alias(n) for k, n in (("ESPECIFICA", "especificas"), ("ALERTA", "alertas"), ("MENCAO", "mencoes"))])
    known = states(c).select("nome_normalizado", "conclusiva")
    side = lambda x: known.select(F.col("nome_normalizado").alias(x), F.col("conclusiva").alias(f"_{x}"))
    rows = pairs.where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").join(kinds, ["a", "b"], "left")
    number = lambda x: F.coalesce(F.col(x), F.lit(0))
    verdict = F.when(number("especificas") > 0, True).when(number("mencoes") > 0, F.lit(None)).when(F.col("_a") & F.col("_b"), False)
    return rows.select("a", "b", number("especificas").alias("especificas"), number("alertas").alias("alertas"), number("mencoes").alias("mencoes"), (F.col("_a") & F.col("_b")).alias("completa"), verdict.alias("identificada"))


def cited_pairs(c: Corpus) -> DataFrame:
    """Unordered pairs of catalogue entries of which one's current relations link the other."""
    known = c.catalog.select("nome_normalizado")
    active = c.links.where(F.col("invalidado_em").isNull()).select(F.col("interacao_id").alias("id"), F.col("medicamento_relacionado").alias("_o"))
    met = c.current_relations().select("id", ORIGIN).join(active, "id").where(F.col(ORIGIN) != F.col("_o"))
    met = met.join(known.withColumnRenamed("nome_normalizado", "_o"), "_o", "left_semi")
    return met.select(F.least(ORIGIN, "_o").alias("a"), F.greatest(ORIGIN, "_o").alias("b")).distinct()


def suggest(c: Corpus, term: str, limit: int = 6) -> DataFrame:
    """Names that contain the term: prefix first, then word start, then inside."""
    name = F.col("nome_normalizado")
    rank = F.when(name.startswith(term), 0).when(name.contains(" " + term), 1).otherwise(2)
    rows = c.catalog.where((F.col("status") == "CONCLUIDO") & name.contains(term))
    return rows.select(name, display_name(F.col("nome_anvisa"), name).alias("nome_exibicao"), rank.alias("ordem")).orderBy("ordem", "nome_normalizado").limit(limit)


def suggest_fuzzy(c: Corpus, term: str, limit: int = 6) -> DataFrame:
    """Names with a word whose beginning is at most one edit (two from seven letters) from the term."""
    most, n = (1 if len(term) < 7 else 2), len(term)
    words = F.filter(F.split("nome_normalizado", " "), lambda w: w != "")
    prefixes = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(max(1, n - 2)), F.lit(n + 2)), lambda k: F.substring(w, F.lit(1), k))))
    distance = F.array_min(F.transform(prefixes, lambda p: F.levenshtein(p, F.lit(term))))
    rows = c.catalog.where((F.col("status") == "CONCLUIDO") & (F.lit(n) >= 4)).withColumn("distancia", distance).where(F.col("distancia") <= most)
    return rows.select("nome_normalizado", "distancia", F.size(words).alias("palavras")).orderBy("distancia", "palavras", "nome_normalizado").limit(limit)


def relation_links(c: Corpus) -> DataFrame:
    """Current relations with the number and the ordered list of their active links."""
    active = c.links.where(F.col("invalidado_em").isNull() & F.col("medicamento_relacionado").isNotNull()).groupBy(F.col("interacao_id").alias("id"))
    names = active.agg(F.count("*").alias("vinculos_ativos"), F.array_join(F.array_sort(F.collect_list("medicamento_relacionado")), ", ").alias("medicamentos_relacionados"))
    rows = c.relations.join(c.current().select(F.col("id").alias("processamento_id")), "processamento_id", "left_semi")
    return rows.join(names, "id", "left").select("id", "tipo_alvo", F.substring("evidencia", 1, 160).alias("evidencia"), F.coalesce("vinculos_ativos", F.lit(0)).alias("vinculos_ativos"), "medicamentos_relacionados")


def who_cites(c: Corpus, name: str | None = None) -> DataFrame:
    """Origins whose current relations link an entry (any entry if None)."""
    active = c.links.where(F.col("invalidado_em").isNull())
    if name is not None:
        active = active.where(F.col("medicamento_relacionado") == name)
    current = c.relations.join(c.current().select(F.col("id").alias("processamento_id")), "processamento_id", "left_semi")
    rows = active.withColumnRenamed("interacao_id", "id").join(current, "id")
    return rows.groupBy("medicamento_relacionado").agg(F.count("*").alias("citacoes"), F.count_distinct(ORIGIN).alias("origens"))


def literal_evidence(c: Corpus) -> DataFrame:
    """Whether each current relation's evidence is a literal slice of its source."""
    current = c.current().select(F.col("id").alias("processamento_id"), F.col(ORIGIN).alias("nome_normalizado"))
    rows = c.relations.select("id", "processamento_id", "evidencia").join(current, "processamento_id").join(c.source.select("nome_normalizado", "trecho_interacoes"), "nome_normalizado")
    return rows.select("id", (F.instr("trecho_interacoes", F.col("evidencia")) > 0).alias("literal"))


def invalidated_links(c: Corpus) -> DataFrame:
    return c.links.where(F.col("invalidado_em").isNotNull()).select("interacao_id", "medicamento_relacionado", "criterio_vinculo", "invalidado_em")
