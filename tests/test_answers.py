"""Relational core on small fixtures."""

from datetime import datetime

import pytest

from marisma import queries
from marisma.operators import answers, audit, writes
from marisma.plans import runs
from marisma.schemas import TABLES, run_checks, schema_differences

T0 = datetime(2024, 1, 1)


def frame(spark, name, data):
    schema = TABLES[name]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in data], schema)


@pytest.fixture
def corpus(spark):
    text = "Digoxina aumenta o efeito."
    catalog = [dict(nome_normalizado=n, status=s, principios_ativos=p) for n, s, p in (("marevan", "CONCLUIDO", "varfarina sódica"), ("digoxina", "CONCLUIDO", "digoxina"), ("losec", "CONCLUIDO", "omeprazol"), ("sem bula", "SEM_BULA", None), ("pendente", "CONCLUIDO", None))]
    source = [dict(nome_normalizado=n, trecho_interacoes=t, status_extracao=s) for n, t, s in (("marevan", text, "CONCLUIDO"), ("digoxina", text, "CONCLUIDO"), ("losec", text, "CONCLUIDO"), ("pendente", " ", "CONCLUIDO"))]
    run = lambda i, o, s, inv=None: dict(id=i, medicamento_origem=o, status=s, versao_processamento="v1", quantidade_janelas=1, janelas_concluidas=1, quantidade_relacoes=1, concluido_em=T0, invalidado_em=inv)
    history = [run(1, "marevan", "CONCLUIDO_COM_RELACOES"), run(2, "marevan", "FALHA"), run(3, "digoxina", "CONCLUIDO_SEM_RELACOES"), run(4, "losec", "CONCLUIDO_COM_RELACOES", T0), run(5, "losec", "CONCLUIDO_SEM_RELACOES")]
    rel = lambda i, o, p, a, t, e: dict(id=i, medicamento_origem=o, processamento_id=p, alvo=a, tipo_alvo=t, resumo="resumo", evidencia=e)
    relations = [
        rel(1, "marevan", 1, "Digoxina", "PRINCIPIO_ATIVO", "Digoxina aumenta o efeito."),
        rel(2, "marevan", 1, "digoxina", "PRINCIPIO_ATIVO", "digoxina  aumenta o EFEITO."),
        rel(3, "marevan", 1, "Antiácidos", "CLASSE_FARMACOLOGICA", "Antiácidos reduzem o efeito."),
        rel(4, "marevan", 1, "Losec", "MEDICAMENTO", "Losec não foi estudado."),
    ]
    links = [dict(interacao_id=1, medicamento_relacionado="digoxina", criterio_vinculo="PRINCIPIO_ATIVO_EXATO"), dict(interacao_id=2, medicamento_relacionado="digoxina", criterio_vinculo="PRINCIPIO_ATIVO_EXATO"), dict(interacao_id=4, medicamento_relacionado="losec", criterio_vinculo="NOME_MEDICAMENTO_EXATO", invalidado_em=T0)]
    return answers.Corpus(frame(spark, "bulas", catalog), frame(spark, "bulas_interacoes", source), frame(spark, "processamentos_interacoes", history), frame(spark, "interacoes", relations), frame(spark, "interacoes_medicamentos", links))


def test_failure_keeps_previous_run(corpus, rows):
    assert rows(corpus.current().select("medicamento_origem", "id")) == [("digoxina", 3), ("losec", 5), ("marevan", 1)]


def test_states(corpus):
    got = {r.nome_normalizado: (r.estado, r.conclusiva) for r in answers.states(corpus).collect()}
    assert got == {"marevan": ("CONCLUIDO_COM_RELACOES", True), "digoxina": ("CONCLUIDO_SEM_RELACOES", True), "losec": ("CONCLUIDO_SEM_RELACOES", True), "sem bula": ("SEM_BULA", False), "pendente": ("EXTRACAO_INDISPONIVEL", False)}


def test_pair_groups_and_verdicts(spark, corpus):
    pairs = spark.createDataFrame([("digoxina", "marevan"), ("losec", "marevan"), ("digoxina", "losec"), ("marevan", "pendente"), ("losec", "losec")], "a string, b string")
    groups = [(r.a, r.b, r.especie, r.itens, r.ids) for r in answers.pair_evidence(corpus, pairs).collect()]
    assert ("digoxina", "marevan", "ESPECIFICA", 1, "1") in groups
    verdict = {(r.a, r.b): r.identificada for r in answers.pair_verdicts(corpus, pairs).collect()}
    assert verdict == {("digoxina", "marevan"): True, ("losec", "marevan"): False, ("digoxina", "losec"): False, ("marevan", "pendente"): None}


def test_pages_make_the_whole(corpus):
    pages = [r.id for p in (1, 2, 3) for r in answers.single_page(corpus, None, p, 2).orderBy("posicao").collect()]
    assert pages == [1, 2, 3]
    with pytest.raises(ValueError):
        answers.single_page(corpus, None, 0, 2)


def test_coverage(corpus):
    row = answers.coverage(corpus).first()
    assert (row.elegiveis, row.concluidas, row.em_revisao, row.lista_exaustiva) == (3, 3, 0, True)


def test_empty_corpus(spark, corpus):
    empty = answers.Corpus(*(x.limit(0) for x in (corpus.catalog, corpus.source, corpus.runs, corpus.relations, corpus.links)))
    assert answers.states(empty).count() == 0 and answers.pair_evidence(empty, answers.cited_pairs(empty)).count() == 0
    assert answers.coverage(empty).first().elegiveis == 0


def test_suggestions(corpus, rows):
    assert [r.nome_normalizado for r in answers.suggest(corpus, "ose").collect()] == ["losec"]
    assert [r.nome_normalizado for r in answers.suggest_fuzzy(corpus, "digoksina").collect()] == ["digoxina"]


def test_rerun_appends_nothing(corpus):
    incoming = corpus.runs.select("medicamento_origem", "versao_processamento").distinct()
    assert writes.new_runs(runs.registered_runs(corpus.runs, corpus.source), incoming).count() == 0


def test_sync_links(spark, corpus):
    desired = spark.createDataFrame([(1, "digoxina", "PRINCIPIO_ATIVO_EXATO"), (4, "losec", "NOME_MEDICAMENTO_EXATO"), (3, "novo", None)], "interacao_id long, medicamento_relacionado string, criterio_vinculo string")
    got = {(r.interacao_id, r.acao) for r in writes.sync_links(desired, corpus.links).collect()}
    assert got == {(1, "MANTER"), (2, "INVALIDAR"), (4, "REATIVAR"), (3, "CRIAR")}


def test_ids_are_consecutive(spark):
    df = spark.createDataFrame([(str(i % 7), i) for i in range(100)], "a string, b long")
    out = writes.assign_ids(df, ["a", "b"], 50).orderBy("id").collect()
    assert [r.id for r in out] == list(range(51, 151)) and [(r.a, r.b) for r in out] == sorted((r.a, r.b) for r in out)


def test_checks_let_null_pass(spark, corpus):
    bad = corpus.runs.limit(1).selectExpr("*").replace("CONCLUIDO_COM_RELACOES", "OUTRO")
    assert {r.regra for r in audit.check_violations(bad, "id", run_checks()).collect()} == {"status"}
    assert audit.check_violations(corpus.runs, "id", run_checks()).where("regra <> 'relacoes'").count() == 0


def test_schema_differences(corpus):
    assert schema_differences(corpus.links, "interacoes_medicamentos") == []
    assert schema_differences(corpus.links.drop("invalidado_em"), "interacoes_medicamentos") == [("invalidado_em", "timestamp_ntz", None)]


def test_amounts_lost_by_summaries(spark, tmp_path):
    data = [(1, "Use 5 mg.", "Use 5 mg ou 2.5 ml."), (2, None, "Use 7 mg."), (3, "Use 7 mg.", None), (4, "nada", "nada")]
    spark.createDataFrame(data, "id long, resumo string, evidencia string").write.parquet(f"{tmp_path}/interacoes.parquet")
    got = {r.id: r.perdidas for r in queries.queries()["summary_missing_numbers"](spark, str(tmp_path)).collect()}
    assert got == {1: "2,5", 2: "7", 3: None, 4: ""}
