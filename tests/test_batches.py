"""Batches from pending sources to appended tables, the command line, the function registry, writes."""

import pytest

from marisma.__main__ import run
from marisma.functions import registry
from marisma.operators import answers, explain, queue, selections, writes
from marisma.plans import batches
from marisma.schemas import TABLES
from marisma.session import join_back, table
from pyspark.sql import functions as F

ENTRIES = [("marevan", "varfarina sódica"), ("digoxina generica", "digoxina"), ("losec", "omeprazol")]
TEXTS = [("marevan", "A digoxina aumenta o efeito. O omeprazol reduz o efeito."), ("losec", "Anticoagulantes e alimentos."), ("digoxina generica", "  ")]


@pytest.fixture
def folder(spark, tmp_path):
    def save(name, rows):
        names = TABLES[name].names
        spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")

    save("bulas", [{"nome_normalizado": n, "principios_ativos": p, "status": "CONCLUIDO", "composicao": "x", "numero_registro": "12"} for n, p in ENTRIES])
    save("bulas_interacoes", [{"nome_normalizado": n, "trecho_interacoes": t, "status_extracao": "CONCLUIDO"} for n, t in TEXTS])
    for name in ("processamentos_interacoes", "interacoes", "interacoes_medicamentos"):
        save(name, [])
    return str(tmp_path)


def test_batch_is_appended_once(spark, folder, capsys):
    assert run(["--data", folder, "identify", "--dry-run"]) == 0
    assert table(spark, folder, "processamentos_interacoes").count() == 0
    assert run(["--data", folder, "identify"]) == 0
    runs = {(r.id, r.medicamento_origem, r.status, r.quantidade_relacoes) for r in table(spark, folder, "processamentos_interacoes").collect()}
    assert runs == {(1, "losec", "CONCLUIDO_SEM_RELACOES", 0), (2, "marevan", "CONCLUIDO_COM_RELACOES", 2)}
    relations = {(r.alvo, r.processamento_id, r.evidencia) for r in table(spark, folder, "interacoes").collect()}
    assert relations == {("digoxina", 2, "A digoxina aumenta o efeito."), ("omeprazol", 2, "O omeprazol reduz o efeito.")}
    assert {r.medicamento_relacionado for r in table(spark, folder, "interacoes_medicamentos").collect()} == {"losec", "digoxina generica"}
    c = answers.Corpus.load(spark, folder)
    again = batches.identification(c)
    assert again.report.count() == 0 and not batches.has_work(again.runs)
    assert {r.acao for r in batches.relink(c).collect()} == {"MANTER"}
    assert {r.motivo for r in batches.identification(c, version="outra").refused.collect()} == set()
    assert run(["--data", folder, "ask", "losec", "marevan"]) == 0 and "true" in capsys.readouterr().out
    assert run(["--data", folder, "ask", "losec", "nada"]) == 4 and run(["--data", folder, "ask", "losec", "LOSEC "]) == 2
    for command in (["relink"], ["summaries"], ["extract"], ["check"]):
        assert run(["--data", folder, *command]) == 0


def test_refusals_by_source_and_version(spark, folder):
    run(["--data", folder, "identify"])
    c = answers.Corpus.load(spark, folder)
    new = spark.createDataFrame([("losec", batches.current_version(c), "x"), ("nada", "v", "x"), ("marevan", "v", "velho")], "medicamento_origem string, versao_processamento string, hash_texto string")
    none = spark.createDataFrame([], "medicamento_origem string, ordem int, alvo string")
    links = spark.createDataFrame([], "medicamento_origem string, ordem int, medicamento_relacionado string, criterio_vinculo string")
    refused = writes.append_result(c.runs, c.relations, c.links, c.current(), c.source, new, none, links)[3]
    assert {tuple(r) for r in refused.collect()} == {("losec", "FONTE_ALTERADA"), ("nada", "FONTE_AUSENTE"), ("marevan", "FONTE_ALTERADA")}


def test_registered_functions(spark):
    assert "mr_fold_name" in registry.register(spark)
    row = spark.sql("SELECT mr_fold_name(' ÁCIDO  Fólico ') AS a, mr_blank('  ') AS b, mr_filled('\n') AS c, mr_list_of('x; ;y') AS d, mr_contains_term('uso de ab c', 'ab') AS e, mr_unit_norm(array(3f, 4f)) AS f, size(mr_units('Um. Dois')) AS g").first()
    assert tuple(row) == ("acido folico", True, False, ["x", "y"], True, 5.0, 2)


def test_ids_are_consecutive_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(writes, "NUMBERED", 10)
    df = spark.range(95).select(F.pmod(F.col("id") * 37, F.lit(101)).alias("x"))
    rows = writes.assign_ids(df, ["x"], 7).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.x)] == list(range(8, 103))


def test_hot_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([("a", i) for i in range(200)] + [(f"k{i}", i) for i in range(50)] + [("só", 1)], "k string, i int")
    keyed = spark.createDataFrame([("a", "A")] + [(f"k{i}", str(i)) for i in range(60)], "k string, v string")
    for most in (1000, 3):
        assert join_back(rows, keyed, ["k"], most).count() == 250


def test_tables_are_created_once(spark, tmp_path):
    path = str(tmp_path / "novas")
    assert writes.ensure_tables(spark, path) == [] and writes.ensure_tables(spark, path) == []
    spark.createDataFrame([(1,)], "id int").write.mode("overwrite").parquet(f"{path}/bulas.parquet")
    assert any("bulas.nome_normalizado" in x for x in writes.ensure_tables(spark, path))


def test_questions_and_suggestions(spark, folder):
    c = answers.Corpus.load(spark, folder)
    assert [tuple(r) for r in explain.suggestions(c, "lose").collect()] == [("losec", "LITERAL")]
    assert [tuple(r) for r in explain.suggestions(c, "maravan").collect()] == [("marevan", "APROXIMADA")]
    assert explain.suggestions(c, "zzzzzz").count() == 0
    key = c.catalog.select(F.conv(F.substring(F.sha2("nome_normalizado", 256), 1, 15), 16, 10).cast("long").alias("chave")).where("chave % 2 >= 0").limit(1)
    assert explain.busy_entries(key, c.catalog).count() == 1
    with pytest.raises(explain.InvalidRequest):
        explain.checked_page(0, 5)
    assert selections.extraction_needs(c.catalog, c.source).count() == 0 and selections.extraction_needs(c.catalog, c.source, True).count() == 3
    files = spark.createDataFrame([("/x/losec_12_profissional.pdf",)], "path string")
    assert [r.nome_normalizado for r in batches.done_files(c.catalog, files).collect()] == ["losec"]
    stages = spark.createDataFrame([("COLETA", True), ("COLETA", False), ("CONCLUIDO", True)], "s string, ok boolean")
    assert [r.x for r in stages.select(queue.next_stage(F.col("s"), F.col("ok")).alias("x")).collect()] == ["EXTRACAO", "COLETA", "CONCLUIDO"]
