"""Readers, writers and the incremental runner."""

import pytest

from marisma.schemas import TABLES
from marisma.sources import tables
from marisma.streaming import incremental


def test_names_and_terms(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Nome;Registro\nFinasterida;1\nFINASTERIDA;2\nÁcido Fólico;3\nacido   folico;4\n ; \n", encoding="utf-8")
    names = tables.read_names(spark, str(tmp_path / "n.csv"), "Nome").orderBy("ordem").collect()
    assert [(r.nome, r.original, r.vezes) for r in names] == [("finasterida", "Finasterida", 2), ("acido folico", "Ácido Fólico", 2)]
    (tmp_path / "e.csv").write_text("Nome;Registro\n ;5\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Nome"):
        tables.read_names(spark, str(tmp_path / "e.csv"), "Nome")
    (tmp_path / "t.txt").write_text("# nota\nÁgua # comum\n\nágua\n", encoding="utf-8")
    assert [r.termo for r in tables.read_terms(spark, str(tmp_path / "t.txt")).collect()] == ["agua"]


def test_pdf_magic(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nada")
    assert [r.path.rsplit("/", 1)[1] for r in tables.read_pdfs(spark, str(tmp_path)).collect()] == ["a.pdf"]


def test_report_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    tables.write_report(df, str(tmp_path / "r"), ["k"])
    with pytest.raises(Exception, match="exists"):
        tables.write_report(df, str(tmp_path / "r"))


def test_incremental_batches(spark, tmp_path):
    schema = TABLES["interacoes_medicamentos"]
    for i in range(3):
        spark.createDataFrame([(i, "x", None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.source_stream(spark, str(tmp_path / "in"), "interacoes_medicamentos", 1)
    query = incremental.process_pending(stream, lambda b: b.select("interacao_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    again = incremental.process_pending(incremental.source_stream(spark, str(tmp_path / "in"), "interacoes_medicamentos", 1), lambda b: b.select("interacao_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    again.awaitTermination(120)
    assert sorted(r.interacao_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_a_source_delivered_again_is_processed_once(spark, tmp_path):
    schema = TABLES["bulas_interacoes"]
    for text in ("um", "um", "dois"):
        spark.createDataFrame([tuple({"nome_normalizado": "x", "trecho_interacoes": text}.get(c) for c in schema.names)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.source_stream(spark, str(tmp_path / "in"), "bulas_interacoes", 1)
    query = incremental.process_pending(stream, lambda b: b.select("trecho_interacoes"), str(tmp_path / "out"), str(tmp_path / "ck"), version="v1")
    query.awaitTermination(120)
    assert sorted(r.trecho_interacoes for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["dois", "um"]
