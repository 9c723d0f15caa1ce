"""Verdicts on produced relations."""

from marisma.operators import validate
from marisma.schemas import TABLES
from marisma.streaming import incremental
from pyspark.sql import functions as F


def test_verdicts(spark):
    names = TABLES["bulas"].names
    catalog = spark.createDataFrame([tuple({"nome_normalizado": "marevan", "principios_ativos": "varfarina sódica"}.get(c) for c in names)], TABLES["bulas"])
    data = [
        (1, "Digoxina", "PRINCIPIO_ATIVO", "Digoxina aumenta o efeito.", "A digoxina aumenta o efeito.", None),
        (2, "varfarina", "PRINCIPIO_ATIVO", "x", "A varfarina aumenta.", "ALVO_E_ORIGEM"),
        (3, "drogas diversas", "MEDICAMENTO", "x", "Drogas diversas.", "ALVO_GENERICO"),
        (4, "testes da tireoide", "EXAME_LABORATORIAL", "Testes da tireoide alterados.", "Os testes da tireoide são alterados.", None),
        (5, "123", "OUTRO", "x", "y", "ALVO_INVALIDO"),
        (6, None, None, None, None, "ALVO_INVALIDO"),
        (7, "losec", "MEDICAMENTO", "x", "", "EVIDENCIA_NAO_ENCONTRADA"),
        (8, "losec", "MEDICAMENTO", "x", "Outro texto.", "ALVO_AUSENTE_NA_EVIDENCIA"),
        (9, "losec", "MEDICAMENTO", "x", "Losec não foi estudado.", "RELACAO_NAO_POSITIVA"),
        (10, "losec", "MEDICAMENTO", "Losec reduz o efeito.", "Losec aumenta o efeito.", "RESUMO_INVENTA_EFEITO"),
    ]
    df = spark.createDataFrame([(i, "marevan", a, t, r, e, "x") for i, a, t, r, e, _ in data], "id int, medicamento_origem string, alvo string, tipo_alvo string, resumo string, evidencia string, nome_anvisa string")
    assert {r.id: r.motivo for r in validate.target_verdicts(df, catalog).collect()} == {d[0]: d[5] for d in data}
    assert validate.target_verdicts(df.limit(0), catalog).count() == 0


def test_unresolved_and_grounding(spark):
    schema = "alvo string, tipo_alvo string, evidencia string"
    rejected = spark.createDataFrame([("A", "X", "Frase."), ("A", "X", "Outra.")], schema)
    assert [r.evidencia for r in validate.unresolved(rejected, spark.createDataFrame([("a ", "X", "frase.")], schema)).collect()] == ["Outra."]
    row = spark.createDataFrame([("É seguro.", "Pode elevar o risco.")], "s string, e string").select(validate.grounding_flags(F.col("s"), F.col("e")).alias("f")).first().f
    assert (row.ausencia, row.seguranca, row.certeza) == (False, True, True)


def test_windowed_counts(spark, tmp_path):
    data = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "b")]
    spark.createDataFrame(data, "t string, k string").selectExpr("cast(t as timestamp_ntz) t", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp_ntz, k string").parquet(str(tmp_path / "in"))
    query = incremental.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("janelas").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.k, r.n) for r in spark.sql("select k, n from janelas").collect()} == {("a", 2), ("b", 1)}
