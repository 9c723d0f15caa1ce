"""Roles of composition values."""

from marisma.operators import composition


def test_roles_and_names(spark):
    values = [
        "Cada mL contém:", "cloridrato de lidocaína ... 50 mg", "glicose 75 mg/mL (equivalente a 70 mg de base)", "água purificada q.s.p. 1 mL", "talco",
        "Excipientes: amido", "corante 2 mg", "Cada ampola contém:", "Lidocaína 10 mg", "lidocaína 10 mg", None,
    ]
    df = spark.createDataFrame([("b", i, v, "x") for i, v in enumerate(values)], "k string, n int, valor string, nome string").drop("nome")
    got = composition.classify(df, "k", "n", "valor")
    rows = {r.n: (r.nome, r.dose, r.papel) for r in got.collect()}
    assert rows[1] == ("cloridrato de lidocaína", "50 mg", "ATIVO") and rows[2] == ("glicose", "75 mg/mL", "ATIVO")
    assert [rows[i][2] for i in range(10)] == ["ROTULO", "ATIVO", "ATIVO", "EXCIPIENTE", "EXCIPIENTE", "ROTULO", "EXCIPIENTE", "ROTULO", "ATIVO", "ATIVO"] and 10 not in rows
    assert [r.principios_ativos for r in composition.active_ingredients(got, "k", "n").collect()] == ["cloridrato de lidocaína; glicose; Lidocaína"]
    names = spark.createDataFrame([("b", "lidocaína"), ("b", None)], "k string, valor string")
    assert [r.nome for r in composition.unnamed_actives(got, "k", names, "valor").collect()] == ["glicose"]
    assert composition.classify(df.limit(0), "k", "n", "valor").count() == 0
