"""Repair of scanned text."""

import random

from marisma.llm import scans

WORDS = "o uso concomitante pode causar diferença acentuada durante tratamento monitorar função médico responsável pacientes insuficiência renal observar sinais".split()


def corpus():
    random.seed(7)
    out = []
    for i in range(300):
        words = [random.choice(WORDS) for _ in range(30)]
        words[5] = "recomenda-se"
        out.append(("t", str(i), " ".join(words) + ".", None))
    return out


def wrap(text, width=40):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return [*lines, line]


def test_damage_and_repair(spark):
    data = corpus()
    clean = {k: t for _, k, t, _ in data}
    want = set()
    damaged = []
    for n, (_, k, t, x) in enumerate(data):
        if n % 6 == 0:
            lines = wrap(t)
            lines.insert(2, "Laboratório Fictício – Bula")
            lines.insert(3, str(n))
            want.add((k, "cabecalho_rodape"))
            t = "\n".join(lines)
        elif n % 6 == 1 and "tratamento" in t:
            t = t.replace("tratamento", "trata-\nmento", 1)
            want.add((k, "hifenizacao"))
        elif n % 6 == 2 and "diferença" in t:
            t = t.replace("diferença", "diferen¬\nça", 1)
            want.add((k, "hifenizacao"))
        elif n % 30 == 3 and "pacientes" in t:
            t = t.replace("pacientes", "pacicntes", 1)
            want.add((k, "caractere"))
        elif n % 6 == 4:
            t = t.replace("recomenda-se", "recomenda-\nse", 1)
        damaged.append(("t", k, t, x))
    damaged += [("t", "nulo", None, None), ("t", "vazio", "", None), ("t", "longo", "uso " * 30_000, None)]
    df = spark.createDataFrame(damaged, "tabela string, chave string, texto string, linha string")
    repair = scans.Repair(df)
    assert {(r.chave, r.defeito) for r in repair.damage().collect()} == want
    text = {r.chave: r.texto for r in repair.repaired().collect()}
    assert {k: text[k] for k in clean} == clean and "nulo" not in text


def test_copies_do_not_make_a_misread_word_frequent(spark, monkeypatch):
    data = [(t, k, x.replace("pacientes", "pacicntes") if int(k) % 30 == 3 else x) for t, k, x, _ in corpus()]
    wrong = next(x for _, _, x in data if "pacicntes" in x)
    again = [wrong] * 100 + [wrong.upper()] * 20 + [wrong.replace(" ", "\n", 3)] * 20
    data += [("t", f"c{i}", x) for i, x in enumerate(again)]
    want = {k for _, k, x in data if "pacicntes" in x.lower()}
    assert len(want) > 140
    df = spark.createDataFrame(data, "tabela string, chave string, texto string")
    assert {r.chave for r in scans.Repair(df).damage().where("defeito = 'caractere'").collect()} == want
    known = spark.createDataFrame([("pacientes",)], "palavra string")
    monkeypatch.setattr(scans, "MAX_BROADCAST_ROWS", 0)
    assert {r.chave for r in scans.Repair(df, known).damage().where("defeito = 'caractere'").collect()} == want


def test_known_words_are_right(spark):
    data = corpus() + [("t", "n1", "pacicntes pode causar sinais", None)]
    df = spark.createDataFrame(data, "tabela string, chave string, texto string, linha string")
    known = spark.createDataFrame([("pacicntes",)], "palavra string")
    assert scans.Repair(df, known).damage().count() == 0
    assert scans.Repair(df).damage().count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "tabela string, chave string, texto string")
    assert scans.Repair(df).damage().count() == 0
