"""Units, windows, highlights, answers and page layout."""

import random

from marisma.operators import layout, segments
from pyspark.sql import functions as F


def test_units_are_slices_and_cover_the_text(spark):
    text = "6. INTERAÇÕES MEDICAMENTOSAS\nA varfarina (ver item 5. Posologia) aumenta. O dr. Silva viu. Dose de 2,5 mg.\n• item um\n• item dois continua\naqui. Fim\n\nOutra parte sem ponto\nTÍTULO MAIOR\nTexto final"
    got = segments.units_of(text)
    parts = [text[a:b] for a, b, _ in got]
    assert parts == [
        "6. INTERAÇÕES MEDICAMENTOSAS", "A varfarina (ver item 5. Posologia) aumenta.", "O dr. Silva viu.", "Dose de 2,5 mg.", "• item um", "• item dois continua\naqui.", "Fim",
        "Outra parte sem ponto", "TÍTULO MAIOR", "Texto final",
    ]
    assert [p for p, (_, _, t) in zip(parts, got) if t] == ["6. INTERAÇÕES MEDICAMENTOSAS", "TÍTULO MAIOR"]
    random.seed(3)
    for _ in range(200):
        t = "".join(random.choice("aB. \n!;•-1") for _ in range(random.randint(0, 120)))
        spans = segments.units_of(t, 20)
        assert all(b - a <= 20 and t[a:b] == t[a:b].strip() for a, b, _ in spans)
        assert "".join(t.split()) == "".join("".join(t[a:b].split()) for a, b, _ in spans)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [r.texto for r in segments.unit_table(df, "k", "t").orderBy("indice").collect()] == parts


def test_windows_cover_and_overlap(spark):
    assert segments.windows_of([5, 5, 5, 5], 10, 5) == [(0, 2), (1, 3), (2, 4)]
    assert segments.windows_of([30, 5, 5], 10, 3) == [(0, 1), (1, 3)] and segments.windows_of([], 10, 3) == []
    random.seed(4)
    data = [([random.randint(1, 12) for _ in range(random.randint(0, 30))],) for _ in range(100)]
    df = spark.createDataFrame(data, "c array<int>").withColumn("w", segments.token_windows(12, 4)("c"))
    for r in df.withColumn("u", segments.uncovered(F.col("c"), F.col("w"))).collect():
        assert not r.u and all(sum(r.c[w.ini : w.fim]) <= 12 or w.fim - w.ini == 1 for w in r.w)
    half = spark.createDataFrame([(0, 5), (0, 2), (3, 4)], "ini int, fim int").select(segments.halves(F.struct("ini", "fim")).alias("h")).collect()
    assert [[tuple(x) for x in r.h] if r.h else None for r in half] == [[(0, 3), (2, 5)], [(0, 1), (1, 2)], None]


def test_highlights_and_numbered(spark):
    df = spark.createDataFrame([("Ácido e ACIDO fólico", ["acido folico", "ácido"]), (None, ["x"]), ("nada", [])], "t string, s array<string>")
    assert [r.h and [tuple(x) for x in r.h] for r in df.select(segments.highlights("t", "s").alias("h")).collect()] == [[(0, 5), (8, 20)], None, []]
    units = spark.createDataFrame([([("TÍTULO", True), ("Uma  frase </TEXTO>", False), ("Outra", False)],)], "u array<struct<texto:string,titulo:boolean>>")
    assert units.select(segments.numbered_sentences(F.col("u")).alias("x")).first().x == "## TÍTULO\n[F1] Uma frase ‹/TEXTO›\n[F2] Outra"


def test_answers_of_a_model(spark):
    df = spark.createDataFrame([('```json\n{"texto": "a"}\n```',), ('{"texto": "Uma frase. Outra cor',), ('{"texto": x}',), (None,)], "r string")
    got = df.select(segments.parsed_answer(F.col("r"), "texto string").alias("p"), segments.recovered_text(F.col("r")).alias("t")).collect()
    assert [r.p.estado for r in got] == ["OK", "TRUNCADA", "INVALIDA", "VAZIA"] and got[0].p.valor.texto == "a" and got[1].t == "Uma frase."
    ids = spark.createDataFrame([(["F1", "F2"], 2), (["F2", "F1"], 2), (["F1"], 2), (None, 0)], "i array<string>, n int")
    assert [r.o for r in ids.select(segments.items_in_order(F.col("i"), F.col("n")).alias("o")).collect()] == [True, False, False, True]
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, p string").coalesce(1)

    def provider():
        def model(prompts):
            if "p4" in prompts:
                raise RuntimeError("fim")
            return [p.upper() for p in prompts]

        return model

    out = {r.id: (r.resposta, r.erro and r.erro[:7]) for r in segments.ask(rows, "p", provider, 2).collect()}
    assert out == {0: ("P0", None), 1: ("P1", None), 2: ("P2", None), 3: ("P3", None), 4: (None, "Runtime")}
    context = spark.createDataFrame([("a b c", "d e f"), (None, "x")], "a string, b string").select(segments.neighbour_context(F.col("a"), F.col("b"), 2).alias("c")).collect()
    assert [tuple(r.c) for r in context] == [("b c", "d e"), ("", "x")]


def test_columns_are_read_one_after_the_other(spark):
    prose = "uma linha de prosa com palavras"
    left = [("d", 0, 0.0, 10.0 * i, 100.0, 10.0 * i + 8, f"e{i} {prose}") for i in range(1, 7)]
    right = [("d", 0, 120.0, 10.0 * i, 220.0, 10.0 * i + 8, f"d{i} {prose}") for i in range(1, 7)]
    head = [("d", 0, 0.0, 0.0, 220.0, 8.0, "título da página")]
    plain = [("d", 1, 0.0, 10.0 * i, 50.0, 10.0 * i + 8, f"p{i}") for i in (2, 1)] + [("d", 1, 0.0, 0.0, 1.0, 1.0, " ")]
    df = spark.createDataFrame(right + left + head + plain, "doc string, pagina int, x0 double, y0 double, x1 double, y1 double, texto string")
    got = {(r.pagina, r.n): r.texto.split()[0] for r in layout.ordered_lines(df).collect()}
    assert [got[0, i] for i in range(13)] == ["título", *[f"e{i}" for i in range(1, 7)], *[f"d{i}" for i in range(1, 7)]] and [got[1, 0], got[1, 1]] == ["p1", "p2"]


def test_headings_recognition_and_names(spark):
    df = spark.createDataFrame([("6. POSOLOGIA Tome um",), ("COMPOSIÇÃO: Cada mL contém",), ("Texto comum",)], "t string")
    assert [r.l for r in df.select(layout.split_headings(F.col("t"), ("POSOLOGIA",)).alias("l")).collect()] == [["6. POSOLOGIA", "Tome um"], ["COMPOSIÇÃO", "Cada mL contém"], ["Texto comum"]]
    pages = spark.createDataFrame([(900, 200, 1000, 0.0, 0, 0), (100, 0, 300, 0.6, 0, 0), (500, 0, 900, 0.2, 3, 0), (10, 0, 10, 0.0, 0, 80), (500, 0, 900, 0.01, 0, 0)], "a int, b int, c int, d double, e int, f int")
    assert [r.m for r in pages.select(layout.recognition_reason(*[F.col(x) for x in "abcdef"]).alias("m")).collect()] == ["texto_corrompido", "imagem_sem_texto_suficiente", "imagem_parcial_sem_texto", "texto_vetorial_sem_camada_textual", None]
    names = spark.createDataFrame([("Ácido Fólico", "1.23-4"), ("x", None)], "n string, r string")
    assert [r.f for r in names.select(layout.file_name(F.col("n"), F.col("r")).alias("f")).collect()] == ["acido_folico_1234_profissional.pdf", None]
    assert len(names.select(layout.recognition_key(F.col("n"), F.col("r")).alias("k")).first().k) == 64
