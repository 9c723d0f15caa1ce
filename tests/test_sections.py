"""Sections of line documents and short texts of relations."""

import json

from marisma.operators import sections, summaries
from pyspark.sql import functions as F


def doc(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    return sections.line_table(df, "k", "t")


BODY = "O uso com varfarina aumenta o risco de sangramento.\nMonitorar."


def test_section_ends_at_next_main_title(spark):
    text = f"4. CONTRAINDICAÇÕES\nNenhuma.\n5. INTERAÇÕES MEDICAMENTOSAS\n{BODY}\n5.1 Outras\n3. item de lista\n6. ADVERTÊNCIAS\nFim."
    (s,) = sections.sections(doc(spark, text)).collect()
    assert (s.inicio, s.fim, s.estado) == (2, 7, "OK") and s.texto.startswith("5. INTERAÇÕES") and s.texto.endswith("3. item de lista")


def test_title_forms_and_exclusions(spark):
    lines = doc(spark, f"6) Interações\nmedicamentosas\n{BODY}", "Sumário\n5. Interações medicamentosas\nx", "interações medicamentosas ..... 5\n6. Posologia ... 7", "as interações medicamentosas são raras", None, " ")
    got = {(r.doc, r.n, r.linhas, r.numero) for r in sections.title_lines(lines).collect()}
    assert got == {("0", 0, 2, 6)}


def test_states(spark):
    got = {r.doc: r.estado for r in sections.sections(doc(spark, "Interações medicamentosas\nNão se aplica.", "Interações medicamentosas\nx", "Interações medicamentosas\nPosologia e superdose cx 10 mg\nArmazenamento da bula", "Interações medicamentosas\nPosologia\nArmazenamento\n10 02", "Interações medicamentosas\nPosologia e superdose do medicamento\nArmazenamento da bula")).collect()}
    assert got == {"0": "RESPOSTA_CURTA", "1": "SOMENTE_TITULO", "2": "SOMENTE_ROTULOS", "3": "SOMENTE_TITULO", "4": "OK"}


def test_equal_sections_once(spark):
    text = f"5. INTERAÇÕES MEDICAMENTOSAS\n{BODY}\n6. ADVERTÊNCIAS\nx\n5. INTERAÇÕES MEDICAMENTOSAS\n{BODY.upper()}\n6. ADVERTÊNCIAS"
    assert sections.distinct_sections(sections.sections(doc(spark, text))).count() == 1
    assert sections.sections(doc(spark, text).limit(0)).count() == 0


def test_administrative_pages(spark):
    page = "Texto de bula\nNotificação RDC 60\nAssunto\n10/02/2020\n11/03/2021"
    assert [r.pagina for r in sections.administrative_pages(doc(spark, page, "Notificação do paciente")).collect()] == [0]


SCHEMA = "id long, processamento_id long, alvo string, tipo_alvo string, resumo string, evidencia string, resumo_card string, resumo_card_simples string, reescrita_controle string"


def test_origins_lines_units(spark):
    listed = "Inibidores como a, b, c, d, e ou f podem aumentar o efeito."
    data = [
        (1, 1, "digoxina", "P", "A digoxina sobe.", "Digoxina aumenta o efeito.", None, None, None),
        (2, 1, "varfarina", "P", "A varfarina sobe.", listed + " varfarina e losec", "card", "s", '{"publicado":{"status":"CONCLUIDO"}}'),
        (3, 1, "losec", "P", "A losec sobe.", listed + " varfarina e losec", None, None, None),
        (4, 2, "solo", "P", "Sem nome.", listed + " solo", None, None, None),
        (5, 2, None, "P", None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.id: r.origem for r in summaries.card_origins(df).collect()} == {1: "LITERAL", 2: "GERADO", 3: "REAPROVEITADO", 4: "GERADO"}
    lines = {(r.processamento_id, r.linha) for r in summaries.merged_lines(df).collect()}
    assert lines == {(1, "A digoxina, varfarina e losec sobe."), (2, "Sem nome.")}
    assert [(r.lider, r.registros, r.pendentes) for r in summaries.rewrite_units(df).collect()] == [(2, 1, 0)]


def test_consolidation(spark):
    data = [("d", 0, 10, "texto a"), ("d", 2, 8, "dentro"), ("d", 0, 20, "maior"), ("d", 30, 40, "Texto  A"), ("e", 2, 8, "dentro")]
    df = spark.createDataFrame(data, "k string, i int, f int, t string")
    assert {(r.k, r.i, r.f) for r in summaries.consolidated(df, ["k"], "i", "f", "t").collect()} == {("d", 0, 20), ("e", 2, 8)}


def test_checks_and_controls(spark):
    df = spark.createDataFrame([("- item",), ("A digoxina pode elevar o risco de sangramento em idosos.",), ("um dois três quatro " * 4 + ".",)], "t string")
    flags = [r.f for r in df.select(summaries.response_flags(F.col("t")).alias("f")).collect()]
    assert flags[0].lista and flags[0].tamanho and not any(flags[1]) and flags[2].repeticao
    row = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":3},"entrada_invalidada":true}', '{"b":2}')], "a string, b string").select(summaries.json_merge("a", "b").alias("m"), summaries.canonical_hash("a").alias("h1")).first()
    assert json.loads(row.m) == {"a": {"c": 3, "d": 2}, "b": 2}
    same = spark.createDataFrame([('{"x": 1, "y": [2]}',), ('{"y":[2],"x":1}',), ("quebrado",), (None,)], "a string").select(summaries.canonical_hash("a").alias("h")).collect()
    assert same[0].h == same[1].h and same[2].h is None and same[3].h is None


def test_references_chapters_and_carried_pages(spark):
    lines = doc(
        spark, f"5. INTERAÇÕES MEDICAMENTOSAS\n{BODY} (vide item 5.\nADVERTÊNCIAS E PRECAUÇÕES).\nMais texto sobre o uso.\n6. POSOLOGIA\nx",
        f"3. CARACTERÍSTICAS FARMACOLÓGICAS\nInterações medicamentosas\n{BODY}\n5. INTERAÇÕES MEDICAMENTOSAS\n{BODY}\n6. POSOLOGIA",
    )
    got = {(r.doc, r.inicio, r.fim) for r in sections.sections(lines).collect()}
    assert got == {("0", 0, 5), ("1", 4, 7)}
    pages = spark.createDataFrame([("a", 0, 0, "x", "texto de bula notificacao rdc assunto 10/02/2020 11/03/2021"), ("a", 1, 1, "x", "vp vps 12"), ("a", 2, 2, "x", "texto comum"), ("a", 3, 3, "x", "vp vps 12")], "doc string, pagina int, n int, texto string, normal string")
    assert {r.pagina for r in sections.administrative_pages(pages).collect()} == {0, 1}


def test_status_of_documents(spark):
    lines = doc(spark, f"5. INTERAÇÕES MEDICAMENTOSAS\n{BODY}\n6. ADVERTÊNCIAS", "Um texto comum sem o título da seção procurada aqui.", "Interações medicamentosas\nPosologia\nArmazenamento\n" + "1 " * 30, "curto", "Um texto comum sem o título da seção procurada aqui.")
    docs = spark.createDataFrame([(str(i), "ERRO_OCR" if i == 5 else None, 1 if i == 4 else 0) for i in range(6)], "doc string, falha string, paginas_ocr int")
    got = {r.doc: r.status for r in sections.extraction_status(docs, lines).collect()}
    assert got == {"0": "CONCLUIDO", "1": "SEM_SECAO_INTERACOES", "2": "SECAO_SOMENTE_TITULO", "3": "PDF_SEM_TEXTO", "4": "REVISAO_MANUAL", "5": "ERRO_OCR"}
    none = spark.createDataFrame([], "doc string, inicio int")
    assert {r.status for r in sections.extraction_status(docs.where("doc = '0'"), lines, none).collect()} == {"REVISAO_MANUAL"}


def test_candidates_and_compositions(spark):
    found = spark.createDataFrame([("a", 3, "BAIXA"), ("a", 3, "ALTA"), ("a", 9, "MEDIA"), ("b", 1, "BAIXA")], "doc string, linha int, confianca string")
    assert {tuple(r) for r in sections.chosen_candidate(found).collect()} == {("a", 3, "ALTA", True), ("b", 1, "BAIXA", False)}
    choice = spark.createDataFrame([("a", 9)], "doc string, linha int")
    assert ("a", 9, "MEDIA", True) in {tuple(r) for r in sections.chosen_candidate(found, choice).collect()}
    lines = doc(spark, "COMPOSIÇÃO\nCada mL contém:\ncloridrato de lidocaína ... 50 mg\nglicose ... 75 mg\n1. INDICAÇÕES\nx", "COMPOSIÇÃO\nsem fim")
    assert [(r.doc, r.inicio, r.fim) for r in sections.composition_sections(lines).collect()] == [("0", 0, 4)]
