"""Dictionary matching and its rules on hand-written texts."""

import random

import pytest

from marisma.operators import catalog, chunks, identify, passages
from marisma.schemas import TABLES
from pyspark.sql import functions as F

ENTRIES = [
    ("marevan", "varfarina sódica"), ("varfarina generico", "varfarina"), ("aas", "ácido acetilsalicílico"),
    ("cordarex", "cloridrato de amiodarona"), ("digoxina", "digoxina"), ("produto teste", "substancia teste"), ("lurasidona", "lurasidona"), ("lur", "lurasidona"),
]


@pytest.fixture
def entries(spark):
    names = TABLES["bulas"].names
    return spark.createDataFrame([tuple({"nome_normalizado": n, "principios_ativos": p, "status": "CONCLUIDO"}.get(c) for c in names) for n, p in ENTRIES], TABLES["bulas"])


def found(spark, entries, text, origin="produto teste"):
    source = spark.createDataFrame([(origin, text)], "nome_normalizado string, trecho_interacoes string")
    return {(r.termo, r.motivo) for r in identify.identify(source, entries).collect()}


def test_longest_and_dehyphenated(spark, entries):
    got = found(spark, entries, "O uso com ácido acetil-\nsalicílico e com cloridrato de amiodarona exige cautela.")
    assert got == {("acido acetilsalicilico", None), ("cloridrato de amiodarona", None)}


def test_own_origin_and_negation(spark, entries):
    assert found(spark, entries, "A varfarina e o Marevan aumentam o efeito da digoxina.", "marevan") == {("varfarina", "ALVO_E_ORIGEM"), ("marevan", "ALVO_E_ORIGEM"), ("digoxina", None)}
    assert ("digoxina", "RELACAO_NAO_POSITIVA") in found(spark, entries, "Não foram observadas interações com a digoxina.")
    assert ("digoxina", "RELACAO_NAO_POSITIVA") in found(spark, entries, "Evite glicosídeos, exceto a digoxina.")
    assert ("digoxina", None) in found(spark, entries, "Evite glicosídeos, exceto um; a digoxina aumenta.")
    text = "Não foram observadas interações com a digoxina; a amiodarona aumenta os níveis da origem. A varfarina não alterou a farmacocinética da origem."
    assert found(spark, entries, text) == {("digoxina", "RELACAO_NAO_POSITIVA"), ("amiodarona", None), ("varfarina", "RELACAO_NAO_POSITIVA")}
    far = "Tabela sem pontuação " + "coluna " * 60
    assert ("digoxina", None) in found(spark, entries, f"Não houve interação com x {far} digoxina {far}")


def test_same_substance_and_acronym(spark, entries):
    assert ("lurasidona", "ALVO_E_ORIGEM") in found(spark, entries, "Evite lurasidona.", "lur")
    assert found(spark, entries, "O uso com Marevan® aumenta o efeito. Evite AAS. Use um aas qualquer.") == {("marevan", None), ("aas", None)}
    assert found(spark, entries, "EVITE AAS E OUTROS.") == set()


def test_ignored_contextual_enantiomer_and_excipients(spark, entries):
    names = TABLES["bulas"].names
    more = [("litocit", "citrato de potássio"), ("calcio d", "cálcio"), ("limiar", "limiaril"), ("levox", "levocetirizina"), ("zyr", "cetirizina")]
    rows = entries.unionByName(spark.createDataFrame([tuple({"nome_normalizado": n, "principios_ativos": p, "status": "CONCLUIDO"}.get(c) for c in names) for n, p in more], TABLES["bulas"]))
    assert found(spark, rows, "Reduz o limiar convulsivo.") == {("limiar", "ALVO_GENERICO")}
    assert found(spark, rows, "Os níveis séricos de cálcio caem.") == {("calcio", "ALVO_GENERICO")}
    assert found(spark, rows, "Suplementos de cálcio reduzem a absorção.") == {("calcio", None)}
    assert found(spark, rows, "A cetirizina aumenta o efeito.", "levox") == {("cetirizina", "ALVO_E_ORIGEM")}
    assert found(spark, rows, "Atenção: contém o corante digoxina.") == {("digoxina", "ALVO_GENERICO")}


def test_list_item_and_links(spark, entries):
    source = spark.createDataFrame([("produto teste", "6. INTERAÇÕES MEDICAMENTOSAS\n- Varfarina: aumento do risco de sangramento."), ("marevan", "  "), ("digoxina", "Anticoagulantes e alimentos.")], "nome_normalizado string, trecho_interacoes string")
    found = identify.identify(source, entries)
    rel = identify.relations(found)
    (r,) = rel.collect()
    assert (r.alvo, r.tipo_alvo, r.evidencia, r.resumo) == ("Varfarina", "PRINCIPIO_ATIVO", "- Varfarina: aumento do risco de sangramento.", "aumento do risco de sangramento.")
    assert {tuple(x) for x in identify.run_status(source, identify.counts(found)).select("nome_normalizado", "status").collect()} == {("produto teste", "CONCLUIDO_COM_RELACOES"), ("marevan", "FALHA"), ("digoxina", "CONCLUIDO_SEM_RELACOES")}


def test_structured_blocks(spark, entries):
    block = "Medicamentos: digoxina,\n\namiodarona.\nEfeito da interação: aumenta o risco."
    denied = "Medicamentos: varfarina.\nEfeitos da interação: não foram observadas alterações."
    text = f"Título\n\n{block}\n{denied}\n7. ADVERTÊNCIAS GERAIS\nfim"
    assert passages.blocks_of(text) == [(text.index(block), text.index(block) + len(block)), (text.index(denied), text.index(denied) + len(denied))]
    source = spark.createDataFrame([("produto teste", text)], "nome_normalizado string, trecho_interacoes string")
    rel = {r.termo: r.evidencia for r in identify.relations(identify.identify(source, entries)).collect()}
    assert rel == {"digoxina": block, "amiodarona": block}
    assert passages.completed(text, "digoxina,") == block and passages.completed(text, "Título") == "Título"
    df = spark.createDataFrame([(block,), ("nada",), (None,)], "t string")
    assert [r.e for r in df.select(passages.block_effect(F.col("t")).alias("e")).collect()] == ["aumenta o risco.", "", ""]


def test_literal_summary(spark):
    long = "palavra " * 60
    df = spark.createDataFrame([("- X: efeito muito grave.", "X"), ("Ver X: sim", "X"), ("Risco: com X aumenta.", "X"), (long + "X", "X")], "e string, a string")
    got = [r.s for r in df.select(passages.literal_summary(F.col("e"), F.col("a")).alias("s")).collect()]
    assert got[:3] == ["efeito muito grave.", "Ver X: sim", "Risco: com X aumenta."] and len(got[3]) <= 300 and got[3].endswith("palavra…")


def test_at_most_three_evidences(spark, entries):
    text = "\n\n".join(f"Caso {i}: digoxina aumenta." for i in range(5)) + "\n\nCaso 1: digoxina aumenta."
    source = spark.createDataFrame([("produto teste", text)], "nome_normalizado string, trecho_interacoes string")
    rel = identify.relations(identify.identify(source, entries)).collect()
    assert len(rel) == 3 and [r.ordem for r in sorted(rel, key=lambda r: r.trecho)] == [1, 2, 3]
    assert all(r.evidencia in text for r in rel)
    (left,) = identify.counts(identify.identify(source, entries)).collect()
    assert (left.relacoes, left.omitidas) == (3, 2)


def test_long_passages_are_cut_around_the_target(spark, entries):
    filler = "texto sem fim de frase " * 60
    early = "A digoxina " + filler
    late = filler + "ácido acetil-\nsalicílico e \n" + filler + "depois a DIGOXINA aumenta " + filler + "e a digoxina outra vez " + filler
    source = spark.createDataFrame([("marevan", early), ("produto teste", late)], "nome_normalizado string, trecho_interacoes string")
    got = {}
    for r in identify.relations(identify.identify(source, entries)).collect():
        got.setdefault((r.nome_normalizado, r.alvo.lower()), []).append(r.evidencia)
    assert got.keys() == {("marevan", "digoxina"), ("produto teste", "digoxina"), ("produto teste", "ácido acetilsalicílico")}
    (first,) = got["marevan", "digoxina"]
    assert early.startswith(first) and first.startswith("A digoxina") and 190 < len(first) <= 210
    (aas,) = got["produto teste", "ácido acetilsalicílico"]
    assert "ácido acetil-\nsalicílico" in aas and aas in late and len(aas) <= 400
    two = sorted(got["produto teste", "digoxina"])
    assert len(two) == 2 and all(e in late and "digoxina" in e.lower() and len(e) <= 400 for e in two)


def test_word_spans_are_the_matched_words(spark):
    random.seed(11)
    pool = "ab1éÇÃß ªº²İŁΩ\u0301\u00ad-\n\t.;ﬁK\u00a0"
    texts = ["".join(random.choice(pool) for _ in range(60)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", identify._words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert len(identify.word_spans(r.t)) == len(r.w), ascii(r.t)


def test_passages(spark):
    source = spark.createDataFrame([("x", "Primeira frase. Segunda frase;\n- item um\n• item dois\n\nNova parte"), ("nulo", None), ("branco", "  ")], "k string, t string")
    got = [r.texto for r in identify.passages(source, "k", "t").orderBy("trecho").collect()]
    assert got == ["Primeira frase.", "Segunda frase;", "- item um", "• item dois", "Nova parte"]


def brute(words, terms):
    out, i = [], 0
    while i < len(words):
        for n in range(min(3, len(words) - i), 0, -1):
            if " ".join(words[i : i + n]) in terms:
                out.append((i, n))
                i += n
                break
        else:
            i += 1
    return out


def test_leftmost_longest_against_brute_force(spark):
    import random

    random.seed(2)
    terms = {" ".join(random.choice("abcd") for _ in range(random.randint(1, 3))) for _ in range(12)}
    texts = [(i, 0, " ".join(random.choice("abcd") for _ in range(30))) for i in range(40)]
    dictionary = spark.createDataFrame([(t, "X") for t in terms], "termo string, tipo string")
    got = {}
    for r in identify.dictionary_matches(spark.createDataFrame(texts, "k int, trecho int, texto string"), "k", dictionary).collect():
        got.setdefault(r.k, []).append((r.inicio, r.palavras))
    for k, _, text in texts:
        assert sorted(got.get(k, [])) == brute(text.split(), terms)


def test_resolution(spark, entries):
    mentions = spark.createDataFrame([(1, "Varfarina", "x"), (2, "amiodarona", "x"), (3, "nada", "x"), (4, None, "x")], "id int, alvo string, o string")
    got = {(r.id, r.medicamento_relacionado, r.criterio_vinculo) for r in catalog.resolve(mentions, entries, "alvo", "o").collect()}
    assert got == {(1, "varfarina generico", "PRINCIPIO_ATIVO_EXATO"), (1, "marevan", "PRINCIPIO_ATIVO_SEM_SAL"), (2, "cordarex", "PRINCIPIO_ATIVO_SEM_SAL")}


def test_chunks_cover_the_text(spark):
    words = [f"p{i}" for i in range(150)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "  curto texto "), (3, None), (4, " ")], "k int, t string")
    got = chunks.sliding_chunks(df, "k", "t", 64, 16).orderBy("k", "chunk_index").collect()
    assert [(r.k, r.chunk_index, r.tokens) for r in got] == [(1, 0, 64), (1, 1, 64), (1, 2, 54), (2, 0, 2)]
    assert got[-1].texto_chunk == "  curto texto " and {w for r in got if r.k == 1 for w in r.texto_chunk.split()} == set(words)


def test_token_windows(spark):
    df = spark.createDataFrame([([5, 5, 5, 20, 1],), ([],)], "n array<int>")
    assert [r.c for r in df.select(chunks.token_windows(F.col("n"), 10).alias("c")).collect()] == [[0, 2, 3, 4], []]
