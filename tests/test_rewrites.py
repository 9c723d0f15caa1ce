"""Rules of rewritten texts on small cases."""

from marisma.operators import rewrites
from pyspark.sql import functions as F


def column(spark, data, f, schema="t string"):
    df = spark.createDataFrame(data, schema)
    return [r.x for r in df.select(f(*[F.col(c) for c in df.columns]).alias("x")).collect()]


def test_clean_and_templates(spark):
    texts = [("INTERAÇÕES MEDICAMENTOSAS\nO salbutamol pode\naumentar o efeito",), ("Lítio\nAumentos reversíveis",), ("Ciclosporina\nUso com ciclosporina exige cautela;",), ("• item um",), ("",), (None,)]
    assert column(spark, texts, rewrites.cleaned) == ["O salbutamol pode aumentar o efeito.", "Lítio. Aumentos reversíveis.", "Uso com ciclosporina exige cautela.", "item um.", "", None]
    cards = [("O uso da digoxina aumenta.", "digoxina"), ("A digoxina sobe.", "digoxina"), ("Digoxina e digoxina.", "digoxina"), ("Evite com a digoxina.", "digoxina")]
    molds = column(spark, cards, rewrites.template, "t string, a string")
    assert molds == ["O uso de {alvo} aumenta.", "{alvo} sobe.", None, "Evite com {alvo}."]
    assert column(spark, [(molds[0], "losec"), (molds[1], "losec")], rewrites.filled, "t string, a string") == ["O uso de losec aumenta.", "Losec sobe."]


def test_spelling_and_quotations(spark):
    pair = "t string, s string"
    assert column(spark, [("acido mefenámico", "ácido mefenâmico"), (None, "x")], rewrites.source_spelling, pair) == ["acido mefenâmico", None]
    assert column(spark, [("causa 'rash' e “febre”", "pode causar “rash”")], rewrites.foreign_quotations, pair) == [["febre"]]


def test_numbers_frequencies_limits_facts(spark):
    text = [("Dose de 2,5 mg duas vezes ao dia ou a cada 8 horas em beta-2, ver item 5 (silva, 1999), pelo menos 18 anos, abaixo de 7.5 e 40 %.",)]
    fold = lambda f: lambda t: f(rewrites.fold_name(t))
    assert column(spark, text, fold(rewrites.clinical_numbers)) == [["18", "2,5", "40", "7,5"]]
    assert column(spark, text, fold(rewrites.frequencies)) == [["2/dia", "cada 8h"]] and column(spark, text, fold(rewrites.limits)) == [["ge 18", "lt 7,5"]]
    assert column(spark, [("Idosos: 10 mg pode reduzir a AUC em 30%",)], lambda t: rewrites.kept_facts(t)["populacoes"]) == [["idosos"]]
    assert column(spark, [("Uso concomitante; hipotensão",)], rewrites.plain_wording) == ["uso ao mesmo tempo; pressao arterial baixa"]


def test_signatures(spark):
    names = ["digoxina", "amiodarona"]
    data = [("a amiodarona aumenta os niveis de digoxina", names), ("a acao da digoxina e aumentada por amiodarona", names), ("a amiodarona nao reduz a digoxina", names), ("a amiodarona aumenta a pressao quando usada com digoxina", names), (None, names)]
    assert column(spark, data, rewrites.relation_signatures, "t string, n array<string>") == [["amiodarona>digoxina:aumento"], ["amiodarona>digoxina:aumento"], ["amiodarona>digoxina:reducao:negado"], [], None]


def test_focus_completion_columns_repeats(spark):
    pair = "t string, s string"
    assert column(spark, [("Evite losec. A digoxina sobe. Esse efeito dura. Outro caso.", "digoxina"), ("Nada.", "x")], rewrites.focused, pair) == ["A digoxina sobe. Esse efeito dura.", "Nada."]
    assert column(spark, [("A dose pode", "Antes. A dose pode subir muito. Fim."), ("Inteira.", "Inteira. x"), ("fora", "x")], rewrites.completed_sentence, pair) == ["A dose pode subir muito.", "Inteira.", "fora"]
    assert column(spark, [("Nome    Efeito\nX       sobe\nY       desce",), ("uma linha",)], rewrites.regrouped_columns) == ["Nome X Y\nEfeito sobe desce", "uma linha"]
    assert column(spark, [("Aumenta o risco. O risco aumenta. Outra coisa.",)], rewrites.without_repeats) == ["Aumenta o risco. Outra coisa."]
    assert column(spark, [("↑ AUC e ↓ Cmax",)], rewrites.measures_as_sentences) == ["aumento de AUC e redução de Cmax"]
    assert column(spark, [(["a b c", "b", "d", "d"],)], rewrites.longest_evidences, "e array<string>") == [["a b c", "d"]]


def test_blocks_states_and_attempts(spark):
    items = [([(1, ["a"]), (2, ["b"]), (3, ["a", "c"]), (4, ["d"]), (5, ["e"])],)]
    (blocks,) = column(spark, items, rewrites.general_blocks(3), "i array<struct<id:bigint,alvos:array<string>>>")
    assert len(blocks) == 3 and sorted(sum(blocks, [])) == [1, 2, 3, 4, 5] and any({1, 3} <= set(b) for b in blocks)
    assert column(spark, [(3, 3, 0), (3, 1, 1), (3, 0, 2), (0, 0, 0)], rewrites.run_state, "a int, b int, c int") == ["CONCLUIDO", "PARCIAL", "FALHA", "PENDENTE"]
    log = spark.createDataFrame([("u", 1, "A", True, 400), ("u", 2, "B", True, 600), ("v", 1, None, False, 400), ("w", 1, "A", False, 400), ("w", 2, "B", False, 400), ("w", 3, "C", False, 400)], "unidade string, tentativa int, motivo string, truncada boolean, limite int")
    got = {r.unidade: (r.estado, r.erros, r.limite) for r in rewrites.attempts(log).collect()}
    assert got == {"u": ("REPETIR", ["A", "B"], 768), "v": ("CONCLUIDO", [], 400), "w": ("FALHA", ["A", "B", "C"], 400)}


def test_verdicts(spark):
    source = "A digoxina pode aumentar com 2,5 mg duas vezes ao dia; não deve ser usada por via oral com losec."
    good = "A digoxina pode aumentar com 2,5 mg duas vezes ao dia e não deve ser usada por via oral com losec."
    data = [(good, source), (good.replace("2,5", "3"), source), (good.replace("duas", "três"), source), (good.replace("não deve ser usada", "é usada"), source), (good.replace("pode aumentar", "aumenta sempre"), source), ("", source), ("{" + good, source)]
    assert column(spark, data, rewrites.rewrite_verdict, "t string, s string") == [None, "NUMERO_NOVO", "FREQUENCIA", "RESTRICAO", "CERTEZA", "VAZIO", "MARCACAO"]
    assert column(spark, [("a ↑ b",)], lambda t: rewrites.input_problems(t)["tabela"]) == [True]
    assert column(spark, [("Resumo: O uso aumenta, segundo a bula, o risco.",)], rewrites.read_output) == ["O uso aumenta, o risco."]
