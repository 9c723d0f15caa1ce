"""Confusables, canonical mapping, formatting duplicates and truncation on small fixtures."""

import random
import re
import unicodedata
from unittest.mock import Mock

import pytest

from marisma.llm import canonical, confusables, duplicates, queries, truncation


# ---------------------------------------------------------------- confusables


def test_consistent_form_and_kinds():
    cases = {
        "predispοstas": ("predispostas", ["alfabeto"]),
        "ｒｅｘ": ("rex", ["largura"]),
        "ﬁm": ("fim", ["largura"]),
        "água": ("água", ["combinante"]),
        "po​de": ("pode", ["invisivel"]),
        "x y": ("x y", ["espaco"]),
    }
    for text, (form, kinds) in cases.items():
        assert confusables.consistent_form(text) == (form, kinds)
        assert confusables.skeleton(text) == confusables.skeleton(form)
    for proper in ("receptores β", "fator α", "1,8 m² ≥ 2º ª ® – “x”", "5 μg", "a\tb\nc", ""):
        assert confusables.consistent_form(proper) == (proper, [])


def test_prototypes_of_many_scripts(spark):
    known = confusables.prototypes(spark)
    assert len(known.letters) > 200 and len(known.looks) > 2000
    for text, form in {"ꓓrex": "Drex", "Ꭰrex": "Drex", "reх": "rex", "ΑΒx": "ABx", "𝐫ex": "rex", "Іbu": "Ibu", "вase": "base"}.items():
        assert confusables.consistent_form(text, known) == (form, ["alfabeto"])
        assert confusables.skeleton(text, known) == confusables.skeleton(form, known)
    assert confusables.skeleton("rnuito l0O1", known) == confusables.skeleton("muito IO0l", known)
    assert confusables.skeleton("rex", known) != confusables.skeleton("réx", known)


def test_prototypes_that_cannot_be_read_are_an_error(spark, monkeypatch):
    read, absent, short = confusables.prototypes, Mock(), Mock()
    absent.sparkContext._jvm = spark.sparkContext._jvm.no.such
    short.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton.return_value = "a\nb"
    df = spark.createDataFrame([(1, "Ꭰrex"), (2, "Drex")], "id long, valor string")
    for broken in (absent, short):
        monkeypatch.setattr(confusables, "prototypes", lambda _, b=broken: read(b))
        for query in (lambda: confusables.defects(df, "id", ["valor"]), lambda: confusables.skeleton_groups(df, "valor"), lambda: confusables.with_consistent_form(df, "valor", "forma")):
            with pytest.raises(RuntimeError, match="confusables data"):
                query()
    monkeypatch.undo()
    assert [tuple(r) for r in confusables.skeleton_groups(df, "valor").collect()] == [("Drex", "Drex", 2, 2)]


def test_defects_in_the_jvm_and_python_agree(spark):
    pool = "abc éã βοаａﬁ́​   \n\t®ª²12"
    random.seed(1)
    data = [(i, "".join(random.choice(pool) for _ in range(8)), None) for i in range(400)] + [(900, None, None), (901, "", None), (902, "x" * 100_000 + "​", None)]
    df = spark.createDataFrame(data, "id long, a string, campo string")
    found = {r.id for r in confusables.defects(df, "id", ["a"]).collect()}
    assert found == {i for i, t, _ in data if t and confusables.consistent_form(t)[1]}


def test_skeleton_groups(spark):
    df = spark.createDataFrame([(t,) for t in ["rex"] * 5 + ["rеx", "ｒex", "outro", None]], "valor string")
    got = {(r.esqueleto, r.forma, r.grafias, r.linhas) for r in confusables.skeleton_groups(df, "valor").collect()}
    assert got == {("rex", "rex", 3, 7), ("outro", "outro", 1, 1)}


def test_both_fields_are_grouped(spark, tmp_path):
    data = [(1, "rex", "uso de rex"), (2, "rеx", "uso de rеx"), (3, None, "outro"), (4, "", None)]
    spark.createDataFrame(data, "id long, alvo string, evidencia string").write.parquet(f"{tmp_path}/interacoes.parquet")
    got = {tuple(r) for r in queries.p2_groups(spark, str(tmp_path)).collect()}
    assert got == {("alvo", "rex", "rex", 2, 2), ("alvo", "", "", 1, 1), ("evidencia", "uso de rex", "uso de rex", 2, 2), ("evidencia", "outro", "outro", 1, 1)}


# ---------------------------------------------------------------- canonical mapping

TERMS = [(1, "nodunoerbato", "NDBT"), (2, "inibidores da vicobiase", None), (3, "suco de jabuticaba", None), (4, "rerexanil", None), (5, "ácido sovalínico", None), (6, "bloqueadores de clefedaina", None)]
VALUES = {
    "Nodunoerbato": 1, "nodnoerbato": 1, "ndbt": 1, "noduno​erbato 100 mg": 1, "cloridrato de nodunoerbato": 1, "NODUNOERBATO®": 1, "nodun oerbato": 1,
    "inib. da vicobiase": 2, "vicobiase (inibidores)": 2, "vicobiase, inibidores da": 2, "inibidor da vicobiase": 2, "jabuticaba (suco)": 3,
    "rerexanil (Quimbela do Sul)": 4, "rerexanil xarope": 4, "ác. sovalínico": 5, "outros medicamentos": 0, "zanubaguemor": 0, "ndbx": 0, "": 0, " ": 0, "?": 0,
}


def test_mapping(spark, rows):
    ref = spark.createDataFrame(TERMS, "termo_id long, termo string, sinonimos string")
    data = [("alvo", i, v, "x") for i, v in enumerate(VALUES)] + [("alvo", 0, "Nodunoerbato", "y"), ("alvo", 99, None, "x"), ("alvo", 98, "rerexanil", "x")]
    fields = spark.createDataFrame(data, "campo string, interacao_id long, valor string, score string")
    got = canonical.map_fields(fields, ref)
    assert {r.valor: r.termo_id for r in got.collect()} == VALUES and got.count() == len(VALUES)
    assert canonical.map_fields(fields.limit(0), ref).count() == 0
    assert {r.termo_id for r in canonical.map_fields(fields, ref.limit(0)).collect()} == {0}


def test_join_path_equals_shipped_path(spark):
    """Scores and decisions are the same, also for names that differ by a letter."""
    near = [(7, "zolpedrina alfa", None), (8, "zolpedrina alfo", None), (9, "zolpedrina beta", None)]
    ref = spark.createDataFrame(TERMS + near, "termo_id long, termo string, sinonimos string")
    data = [*VALUES, "zolpedrina alfe", "zolpedrina alffa", "zolpedrina betta", "zolpedrina"]
    values = spark.createDataFrame([(v,) for v in data], "valor string")
    shipped = {(r.valor, r.termo_id, round(r.score, 6)) for r in canonical.match_values(values, ref).collect()}
    assert shipped == {(r.valor, r.termo_id, round(r.score, 6)) for r in canonical.match_by_join(values, ref).collect()}
    assert {(v, n) for v, n, _ in shipped} >= {("zolpedrina alfe", 0), ("zolpedrina betta", 9)}
    assert canonical.match_by_join(values, ref.limit(0)).where("termo_id <> 0").count() == 0
    assert canonical.match_by_join(values.limit(0), ref).count() == 0


def test_hot_values_go_back_to_their_rows(spark, monkeypatch):
    monkeypatch.setattr(canonical, "MAX_BROADCAST_VALUES", 2)
    ref = spark.createDataFrame(TERMS, "termo_id long, termo string, sinonimos string")
    data = [("alvo", i, "Nodunoerbato") for i in range(300)] + [("alvo", 1000 + i, f"{v} ") for i, v in enumerate(VALUES)]
    got = canonical.map_fields(spark.createDataFrame(data, "campo string, interacao_id long, valor string"), ref).collect()
    assert len(got) == len(data) and all(r.termo_id == 1 for r in got if r.valor == "Nodunoerbato")


def test_edit_distance():
    assert canonical.osa_distance("abcd", "abdc", 3) == 1 and canonical.osa_distance("abcd", "xbcd", 3) == 1
    assert canonical.osa_distance("abc", "abcdefgh", 3) == 4


# ---------------------------------------------------------------- formatting duplicates


def key(text):
    """Brute force identity of a statement."""
    norm = lambda s: "".join(c for c in re.sub(r"(?<=\d)[,.](?=\d)", lambda m: "" if m.group() == "," else "", s.lower()) if c.isalnum() or c in "")
    found = list(re.finditer(r"(?i)(?<!\w)(medicamento|efeito|conduta|dados)\s*:", text))
    if len(found) < 2:
        return norm(text)
    ends = [m.start() for m in found[1:]] + [len(text)]
    fields = [(m.group(1).lower(), norm(text[m.end() : e])) for m, e in zip(found, ends)]
    return str(sorted(fields + ([("", norm(text[: found[0].start()]))] if norm(text[: found[0].start()]) else [])))


def test_copies_against_brute_force(spark, rows):
    random.seed(3)
    base = ["O uso de A com 2,5 mg eleva o risco.", "O uso de A com 25 mg eleva o risco.", "Medicamento: x; Efeito: pode 1,5; Conduta: evitar; Dados: Dados de 3 casos", "Efeito: x; Medicamento: pode 1,5", "!!", "", "AbC"]
    data = []
    for i in range(300):
        t = random.choice(base)
        parts = t.split("; ")
        if random.random() < 0.5:
            random.shuffle(parts)
        t = random.choice(["; ", " | ", "\n"]).join(parts)
        t = random.choice([str, str.upper, str.lower, str.swapcase])(t)
        data.append((i, random.choice(["", "* ", '"']) + t.replace(" ", random.choice([" ", "  ", "\t"])), "x"))
    data += [(1000, None, "x"), data[0]]
    df = spark.createDataFrame(data, "id long, evidencia string, campos string")
    groups = {}
    for i, t, _ in data:
        if t and key(t):
            groups.setdefault(key(t), set()).add(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert rows(duplicates.copies(df, "id", "evidencia")) == sorted(want, key=lambda t: tuple((False, str(x)) for x in t))
    kept = {r.id_mantido: r.copias for r in duplicates.collapsed(df, "id", "evidencia").collect()}
    assert kept == {min(g): len(g) - 1 for g in groups.values()}
    assert duplicates.copies(df.limit(0), "id", "evidencia").count() == 0


# ---------------------------------------------------------------- truncation


def test_truncation(spark, rows):
    random.seed(5)
    names = ["varo" + a + b for a in ("lina", "dora", "mex") for b in ("tix", "pur", "gal")]
    tails = ["elevar o risco de sangramento", "reduzir o efeito terapêutico", "potencializar a sedação"]
    data = []
    for i in range(400):
        a, b = random.sample(names, 2)
        text = f"Tomar {a} com {b} pode {random.choice(tails)}. O médico pode monitorar a função renal quando {a} e {b} são usados ao mesmo tempo."
        data.append((i, text, None))
    cuts = {1000: data[0][1][:45], 1001: data[1][1][:-20] + "…", 1002: "Tomar varolinatix com", 1003: "Tomar varodorapur com varomexgal pode elevar o ris..."}
    whole = {2000: data[2][1][:-1], 2001: data[3][1] + " Ver bula completa", 2002: data[4][1] + " Ver bula completa", 2003: "", 2004: None, 2005: " ", 2006: data[5][1].split(". ")[0]}
    data += [(i, t, None) for i, t in {**cuts, **whole}.items()]
    df = spark.createDataFrame(data, "id long, texto string, palavra string").selectExpr("'t' AS tabela", "*")
    assert {r.id for r in truncation.cut_texts(df).collect()} == set(cuts)
    assert truncation.cut_texts(df.limit(0)).count() == 0
    rates = truncation.cut_rates(df.withColumnRenamed("palavra", "resumo_modelo")).first()
    assert (rates.textos, rates.cortados) == (len(data) - 1, len(cuts))


def test_copies_of_a_cut_text_do_not_vouch(spark, monkeypatch):
    random.seed(6)
    names = ["varolinatix", "varodorapur", "varomexgal", "varolinapur"]
    tails = ["elevar o risco de sangramento", "reduzir o efeito terapêutico", "potencializar a sedação"]
    whole = [f"Tomar {a} com {b} pode {t}. O médico pode monitorar a função renal quando {a} e {b} são usados." for a in names for b in names for t in tails if a != b]
    cut, notice = "Tomar varolinatix com varomexgal pode elevar o", [f"{t} Ver bula completa" for t in whole[:9]]
    copies = [cut] * 120 + [cut + " "] * 20 + [cut.upper()] * 20
    texts = whole + notice + copies
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tabela string, id long, texto string")
    want = set(range(len(whole) + len(notice), len(texts)))
    assert {r.id for r in truncation.cut_texts(df).collect()} == want
    monkeypatch.setattr(truncation, "MAX_BROADCAST_TEXTS", 0)
    assert {r.id for r in truncation.cut_texts(df).collect()} == want


def test_forms_are_normal():
    assert unicodedata.normalize("NFC", confusables.canonical_text("é")) == "é"


def test_copies_beyond_the_broadcast(spark, rows, monkeypatch):
    data = [(i, f"Texto {i % 7}, igual" + "." * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, evidencia string")
    shipped = rows(duplicates.copies(df, "id", "evidencia"))
    monkeypatch.setattr(duplicates, "MAX_BROADCAST_GROUPS", 2)
    assert rows(duplicates.copies(df, "id", "evidencia")) == shipped and len(shipped) == 53
