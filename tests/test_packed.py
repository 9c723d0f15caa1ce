"""Splitting of packed fields against a character scanner."""

import random

from marisma.operators import packed

MARKS = {"a": ["ponto_e_virgula", "virgula", "barra_vertical", "tabulacao", "linha", "mais", "barra", "e"]}


def scan(text):
    """Brute force: walk the characters, tracking quotes and parentheses."""
    out, now, i, quote, depth = [], "", 0, None, 0
    while i < len(text):
        c = text[i]
        if quote:
            now += c
            if c == quote:
                if text[i + 1 : i + 2] == '"' == quote:
                    now += '"'
                    i += 1
                else:
                    quote = None
        elif c == '"':
            quote, now = c, now + c
        elif c == "(":
            depth, now = depth + 1, now + c
        elif c == ")":
            depth, now = depth - 1, now + c
        elif depth:
            now += c
        elif (
            c in ";|\t\n"
            or (c == "," and not (text[i - 1 : i].isdigit() and text[i + 1 : i + 2].isdigit()))
            or (c in "+/" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace())
            or (c == "e" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace())
        ):
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    out.append(now)
    done = []
    for piece in out:
        piece = piece.strip()
        if len(piece) > 1 and piece[0] == piece[-1] == '"':
            piece = piece[1:-1].replace('""', '"').strip()
        if piece:
            done.append(piece)
    return done


def test_against_scanner(spark, rows):
    random.seed(4)
    parts = ["varfarina sódica", "12,5 mg", "50 mg/mL", '"a, b; c"', '"tipo ""x"", 2"', "sal (anidro, 2,5; x)", "digoxina", " ", ""]
    seps = ["; ", ";", ", ", " | ", "\t", "\n", " + ", " / ", " e ", " ;"]
    data = []
    for k in range(300):
        text = random.choice(parts)
        for _ in range(random.randint(0, 5)):
            text += random.choice(seps) + random.choice(parts)
        data.append((str(k), text))
    df = spark.createDataFrame(data, "k string, a string")
    got = {}
    for k, _, p, v in rows(packed.unpack(df, "k", ["a"], MARKS)):
        got.setdefault(k, {})[p] = v
    for k, text in data:
        assert [got.get(k, {})[p] for p in sorted(got.get(k, {}))] == scan(text), text


def test_edges(spark, rows):
    data = [("nulo", None, 1), ("branco", "  ", 2), ("um", "• só um", 3), ("aspas", "'talco'; \"aberta", 4), ("longo", "x" * 30000 + ";" + "y (" + "z" * 30000 + ")", 5), ("longo", "p;q", 6)]
    df = spark.createDataFrame(data, "k string, a string, campo int")
    got = packed.unpack(df, "k", ["a"], {"a": ["ponto_e_virgula"]}).collect()
    assert {(r.k, r.posicao, r.valor[:9]) for r in got} == {("um", 1, "só um"), ("aspas", 1, "talco"), ("aspas", 2, '"aberta'), ("longo", 1, "xxxxxxxxx"), ("longo", 2, "y (zzzzzz"), ("longo", 1, "p"), ("longo", 2, "q")}
    assert packed.unpack(df.limit(0), "k", ["a"]).count() == 0


def test_marks_are_inferred(spark):
    values = [("a", f"substancia {i % 7}a; outra b{i % 5} c | droga pré-x") for i in range(40)]
    df = spark.createDataFrame([(str(i), v) for i, (_, v) in enumerate(values)], "k string, a string")
    marks = packed.inferred_marks(df, "k", ["a"])["a"]
    assert "ponto_e_virgula" in marks and "barra_vertical" in marks and "ponto" not in marks
