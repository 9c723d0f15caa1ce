"""Units of a text with their positions, token windows over them, and what is made of answers to them.

A unit is a sentence, list item, title or block of lines; its position is kept, so that every quotation
is a slice of the text.  Windows hold whole units up to a token budget and share some with the next.
Positions and windows depend on what came before inside one text, so they run in Arrow-batched
functions over texts or arrays; everything else is JVM expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose point ends no sentence, and references whose number's point does not.
ABBREVIATIONS = (
    "ex", "p", "pex", "aprox", "max", "min", "sr", "sra", "dr", "dra",
    "vs", "n", "no", "nº", "cf", "fig", "tab", "ref", "vol", "pag", "pág",
    "al", "etc", "obs", "i.e", "e.g", "mg", "ml", "cap", "art",
)
REFERENCE = r"(?:vide|ver|veja|consulte|se[cç][aã]o|item|itens|t[oó]pico)\s+(?:o\s+|a\s+)?\d{1,2}(?:\.\d{1,2})*\.$"
NUMBERED_TITLE = r"^\s*\d{1,2}(?:\.\d{1,2})*\.?\s+\S"
LIST_ITEM = r"^\s*(?:[•▪●◦‣⁃\-–—*]|[a-z]\)|\d+\))\s+"

_END = re.compile(r"[.!?][\"')”’\]]*(?=\s+[A-ZÀ-ÖØ-Þ\d•▪●(\"“*-])")
_SPAN = [T.StructField("ini", T.IntegerType()), T.StructField("fim", T.IntegerType())]
UNITS = T.ArrayType(T.StructType([*_SPAN, T.StructField("titulo", T.BooleanType())]))
SPANS = T.ArrayType(T.StructType(_SPAN))


def is_title(line: str) -> bool:
    """A short line without final mark that is numbered or in capitals."""
    bare = line.strip()
    letters = [c for c in bare if c.isalpha()]
    return bool(bare) and len(bare) <= 110 and bare[-1] not in ".;,:" and bool(re.match(NUMBERED_TITLE, bare) or (len(letters) >= 4 and all(c.isupper() for c in letters)))


def _sentence_ends(text: str, start: int, stop: int) -> list[int]:
    ends = []
    for m in _END.finditer(text, start, stop):
        if text[m.start()] == ".":
            word = re.search(r"\S*$", text[: m.start()]).group().strip("(\"'").lower()
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start() + 1]
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or re.search(REFERENCE, line[-40:], re.I):
                continue
        ends.append(m.end())
    return ends


def units_of(text: str, most: int = 1500) -> list[tuple[int, int, bool]]:
    """(first, behind the last, is a title) of each unit, without outer blanks; blocks without any border
    are cut at lines, or else at blanks, into parts of at most ``most`` characters."""
    borders, titles, at = {0, len(text)}, set(), 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        title = is_title(line)
        if title or not line.strip() or re.match(LIST_ITEM, line):
            borders.add(at)
        if title or not line.strip():
            borders.add(end)
        if title:
            titles.add(at)
        at = end
    # Sentences run over lines, but over no title or blank line.
    edges = sorted(borders)
    for a, b in zip(edges, edges[1:]):
        if a not in titles:
            borders.update(_sentence_ends(text, a, b))
    out = []
    edges = sorted(borders)
    for a, b in zip(edges, edges[1:]):
        while b - a > most:
            cut = max(text.rfind("\n", a + most // 2, a + most), -1)
            cut = cut if cut > a else text.rfind(" ", a + most // 2, a + most)
            cut = cut if cut > a else a + most
            out.append((a, cut, False))
            a = cut
        out.append((a, b, a in titles))
    spans = []
    for a, b, title in out:
        part = text[a:b]
        if part.strip():
            spans.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip()), title))
    return spans


@F.pandas_udf(UNITS)
def units(texts: pd.Series) -> pd.Series:
    """Column version of :func:`units_of`; null gives null."""
    return pd.Series([None if t is None else [{"ini": a, "fim": b, "titulo": x} for a, b, x in units_of(t)] for t in texts], dtype=object)


def unit_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, indice, ini, fim, titulo, texto): the units of each text, each a slice of it."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.posexplode(units(F.col(text))).alias("indice", "_u"))
    return rows.select(key, "indice", "_u.ini", "_u.fim", "_u.titulo", F.col("_t").substr(F.col("_u.ini") + 1, F.col("_u.fim") - F.col("_u.ini")).alias("texto"))


def windows_of(counts: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """[first, behind the last) unit of each window of ``budget`` tokens; the next one begins with the last
    units of at most ``overlap`` tokens (at least one, if there is any overlap); a unit beyond the budget
    is a window of its own."""
    out, first = [], 0
    while first < len(counts):
        end, total = first + 1, counts[first]
        while end < len(counts) and total + counts[end] <= budget:
            total += counts[end]
            end += 1
        out.append((first, end))
        if end == len(counts):
            break
        back, shared = end, 0
        while back > first + 1 and shared < overlap and not (shared and shared + counts[back - 1] > overlap):
            back -= 1
            shared += counts[back]
        first = back
    return out


def token_windows(budget: int, overlap: int):
    """Column function array<int> -> array<struct<ini, fim>> of :func:`windows_of`."""
    if budget <= 0 or not 0 <= overlap < budget:
        raise ValueError("0 <= overlap < budget")

    def cut(counts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else [{"ini": a, "fim": b} for a, b in windows_of([int(x) for x in c], budget, overlap)] for c in counts], dtype=object)

    cut.__annotations__ = {"counts": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, SPANS)


def uncovered(counts: Column, windows: Column) -> Column:
    """Units that no window holds; an empty array asserts coverage."""
    held = F.flatten(F.transform(windows, lambda w: F.sequence(w["ini"], w["fim"] - 1)))
    every = F.when(F.size(counts) > 0, F.sequence(F.lit(0), F.size(counts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, held)


def halves(window: Column) -> Column:
    """Two windows of a window's halves that share a unit; null for one unit, which cannot be divided."""
    middle = window["ini"] + F.floor((window["fim"] - window["ini"]) / 2).cast("int")
    shared = F.when(window["fim"] - window["ini"] > 2, 1).otherwise(0)
    both = F.array(F.struct(window["ini"].alias("ini"), (middle + shared).cast("int").alias("fim")), F.struct(middle.alias("ini"), window["fim"].alias("fim")))
    return F.when(window["fim"] - window["ini"] >= 2, both)


def overlapping(units: Column, first: Column, behind: Column) -> Column:
    """Units that share a character with [first, behind) of the text."""
    return F.filter(units, lambda u: (u["fim"] > first) & (u["ini"] < behind))


def neighbour_context(previous: Column, following: Column, budget: int) -> Column:
    """struct<antes, depois>: the last words of the window before and the first of the one behind, as many
    as the budget lets in."""
    words = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    tail = F.slice(words(previous), F.greatest(F.size(words(previous)) - budget, F.lit(0)) + 1, budget)
    return F.struct(F.array_join(tail, " ").alias("antes"), F.array_join(F.slice(words(following), 1, budget), " ").alias("depois"))


def numbered_sentences(units: Column) -> Column:
    """Text of array<struct<texto, titulo>> for a question: titles with ##, sentences with [F1], [F2], ...;
    a text delimiter inside is defused."""
    safe = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)<(/?\s*TEXTO\s*)>", "‹$1›"), r"(?U)\s+", " "))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("l"))

    def add(acc: Column, u: Column) -> Column:
        n = F.when(u["titulo"], acc["n"]).otherwise(acc["n"] + 1)
        line = F.when(u["titulo"], F.concat(F.lit("## "), safe(u["texto"]))).otherwise(F.concat(F.lit("[F"), n.cast("string"), F.lit("] "), safe(u["texto"])))
        return F.struct(n.cast("int").alias("n"), F.concat(acc["l"], F.array(line)).alias("l"))

    return F.aggregate(units, start, add, lambda acc: F.array_join(acc["l"], "\n"))


def _fold(text: str) -> str:
    """Lower case without accents, one character for each of the text's."""
    bare = (unicodedata.normalize("NFD", c.lower())[:1] or c for c in text)
    return "".join(bare)


def highlights_of(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Where any of the terms occurs, ignoring case and accents, from left to right without overlap; of
    terms that begin at one place the first given."""
    base, found = _fold(text), []
    for term in filter(None, (_fold(t.strip()) for t in terms)):
        found += [(m.start(), m.end()) for m in re.finditer(re.escape(term), base)]
    out, free = [], 0
    for a, b in sorted(found, key=lambda s: s[0]):
        if a >= free:
            out.append((a, b))
            free = b
    return out


@F.pandas_udf(SPANS)
def highlights(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Column version of :func:`highlights_of`."""
    return pd.Series([None if t is None else [{"ini": a, "fim": b} for a, b in highlights_of(t, [] if x is None else list(x))] for t, x in zip(texts, terms)], dtype=object)


# ---------------------------------------------------------------- answers of a model


def parsed_answer(answer: Column, schema: str) -> Column:
    """struct<estado, valor> of a JSON answer, a code fence around it taken off: OK, VAZIA, TRUNCADA (it
    does not end as an object does) or INVALIDA."""
    bare = F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    value = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    parsed = F.get_json_object(bare, "$").isNotNull()
    state = F.when(bare == "", "VAZIA").when(~bare.rlike(r"[}\]]\s*$"), "TRUNCADA").when(~parsed, "INVALIDA").otherwise("OK")
    return F.struct(state.alias("estado"), F.when(state == "OK", value).alias("valor"))


def items_in_order(ids: Column, count: Column) -> Column:
    """Whether an answer has exactly one item for each of ``count`` sentences, F1, F2, ... in order."""
    wanted = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("F"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(ids, F.array().cast("array<string>")) == wanted


def recovered_text(answer: Column) -> Column:
    """Text of an answer {"texto": "... that was cut: up to its last whole sentence; null if there is none."""
    partial = F.nullif(F.regexp_extract(answer, r'(?s)^\s*\{\s*"texto"\s*:\s*"(.*)$', 1), F.lit(""))
    whole = F.nullif(F.regexp_extract(partial, r"(?s)^(.*\.)(?:\s|\\n)", 1), F.lit(""))
    return F.replace(F.replace(whole, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))


def ask(rows: DataFrame, prompt: str, provider, batch: int = 16) -> DataFrame:
    """``rows`` with (resposta, erro) of a model: ``provider()`` is called once in each task that has a row
    and returns a function from a list of prompts to a list of answers.  A batch that fails gives its
    error to each of its rows instead of ending the task."""
    schema = T.StructType([*rows.schema.fields, T.StructField("resposta", T.StringType()), T.StructField("erro", T.StringType())])

    def answer(frames):
        model = None
        for frame in frames:
            out, errors = [], []
            for at in range(0, len(frame), batch):
                asked = frame[prompt].iloc[at : at + batch].tolist()
                try:
                    model = model or provider()
                    got = list(model(asked))
                    out += got
                    errors += [None] * len(got)
                except Exception as error:  # the model is the caller's
                    out += [None] * len(asked)
                    errors += [repr(error)[:500]] * len(asked)
            yield frame.assign(resposta=out, erro=errors)

    return rows.mapInPandas(answer, schema)
