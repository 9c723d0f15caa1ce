"""Rules for texts rewritten from evidence: cleaning, wording, facts to keep, and verdicts on a rewrite.

Rules are JVM expressions over folded text where they can be; restoring spelling, relation signatures,
tables and groups inside one unit run in Arrow-batched functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.rules import amounts, numbers, routes
from marisma.functions.text import contains_term, fold_name, plain_words
from marisma.functions.vocabulary import SEVERITY

# Words that end a line without ending a phrase.
CONNECTORS = (
    "a", "o", "as", "os", "ao", "aos", "à", "às", "de", "da", "do", "das", "dos", "e", "ou",
    "em", "na", "no", "nas", "nos", "com", "por", "pela", "pelo", "pelas", "pelos", "para",
    "que", "como", "um", "uma", "se", "sem", "entre", "sobre",
)
# Instructions that a model gives back instead of a text.
ECHOES = (
    "como modelo de", "voce e um especialista", "responda somente", "gere um resumo",
    "efeito descrito para", "card ja escrito", "trocando apenas o nome", "medicamento da bula:",
    "tipo do alvo", "alvo:", "em json", "tentativa anterior", "foi rejeitada",
    "corrija esse problema", "atencao:", "texto corrido", "nome generico", "nomes do trecho",
    "sem citar esses nomes", "escreva so sobre",
)
# Claims of certainty, receptor subtypes, restrictions of use.
CERTAINTY = ("com certeza", "sempre", "nunca", "certamente", "garantido")
RECEPTOR = r"\b(?:alfa|alpha|beta|gama|gamma|delta)\s*-\s*\d+\b"
RESTRICTED = (
    r"\bnao\s+(?:se\s+)?(?:dev\w*|pod\w*|use\w*|us[ae]r?|tom\w*|administr\w*|receit\w*|combin\w*|"
    r"mistur\w*|associ\w*|prescrev\w*|inger\w*)\b|\b(?:contraindicad\w*|proibid\w*)\b"
)
# Limits by kind; wordings that say the same (pattern, plain form).
LIMITS = (
    ("ge", r"(?:pelo menos|no minimo|>=|≥)\s*(\d+(?:[.,]\d+)?)"),
    ("le", r"(?:\bate|no maximo|<=|≤)\s*(\d+(?:[.,]\d+)?)"),
    ("gt", r"(?:maiores? que|superiores? a|acima de|mais de)\s*(\d+(?:[.,]\d+)?)"),
    ("lt", r"(?:menores? que|inferiores? a|abaixo de|menos de)\s*(\d+(?:[.,]\d+)?)"),
)
WORDINGS = (
    (r"\b(?:concomitantemente|concomitantes?|simultaneamente)\b", "ao mesmo tempo"),
    (r"\bcoadministrac(?:ao|oes)\b", "utilizacao em conjunto"),
    (r"\bcoadministrad([oa]s?)\b", r"usad\1 em conjunto"),
    (r"\bcoadministrar\b", "usar em conjunto"),
    (r"\bconcentrac\w*\s+plasmatic\w*", "quantidade no sangue"),
    (r"\b(?:niveis?|quantidade|concentrac\w*)\s+(?:do medicamento\s+)?no sangue", "quantidade no sangue"),
    (r"\bhepatic\w*\b", "do figado"),
    (r"\bhipotensao\b|\bpressao (?:arterial )?baixa\b", "pressao arterial baixa"),
    (r"\bhipercalemia\b", "niveis altos de potassio no sangue"),
    (r"\bhipocalemia\b", "niveis baixos de potassio no sangue"),
    (r"\bcefaleias?\b|\bdores de cabeca\b", "dor de cabeca"),
    (r"\b(?:e possivel que|existe a possibilidade de)\b", "pode"),
)
_SPACE = r"(?U)\s+"


def _chain(text: Column, pairs) -> Column:
    for pattern, plain in pairs:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", plain))
    return text


def plain_wording(text: Column) -> Column:
    """Folded text in the wording used for comparison."""
    return _chain(fold_name(text), WORDINGS)


def simplified(text: Column) -> Column:
    """Text for a lay reader: technical terms of clearance and joint use, in the words around them."""
    pairs = (
        (r"(?i)\bcoadministração\b", "uso em conjunto"), (r"(?i)\bcoadministrad([oa]s?)\b", r"usad\1 em conjunto"), (r"(?i)\bdepuração\b|\bclearance\b", "eliminação"),
        (r"(?i)\bconcentraç(?:ão|ões) plasmáticas?\b", "quantidade no sangue"), (r"(?i)\buso concomitante\b", "uso ao mesmo tempo"), (r"(?i)\bexcreção renal\b", "eliminação pelos rins"),
    )
    return _chain(text, pairs)


def cleaned(text: Column) -> Column:
    """Lines of a document as one sentence with a final mark: no list marks, no leading title in capitals;
    a short label before a capital gets a point, or goes if the rest names it."""
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("•"), F.lit(" ")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-–*]\s*", ""))), lambda x: x != "")
    titled = F.transform(lines, lambda x: ~x.rlike("[a-zà-ú]") & x.rlike("[A-ZÀ-Ú]{3}"))
    first = F.array_position(titled, F.lit(False)).cast("int")
    body = F.slice(lines, F.when(first == 0, F.greatest(F.size(lines), F.lit(1))).otherwise(F.greatest(first, F.lit(1))), F.greatest(F.size(lines), F.lit(1)))

    def label(line: Column, following: Column) -> Column:
        last = F.lower(F.regexp_extract(line, r"(?U)(\w+)\W*$", 1))
        return (F.length(line) <= 90) & ~line.rlike(r"[.:;,!?-]$") & (last != "") & ~last.isin(*CONNECTORS) & F.coalesce(following.rlike(r"^\p{Lu}"), F.lit(False))

    rest = F.array_join(F.slice(body, 2, F.greatest(F.size(body), F.lit(1))), " ")
    names = F.filter(plain_words(fold_name(F.get(body, F.lit(0)))), lambda w: F.length(w) >= 3)
    told = (F.size(body) > 1) & label(F.get(body, F.lit(0)), F.get(body, F.lit(1))) & (F.size(names) > 0) & F.forall(names, lambda w: contains_term(fold_name(rest), w))
    body = F.when(told, F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))).otherwise(body)
    parts = F.transform(body, lambda x, i: F.when(label(x, F.get(body, i + 1)), F.concat(x, F.lit("."))).otherwise(x))
    joined = F.regexp_replace(F.trim(F.regexp_replace(F.array_join(parts, " "), _SPACE, " ")), r"[\s,;:]+$", "")
    return F.when((joined != "") & ~joined.rlike(r"[.!?]$"), F.concat(joined, F.lit("."))).otherwise(joined)


def template(text: Column, target: Column) -> Column:
    """A card with {alvo} for its target, without the article before it; null unless it occurs once."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\pL\pN])\Q"), F.replace(target, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\pL\pN])"))
    once = (F.trim(target) != "") & (F.size(F.regexp_extract_all(text, quoted, F.lit(0))) == 1)
    mold = F.regexp_replace(text, quoted, F.lit("{alvo}"))
    for articles, left in (("d[oa]s?", "de "), ("n[oa]s?", "em "), ("pel[oa]s?", "por "), ("aos?|às?", "a ")):
        mold = F.regexp_replace(mold, rf"(?u)(?<![\pL])(?:{articles}) \{{alvo\}}", left + "{alvo}")
    # "a" is an article only at the beginning of a sentence or behind a conjunction.
    mold = F.regexp_replace(mold, r"(?u)(?<![\pL])[Oo]s? \{alvo\}", "{alvo}")
    mold = F.regexp_replace(mold, r"(?u)(^|[.!?:] |(?:com|e|ou|que|como) )[Aa]s? \{alvo\}", "$1{alvo}")
    return F.when(once, mold)


def filled(mold: Column, target: Column) -> Column:
    """A template with a target's name, with a capital where a sentence begins."""
    capital = F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, F.lit(2), F.length(target)))
    begins = F.rtrim(F.substring_index(mold, "{alvo}", 1)).rlike(r"^$|[.!?]$")
    return F.replace(mold, F.lit("{alvo}"), F.when(begins, capital).otherwise(target))


@F.pandas_udf(T.StringType())
def source_spelling(texts: pd.Series, sources: pd.Series) -> pd.Series:
    """Words of six letters or more in the accents their source writes them with."""
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))

    def one(text: str | None, source: str | None) -> str | None:
        if text is None:
            return None
        written: dict[str, str] = {}
        for word in re.findall(r"\w{6,}", source or ""):
            written.setdefault(bare(word), word)
        return re.sub(r"\w{6,}", lambda m: w if (w := written.get(bare(m.group()))) and w.lower() != m.group().lower() else m.group(), text)

    return pd.Series([one(t, s) for t, s in zip(texts, sources)], dtype=object)


def foreign_quotations(text: Column, source: Column) -> Column:
    """Quotations in a text that its source does not have."""
    straight = lambda x: F.translate(fold_name(x), "“”‘’«»", "\"\"''\"\"")
    quoted = F.concat(F.regexp_extract_all(straight(text), F.lit(r'(?<!\w)"([^"]+)"(?!\w)'), F.lit(1)), F.regexp_extract_all(straight(text), F.lit(r"(?<!\w)'([^']+)'(?!\w)"), F.lit(1)))
    own = F.regexp_replace(straight(source), "[\"']", "")
    return F.filter(quoted, lambda q: ~contains_term(own, q))


def frequencies(folded: Column) -> Column:
    """How often something is taken, sorted: "2/dia", "cada 8h", "1/dia"."""
    times = F.transform(F.regexp_extract_all(folded, F.lit(r"\b(?:uma|duas|tres|quatro|\d+)\s+vez(?:es)?\s+(?:ao|por)\s+(?:dia|semana)\b"), F.lit(0)), lambda m: F.concat_ws("/", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(m, r"^\S+", 0), "uma", "1"), "duas", "2"), "tres", "3"), "quatro", "4"), F.regexp_extract(m, r"\S+$", 0)))
    every = F.transform(F.regexp_extract_all(folded, F.lit(r"\ba\s+cada\s+\d+(?:[.,]\d+)?\s*(?:horas?|h|dias?)\b"), F.lit(0)), lambda m: F.concat(F.lit("cada "), F.replace(F.regexp_extract(m, r"\d+(?:[.,]\d+)?", 0), F.lit("."), F.lit(",")), F.when(m.rlike("dias?$"), "dia").otherwise("h")))
    daily = F.transform(F.regexp_extract_all(folded, F.lit(r"\b(?:diariamente|doses?\s+diarias?)\b"), F.lit(0)), lambda m: F.lit("1/dia"))
    return F.array_sort(F.concat(times, every, daily))


def limits(folded: Column) -> Column:
    """Numeric limits with their kind, sorted: "ge 18"."""
    kinds = lambda kind: lambda n: F.concat(F.lit(f"{kind} "), F.replace(n, F.lit("."), F.lit(",")))
    found = [F.transform(F.regexp_extract_all(folded, F.lit(p), F.lit(1)), kinds(kind)) for kind, p in LIMITS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


# Numbers that identify a document, a class or a page instead of saying an amount.
_NO_AMOUNT = (
    RECEPTOR, r"\([a-z][a-z .'-]*,\s*(?:19|20)\d{2}[a-z]?\)", r"\b(?:veja|vide|ver|consulte)\s+(?:(?:os?|as?)\s+)?(?:(?:item|itens|secao|secoes)\s+)?\d{1,2}(?:[.,]\d+)*",
    r"\b(?:item|itens|subitem|secao|secoes)\s+\d{1,2}(?:[.,]\d+)*", r"(?:^|\s)-\s?\d{1,4}\s?-(?:\s|$)", r"\b\d{1,2}\s*[-.)]\s*interacoes medicamentosas\b",
)


def clinical_numbers(folded: Column) -> Column:
    """Different numbers of a text, without those that identify a class, reference, section or page and
    without frequencies, which are compared by themselves."""
    rest = folded
    for pattern in _NO_AMOUNT:
        rest = F.regexp_replace(rest, pattern, " ")
    rest = F.regexp_replace(rest, r"\b\d+\s+vez(?:es)?\s+(?:ao|por)\s+(?:dia|semana)\b|\ba\s+cada\s+\d+(?:[.,]\d+)?\s*(?:horas?|h|dias?)\b", " ")
    return F.array_sort(numbers(rest))


def kept_facts(text: Column) -> Column:
    """struct of what a rewrite has to keep: doses, percentages, populations, measures, caveats."""
    f = fold_name(text)
    every = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(f, F.lit(p), F.lit(0))))
    return F.struct(
        F.array_sort(amounts(f)).alias("doses"), every(r"\d+(?:[.,]\d+)?\s*%").alias("percentuais"),
        every(r"\b(?:idosos?|criancas?|gestantes?|lactantes?|adultos?|pacientes com [a-z]+)\b").alias("populacoes"),
        every(r"\b(?:cmax|cmin|auc|meia-vida|inr|depuracao|area sob a curva)\b").alias("medidas"), every(r"\b(?:nao se sabe|desconhecid[oa]s?|pode[mn]?|possivel(?:mente)?)\b").alias("ressalvas"),
    )


def _signatures(text: str, names: list[str]) -> list[str]:
    known = [n for n in dict.fromkeys(names) if n]
    if not known:
        return []
    name = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True)) + r")(?!\w)")
    verb = re.compile(r"\b(?:(aument|elev|potencializ|intensific)|(redu[cz]|diminu|inib))\w*")
    out = set()
    for sentence in re.split(r"[.;]\s+|\n", text):
        places = [(m.start(), m.end(), m.group()) for m in name.finditer(sentence)]
        for v in verb.finditer(sentence):
            left = next((p for p in reversed(places) if p[1] <= v.start() and v.start() - p[1] <= 120), None)
            right = next((p for p in places if p[0] >= v.end() and p[0] - v.end() <= 120), None)
            if not left or not right or left[2] == right[2]:
                continue
            between = sentence[v.end() : right[0]]
            passive = re.match(r"\s*(?:\w+\s+)?por\b", between) is not None
            direct = re.fullmatch(r"\s*(?:[ao]s?\s+)?(?:(?:\w+\s+){0,4}d[eao]s?\s+)?", between) is not None
            if passive or direct:
                agent, affected = (right, left) if passive else (left, right)
                denied = re.search(r"\b(?:nao|sem)\b(?:\s+\w+){0,2}\s*$", sentence[max(0, v.start() - 45) : v.start()]) is not None
                out.add(f"{agent[2]}>{affected[2]}:{'aumento' if v.group(1) else 'reducao'}{':negado' if denied else ''}")
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def relation_signatures(folded: pd.Series, names: pd.Series) -> pd.Series:
    """Who changes whom and how, "agent>affected:direction[:negado]", of direct active and passive
    constructions between the given folded names."""
    return pd.Series([None if t is None else _signatures(t, [] if n is None else list(n)) for t, n in zip(folded, names)], dtype=object)


def focused(text: Column, target: Column) -> Column:
    """Sentences of an evidence about a target, and those that go on with it; the whole if none names it."""
    sentences = F.filter(F.split(text, r"(?<=[.!?;])\s+|\n+(?=\s*[•▪●◦*-])"), lambda s: F.trim(s) != "")
    names = lambda s: contains_term(fold_name(s), fold_name(target))
    goes_on = lambda s: fold_name(s).rlike(r"^(?:ess[ea]s?|est[ea]s?|isso|isto|tal|tais|portanto|assim|nesses? casos?|por isso)\b")
    kept = F.filter(sentences, lambda s, i: names(s) | ((i > 0) & goes_on(s) & names(F.coalesce(F.get(sentences, i - 1), F.lit("")))))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def completed_sentence(text: Column, source: Column) -> Column:
    """A text that stops inside a sentence of its source, up to the end of that sentence."""
    at = F.instr(source, text)
    rest = F.substring(source, at + F.length(text), F.length(source))
    tail = F.regexp_extract(rest, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when(text.rlike(r"[.!?]\s*$") | (at == 0), text).otherwise(F.concat(text, tail))


def input_problems(text: Column) -> Column:
    """struct of what makes an evidence unfit to be rewritten: symbols of a table, a list without an effect,
    no words."""
    f = fold_name(text)
    effect = f.rlike(r"\b(?:aument|diminu|reduz|potencializ|inib|risco|efeito|evit|contraindic|interfer|alter|toxic)\w*")
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return F.struct(text.rlike("[↑↓↔|]").alias("tabela"), ((commas >= 4) & ~effect).alias("lista_sem_efeito"), (F.size(plain_words(f)) < 3).alias("vazio"))


def measures_as_sentences(text: Column) -> Column:
    """Arrows of a table before a measure in words."""
    pairs = ((r"↑\s*(\pL+)", r"aumento de \1"), (r"↓\s*(\pL+)", r"redução de \1"), (r"↔\s*(\pL+)", r"sem alteração de \1"))
    return _chain(text, pairs)


def _columns(text: str) -> str:
    rows = [[(m.start(), m.group()) for m in re.finditer(r"\S+(?: \S+)*", line)] for line in text.splitlines() if line.strip()]
    width = max((len(r) for r in rows), default=0)
    full = [r for r in rows if len(r) == width]
    if width < 2 or 2 * len(full) < len(rows):
        return text
    starts = [sorted(r[i][0] for r in full)[len(full) // 2] for i in range(width)]
    cells: list[list[str]] = [[] for _ in range(width)]
    for row in rows:
        for at, cell in row:
            cells[min(range(width), key=lambda i: abs(starts[i] - at))].append(cell)
    return "\n".join(" ".join(c) for c in cells)


@F.pandas_udf(T.StringType())
def regrouped_columns(texts: pd.Series) -> pd.Series:
    """Lines of aligned columns read column by column: each piece goes to the column whose median start is
    nearest; a text without such lines stays as it is."""
    return pd.Series([None if t is None else _columns(t) for t in texts], dtype=object)


def without_repeats(text: Column) -> Column:
    """Sentences of a text, those whose content words an earlier one has said already left out."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    words = F.transform(sentences, lambda s: F.array_sort(F.array_distinct(F.filter(plain_words(fold_name(s)), lambda w: F.length(w) >= 4))))
    kept = F.filter(sentences, lambda s, i: (i == 0) | ~F.array_contains(F.slice(words, 1, F.greatest(i, F.lit(1))), F.get(words, i)))
    return F.array_join(kept, " ")


def longest_evidences(evidences: Column) -> Column:
    """Different evidences of a unit without those that another one contains."""
    once = F.array_distinct(evidences)
    return F.filter(once, lambda e: ~F.exists(once, lambda o: (o != e) & o.contains(e)))


def _blocks(items: list, most: int) -> list[list[int]]:
    groups: list[tuple[set, list[int]]] = []
    for item in items:
        mine, ids, rest = {t for t in item["alvos"] if t}, [item["id"]], []
        for names, members in groups:
            if names & mine:
                mine, ids = mine | names, members + ids
            else:
                rest.append((names, members))
        groups = [*rest, (mine, ids)]
    groups.sort(key=lambda g: min(g[1]))
    while len(groups) > most:
        small = sorted(range(len(groups)), key=lambda i: (len(groups[i][1]), i))[:2]
        a, b = sorted(small)
        merged = (groups[a][0] | groups[b][0], groups[a][1] + groups[b][1])
        groups = [g for i, g in enumerate(groups) if i not in small] + [merged]
        groups.sort(key=lambda g: min(g[1]))
    return [sorted(ids) for _, ids in groups]


def general_blocks(most: int = 3):
    """Column function array<struct<id, alvos>> -> array<array<long>>: relations of one text in at most
    ``most`` blocks; those that share a target stay together, the smallest blocks are joined."""

    def blocks(items: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _blocks(list(x), most) for x in items], dtype=object)

    blocks.__annotations__ = {"items": pd.Series, "return": pd.Series}
    return F.pandas_udf(blocks, T.ArrayType(T.ArrayType(T.LongType())))


def run_state(total: Column, done: Column, failed: Column) -> Column:
    """CONCLUIDO, PARCIAL, FALHA or PENDENTE of a run by its units."""
    return F.when((total > 0) & (done == total), "CONCLUIDO").when(done > 0, "PARCIAL").when(failed > 0, "FALHA").otherwise("PENDENTE")


def block_key(entry_hash: Column, model: Column, prompt: Column, block: Column) -> Column:
    """Address of a rewritten block, so that a run goes on where it stopped."""
    return F.sha2(F.concat_ws("\x1f", entry_hash, model, prompt, block.cast("string")), 256)


def read_output(text: Column) -> Column:
    """A rewritten text without a section title before it and without "segundo a bula"."""
    bare = F.regexp_replace(F.trim(text), r"^[^.:\n]{3,40}:\s+(?=\p{Lu})", "")
    bare = F.regexp_replace(bare, r"(?iu)\b(?:segundo|conforme|de acordo com) a bula,?\s*", "")
    return F.trim(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare))))


def response_problems(text: Column, source: Column, paragraph: bool = False) -> Column:
    """struct of what a produced text does that its source does not carry: length, list, markup, echoes,
    foreign quotations, certainty, severity, a phrase said three times."""
    f, s = fold_name(text), fold_name(source)
    low, high, gram = (60, 1200, 10) if paragraph else (40, 600, 6)
    words = F.split(f, " ")
    grams = F.when(F.size(words) >= gram, F.transform(F.sequence(F.lit(1), F.size(words) - gram + 1), lambda i: F.array_join(F.slice(words, i, gram), " "))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        (~F.length(text).between(low, high)).alias("tamanho"),
        (text.rlike(r"(?m)^\s*(?:\d+[.)]|[-*])\s") | (F.size(F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[.)]\s+[A-ZÀ-Ú]"), F.lit(0))) >= 2)).alias("lista"),
        text.rlike(r'(?i)[{}\[\]`]|<\|.*?\|>|(?:system|assistant|user)\s*:|"texto"\s*:').alias("marcacao"),
        F.exists(F.array(*[F.lit(e) for e in ECHOES]), lambda e: f.contains(e)).alias("eco"),
        (F.size(foreign_quotations(text, source)) > 0).alias("citacao"),
        F.exists(F.array(*[F.lit(c) for c in CERTAINTY]), lambda c: contains_term(f, c) & ~contains_term(s, c)).alias("certeza"),
        F.exists(F.regexp_extract_all(f, F.lit(SEVERITY), F.lit(1)), lambda g: ~s.contains(F.substring(g, 1, 5))).alias("gravidade"),
        F.exists(F.array_distinct(grams), lambda g: F.size(F.filter(grams, lambda x: x == g)) >= 3).alias("repeticao"),
    )


def fidelity(text: Column, source: Column) -> Column:
    """struct of barriers between a rewrite and its source: numbers added or lost, frequencies, limits,
    routes, receptor subtypes, a lost restriction, a lost possibility.  Failing one asks for review."""
    f, s = plain_wording(text), plain_wording(source)
    differ = lambda rule: F.size(F.array_except(rule(f), rule(s))) + F.size(F.array_except(rule(s), rule(f))) > 0
    receptors = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(RECEPTOR), F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", "")))
    return F.struct(
        (F.size(F.array_except(clinical_numbers(f), clinical_numbers(s))) > 0).alias("numero_novo"), (F.size(F.array_except(amounts(s), numbers(f))) > 0).alias("quantidade_perdida"),
        differ(frequencies).alias("frequencia"), differ(limits).alias("limite"), F.exists(routes(s), lambda r: ~f.contains(r)).alias("via"), differ(receptors).alias("receptor"),
        (s.rlike(RESTRICTED) & ~f.rlike(RESTRICTED + r"|\bevit\w*")).alias("restricao"), (s.rlike(r"\bpodem?\b") & ~f.rlike(r"\bpodem?\b|\bpossivel\b|\bpossibilidade\b")).alias("possibilidade"),
    )


def rewrite_verdict(text: Column, source: Column) -> Column:
    """The first reason a rewrite is refused for, null if none: an empty text, a problem of its own, a broken
    barrier against its source."""
    own, kept = response_problems(text, source), fidelity(text, source)
    verdict = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "VAZIO")
    for name in ("marcacao", "eco", "lista", "tamanho", "citacao", "certeza", "gravidade", "repeticao"):
        verdict = verdict.when(own[name], name.upper())
    for name in ("numero_novo", "quantidade_perdida", "frequencia", "limite", "via", "receptor", "restricao", "possibilidade"):
        verdict = verdict.when(kept[name], name.upper())
    return verdict


def attempts(log: DataFrame, most: int = 3, cap: int = 768) -> DataFrame:
    """(unidade, tentativas, estado, erros, limite) of an attempt log (unidade, tentativa, motivo, truncada,
    limite): finished by a text without reason, failed after ``most`` attempts, else the next output
    limit, half more after a cut, and the last three reasons as feedback."""
    last = F.array_sort(F.collect_list(F.struct("tentativa", "motivo", "truncada", "limite")))
    rows = log.groupBy("unidade").agg(last.alias("_l"), F.count("*").alias("tentativas"), F.count_if(F.col("motivo").isNull()).alias("_ok"))
    reasons = F.filter(F.transform("_l", lambda x: x["motivo"]), lambda m: m.isNotNull())
    end = F.element_at("_l", -1)
    limit = F.when(end["truncada"], F.least(F.lit(cap), F.floor(end["limite"] * 1.5))).otherwise(end["limite"])
    state = F.when(F.col("_ok") > 0, "CONCLUIDO").when(F.col("tentativas") >= most, "FALHA").otherwise("REPETIR")
    return rows.select("unidade", "tentativas", state.alias("estado"), F.slice(reasons, F.greatest(F.size(reasons) - 2, F.lit(1)), 3).alias("erros"), limit.cast("int").alias("limite"))
