"""Mentions of catalogue names in source texts, with literal evidence.

Every word of a passage meets the dictionary by the first word of its terms, an equi-join; the terms
that the following words complete are matches, taken from left to right, the longest first, without
overlap.  Each match is then accepted or rejected by rules over columns, in a fixed order.  All of it
is one plan of JVM expressions, but for passages with structured blocks and cuts of long evidence;
only narrow rows are shuffled, passages join last.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.text import _ACCENTED, fold_name, fold_target, list_of, not_blank, plain_words
from marisma.functions.vocabulary import (
    ABSENCE,
    CLAUSE_END,
    CONTEXT_AFTER,
    CONTEXT_BEFORE,
    CONTEXTUAL,
    ENANTIOMER_PREFIXES,
    EXCEPTION,
    EXCIPIENTS,
    EXTRA_ABSENCE,
    IGNORED_TERMS,
)
from marisma.operators.catalog import catalog_keys, ingredient_keys, key_words, substances, term_entries, terms
from marisma.operators.passages import block_effect, compact, cut_evidence, literal_summary, needs_cut, passages
from marisma.session import cut_lineage, is_small, spread

KEPT = 3
#: Characters of a clause that are read before and behind a target; words of its context.
NEGATION_WINDOW, CONTEXT_WORDS = 250, 4
#: Up to so many first words of terms are broadcast.
MAX_BROADCAST_WORDS = 500_000
_HYPHENATED = r"(?<=\pL)-\s*\n\s*(?=\pL)"
_LETTER = f"A-Za-z0-9{_ACCENTED}{_ACCENTED.upper()}"
_MARK = "\x01"


def _words(text: Column) -> Column:
    return plain_words(fold_name(F.regexp_replace(text, _HYPHENATED, "")))


def first_words(dictionary: DataFrame) -> DataFrame:
    """(_w, _t): the terms of each first word, longest first."""
    size = F.size(F.split("termo", " "))
    item = F.struct((-size).alias("_n"), "termo", "tipo")
    return dictionary.groupBy(F.substring_index("termo", " ", 1).alias("_w")).agg(F.array_sort(F.collect_list(item)).alias("_t"))


def dictionary_matches(parts: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """(key, trecho, inicio, palavras, termo, tipo): leftmost-longest matches of (termo, tipo).

    Words are exploded once, each with as many words behind it as the longest term has.  The
    candidates of one passage are folded in order by an aggregate that carries the next free
    position, so no window and no second shuffle is needed.
    """
    longest = dictionary.agg(F.coalesce(F.max(F.size(F.split("termo", " "))), F.lit(1))).first()[0]
    starts = first_words(dictionary.select("termo", "tipo"))
    starts = F.broadcast(starts) if is_small(starts, MAX_BROADCAST_WORDS) else starts
    listed = parts.select(key, "trecho", _words(F.col("texto")).alias("_w")).where(F.size("_w") > 0)
    follow = F.transform("_w", lambda w, i: F.struct(i.alias("inicio"), w.alias("_w"), F.array_join(F.slice("_w", i + 1, longest), " ").alias("_resto")))
    words = listed.select(key, "trecho", F.explode(follow).alias("_s")).select(key, "trecho", "_s.*")
    best = F.get(F.filter("_t", lambda t: F.concat("_resto", F.lit(" ")).startswith(F.concat(t["termo"], F.lit(" ")))), F.lit(0))
    found = words.join(starts, "_w").select(key, "trecho", "inicio", best.alias("_b")).where(F.col("_b").isNotNull())
    item = F.struct("inicio", (-F.col("_b._n")).alias("palavras"), F.col("_b.termo").alias("termo"), F.col("_b.tipo").alias("tipo"))
    grouped = found.groupBy(key, "trecho").agg(F.array_sort(F.collect_list(item)).alias("_c"))
    kind = "array<struct<inicio:int,palavras:int,termo:string,tipo:string>>"
    start = F.struct(F.lit(0).alias("livre"), F.array().cast(kind).alias("aceitos"))

    def take(acc: Column, c: Column) -> Column:
        free = c["inicio"] >= acc["livre"]
        return F.struct(F.when(free, c["inicio"] + c["palavras"]).otherwise(acc["livre"]).cast("int").alias("livre"), F.when(free, F.concat(acc["aceitos"], F.array(c))).otherwise(acc["aceitos"]).cast(kind).alias("aceitos"))

    taken = grouped.select(key, "trecho", F.explode(F.aggregate("_c", start, take, lambda a: a["aceitos"])).alias("_m"))
    return taken.select(key, "trecho", "_m.inicio", "_m.palavras", "_m.termo", "_m.tipo")


def ignored_terms(lines: list[str] | None = None) -> list[str]:
    """Keys of a term list, one a line, ``#`` begins a comment."""
    text = IGNORED_TERMS.splitlines() if lines is None else lines
    plain = ("".join(c for c in unicodedata.normalize("NFKD", x.split("#")[0].lower()) if not unicodedata.combining(c)) for x in text)
    return sorted({" ".join(re.findall("[a-z0-9]+", x)) for x in plain} - {""})


def _pieces(marked: Column) -> Column:
    """What stands before the first word, then each word with what follows it."""
    return F.split(marked, _MARK)


def _joined(pieces: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(pieces, first, count), "")


def _is_enantiomer(term: Column, own: Column) -> Column:
    """One of the substances and the term differ by an enantiomer's prefix only."""
    other = lambda a, b: F.array_contains(F.array(*[F.concat(F.lit(p), b) for p in ENANTIOMER_PREFIXES]), a)
    return F.exists(own, lambda s: other(s, term) | other(term, s))


def judged_links(found: DataFrame, key: str, catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, termo, tipo, _outros, _mesma) of each mention: whether entries other than the origin have
    the term, and whether all of them are other names of the origin's own substances.

    The entries of a term are aggregated to their different substance sets first, so a term of many
    entries is one row when it meets the origins.
    """
    entries = term_entries(catalog, keys)
    own = substances(catalog).withColumn("substancias", F.coalesce("substancias", F.array().cast("array<string>")))
    sets = entries.join(own, "nome_normalizado").groupBy("termo", "tipo").agg(F.count("*").alias("_n"), F.collect_set("substancias").alias("_s"))
    asked = found.select(key, "termo", "tipo").distinct()
    member = entries.select(F.col("nome_normalizado").alias(key), "termo", "tipo", F.lit(1).alias("_eu"))
    rows = asked.join(sets, ["termo", "tipo"], "left").join(member, [key, "termo", "tipo"], "left").join(own.select(F.col("nome_normalizado").alias(key), F.col("substancias").alias("_so")), key, "left")
    same = (F.size("_so") > 0) & F.forall("_s", lambda s: (F.size(s) > 0) & (F.size(F.array_except(s, F.col("_so"))) == 0))
    return rows.select(key, "termo", "tipo", (F.coalesce("_n", F.lit(0)) - F.coalesce("_eu", F.lit(0)) > 0).alias("_outros"), F.coalesce(same, F.lit(False)).alias("_mesma"), F.coalesce("_so", F.array().cast("array<string>")).alias("_so"))


def identify(source: DataFrame, catalog: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(nome_normalizado, trecho, inicio, palavras, termo, tipo, alvo, motivo, detalhe, texto): every
    match with the first reason of its rejection, null for accepted ones.

    Short acronyms that are not written as such are no matches.  ``ignored`` are lines of a term
    list; None takes the fixed one.
    """
    key = "nome_normalizado"
    parts = passages(spread(source.select(key, "trecho_interacoes"), key), key, "trecho_interacoes")
    # Matches are narrow and read several times; they are written once.
    keys = cut_lineage(catalog_keys(catalog))
    found = cut_lineage(dictionary_matches(parts, key, cut_lineage(terms(catalog, keys))))
    names = F.concat(F.array(*[fold_target(F.coalesce(c, F.lit(""))) for c in (key, "nome_anvisa")]), ingredient_keys(F.col("principios_ativos")))
    origin = catalog.select(key, F.transform(F.filter(names, lambda n: n != ""), plain_words).alias("_nomes"))
    # Rules read the passage once; it is joined by its number, narrow rows to wide ones.
    joined = F.regexp_replace("texto", _HYPHENATED, "")
    folded = fold_name(joined)
    letters = F.regexp_replace("texto", r"\PL", "")
    text = parts.join(found.select(key, "trecho").distinct(), [key, "trecho"], "left_semi").select(
        key, "trecho", "texto", folded.alias("_f"), _pieces(F.regexp_replace(folded, "([a-z0-9]+)", _MARK + "$1")).alias("_p"),
        _pieces(F.regexp_replace(joined, rf"([{_LETTER}][{_LETTER}\p{{M}}]*)", _MARK + "$1")).alias("_o"),
        (F.length(F.regexp_replace(letters, r"\P{Lu}", "")) > 0.6 * F.length(letters)).alias("_alta"), fold_name(block_effect(F.col("texto"))).alias("_efeito"),
    )
    rows = found.join(text, [key, "trecho"]).join(origin, key, "left").join(judged_links(found, key, catalog, keys), [key, "termo", "tipo"], "left")

    i, n, termo = F.col("inicio"), F.col("palavras"), F.col("termo")
    written = F.regexp_replace(_joined(F.col("_o"), i + 2, n), rf"[^{_LETTER}\p{{M}}]+$", "")
    shown = F.trim(F.regexp_replace(written, r"(?U)\s+", " "))
    aligned = F.size("_o") == F.size("_p")
    before, target = _joined(F.col("_p"), F.lit(1), i + 1), F.regexp_replace(_joined(F.col("_p"), i + 2, n), "[^a-z0-9]+$", "")
    rest = _joined(F.col("_p"), i + 2, F.size("_p"))
    rows = rows.withColumns({"alvo": F.when(aligned & (key_words(fold_target(shown)) == termo), shown).otherwise(termo), "_antes": before, "_resto": rest, "_tam": F.length(target)})
    left = F.regexp_replace("_antes", rf"(?s)^.*(?:{CLAUSE_END})", "")
    right = F.coalesce(F.nullif(F.regexp_extract("_resto", rf"(?s)^(.*?(?:{CLAUSE_END}))", 1), F.lit("")), F.col("_resto"))
    clause = F.concat(F.right(left, F.lit(NEGATION_WINDOW)), F.left(right, F.col("_tam") + NEGATION_WINDOW))
    denies = lambda x: x.rlike(f"{ABSENCE}|{EXTRA_ABSENCE}")
    words = F.transform(F.slice("_p", 2, F.size("_p")), lambda p: F.regexp_extract(p, "^[a-z0-9]+", 0))
    near = F.exists(F.slice(words, F.greatest(i - CONTEXT_WORDS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_WORDS))), lambda w: w.isin(*CONTEXT_BEFORE))
    parameter = termo.isin(*CONTEXTUAL) & (near | F.coalesce(F.get(words, i + n).isin(*CONTEXT_AFTER), F.lit(False)))
    self_named = F.coalesce(F.exists("_nomes", lambda s: F.size(F.array_except(F.split("termo", " "), s)) == 0), F.lit(False))
    listed = ignored_terms(ignored)
    reasons = [
        (termo.isin(*listed) if listed else F.lit(False), "ALVO_GENERICO", "Termo da lista de ignorados."),
        (self_named, "ALVO_E_ORIGEM", "Nome da própria origem."),
        (_is_enantiomer(termo, F.col("_so")), "ALVO_E_ORIGEM", "Enantiômero ou racemato da origem."),
        (F.col("_f").rlike(EXCIPIENTS), "ALVO_GENERICO", "Aviso de excipientes."),
        (F.col("_antes").rlike(EXCEPTION + r"[^:;.()]*$"), "RELACAO_NAO_POSITIVA", "Citado como exceção."),
        (parameter, "ALVO_GENERICO", "Parâmetro do organismo."),
        (denies(clause) | denies(F.col("_efeito")), "RELACAO_NAO_POSITIVA", "Interação negada na oração."),
        (~F.coalesce("_outros", F.lit(False)), "ALVO_INVALIDO", "Nenhuma entrada além da origem."),
        (F.coalesce("_mesma", F.lit(False)), "ALVO_E_ORIGEM", "Outro nome da substância da origem."),
    ]
    verdict = None
    for holds, reason, detail in reasons:
        value = F.struct(F.lit(reason).alias("motivo"), F.lit(detail).alias("detalhe"))
        verdict = F.when(holds, value) if verdict is None else verdict.when(holds, value)
    cited = written
    acronym = (F.length(termo) >= 4) | (~F.col("_alta") & aligned & (cited == F.upper(cited)) & cited.rlike(r"\pL"))
    return rows.where(acronym).withColumn("_v", verdict).select(key, "trecho", "inicio", "palavras", "termo", "tipo", "alvo", "_v.motivo", "_v.detalhe", "texto")


def rejections(identified: DataFrame) -> DataFrame:
    """(nome_normalizado, motivo, termo, detalhe, tipo, trecho): each reason once, at its first place."""
    rows = identified.where(F.col("motivo").isNotNull())
    return rows.groupBy("nome_normalizado", "motivo", "termo", "detalhe").agg(F.min_by("tipo", F.struct("trecho", "inicio")).alias("tipo"), F.min("trecho").alias("trecho"))


def word_spans(text: str) -> list[tuple[int, int]]:
    """(first, behind the last) character of each word of ``_words`` as it is written in ``text``."""

    def kind(c: str) -> str:
        bare = [x for x in c.lower() if unicodedata.category(x)[0] != "M"]
        return "x" if any(x in _ACCENTED or "a" <= x <= "z" or "0" <= x <= "9" for x in bare) else " " if bare else "m"

    kinds = {c: kind(c) for c in set(text)}
    signs = [kinds[c] for c in text]
    for m in re.finditer(r"-[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", text):
        if text[m.start() - 1 : m.start()].isalpha() and text[m.end() : m.end() + 1].isalpha():
            signs[m.start() : m.end()] = "j" * len(m.group())
    return [m.span() for m in re.finditer("x(?:[mj]*x)*m*", "".join(signs))]


@F.pandas_udf(T.StringType())
def _cut_evidence(texts: pd.Series, first: pd.Series, words: pd.Series) -> pd.Series:
    spans = {t: word_spans(t) for t in texts.dropna().unique()}
    return pd.Series([None if t is None else cut_evidence(t, spans[t][i][0], spans[t][i + n - 1][1]) for t, i, n in zip(texts, first, words)], dtype=object)


def with_evidence(identified: DataFrame) -> DataFrame:
    """Accepted matches with (evidencia, _q), the literal evidence and its identity.  Only passages that
    are cut reach Python."""
    cut = _cut_evidence(F.when(needs_cut(F.col("texto")), F.col("texto")), "inicio", "palavras")
    rows = identified.where(F.col("motivo").isNull()).withColumn("evidencia", F.coalesce(cut, "texto"))
    return rows.withColumn("_q", F.lower(compact(F.col("evidencia"))))


def relations(identified: DataFrame) -> DataFrame:
    """Accepted matches with evidence and literal summary: at most ``KEPT`` different evidences per
    origin and term, in text order."""
    key = "nome_normalizado"
    rows = with_evidence(identified)
    first = rows.groupBy(key, "termo", "tipo", "_q").agg(F.min_by(F.struct("trecho", "inicio", "alvo", "evidencia"), F.struct("trecho", "inicio")).alias("_m")).select(key, "termo", "tipo", "_m.*")
    w = Window.partitionBy(key, "termo").orderBy("trecho", "inicio")
    kept = first.withColumn("ordem", F.row_number().over(w)).where(F.col("ordem") <= KEPT)
    return kept.select(key, "termo", "alvo", F.col("tipo").alias("tipo_alvo"), "trecho", "ordem", "evidencia", literal_summary(F.col("evidencia"), F.col("alvo")).alias("resumo"))


def counts(identified: DataFrame) -> DataFrame:
    """(nome_normalizado, relacoes, omitidas): kept evidences of each origin, and accepted matches whose
    evidence is none of the kept ones; one pass over the matches."""
    key = "nome_normalizado"
    groups = with_evidence(identified).groupBy(key, "termo", "tipo", "_q").agg(F.min(F.struct("trecho", "inicio")).alias("_m"), F.count("*").alias("_n"))
    ranked = groups.withColumn("_r", F.row_number().over(Window.partitionBy(key, "termo").orderBy("_m")))
    return ranked.groupBy(key).agg(F.count_if(F.col("_r") <= KEPT).alias("relacoes"), F.coalesce(F.sum(F.when(F.col("_r") > KEPT, F.col("_n"))), F.lit(0)).alias("omitidas"))


def run_status(source: DataFrame, counted: DataFrame) -> DataFrame:
    """(nome_normalizado, status, relacoes, aviso) of every source by its :func:`counts`: FALHA for a blank
    text; the notice says how many matches stand beyond the kept evidences."""
    rows = source.select("nome_normalizado", F.coalesce(not_blank(F.col("trecho_interacoes")), F.lit(False)).alias("_t")).join(counted, "nome_normalizado", "left")
    status = F.when(~F.col("_t"), "FALHA").when(F.coalesce("relacoes", F.lit(0)) == 0, "CONCLUIDO_SEM_RELACOES").otherwise("CONCLUIDO_COM_RELACOES")
    notice = F.when(F.col("omitidas") > 0, F.format_string(f"%d ocorrência(s) além de {KEPT} trechos por nome.", "omitidas"))
    return rows.select("nome_normalizado", status.alias("status"), F.coalesce("relacoes", F.lit(0)).alias("relacoes"), notice.alias("aviso"))
