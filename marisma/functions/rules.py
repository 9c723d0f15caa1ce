"""Rules on clauses: absence, recommendation, fidelity of a summary to its evidence.

The patterns stand in :mod:`marisma.functions.vocabulary` and read folded text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions.text import contains_term, fold_name, fold_target, plain_words, relevant_words
from marisma.functions.vocabulary import ABSENCE, CLAUSE_END, DECREASE, DOSE_IN_SUMMARY, GENERIC_WORDS, INCREASE, NEGATION, QUALITATIVE_DOSE, QUANTITY, RECOMMENDATION, RESTRICTION, ROUTE, SEVERITY

def clauses(folded: Column) -> Column:
    return F.filter(F.split(folded, CLAUSE_END), lambda c: F.trim(c) != "")


def clauses_about(folded: Column, target: Column) -> Column:
    """Clauses that name the target, whole or by all its relevant words; else the whole text."""
    words = relevant_words(target)
    names = lambda c: contains_term(c, target) | ((F.size(words) > 0) & F.forall(words, lambda w: contains_term(c, w)))
    own = F.filter(clauses(folded), names)
    return F.when(F.size(own) > 0, own).otherwise(F.array(folded))


def is_not_positive(evidence: Column, target: Column) -> Column:
    """Some clause about the target says absence and none recommends anything; null texts: no."""
    text = fold_name(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"(?<=\pL)-\s*\n\s*(?=\pL)", ""))
    own = clauses_about(text, fold_target(F.coalesce(target, F.lit(""))))
    # A clause is a part of the text, so most texts are decided without being cut into clauses.
    return F.when(text.rlike(ABSENCE), F.exists(own, lambda c: c.rlike(ABSENCE)) & ~F.exists(own, lambda c: c.rlike(RECOMMENDATION))).otherwise(F.lit(False))


_NUMBER = r"\d+(?:[.,]\d+)?"


def numbers(folded: Column, pattern: str = _NUMBER) -> Column:
    """Different numbers of the matches of a pattern, decimal comma."""
    found = F.transform(F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)), lambda m: F.regexp_extract(m, _NUMBER, 0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit("."), F.lit(","))))


def amounts(folded: Column) -> Column:
    """Different doses, quantities and frequencies of a text."""
    return numbers(folded, QUANTITY)


def missing_amounts(summary: Column, evidence: Column) -> Column:
    """Amounts the evidence has and no number of the summary repeats."""
    return F.array_sort(F.array_except(amounts(fold_name(evidence)), numbers(fold_name(summary))))


def routes(folded: Column) -> Column:
    """Roots of the routes and forms a text names."""
    named = F.regexp_extract_all(folded, F.lit(ROUTE), F.lit(1))
    bare = F.regexp_extract_all(folded, F.lit(ROUTE), F.lit(2))
    return F.array_distinct(F.transform(F.filter(F.concat(named, bare), lambda r: r != ""), lambda r: F.substring(r, 1, 6)))


def lexical_support(summary: Column, evidence: Column, stem: int = 5) -> Column:
    """Share of the summary's content words of four letters or more whose stem the evidence has; null
    if it has none."""
    letters = lambda t: F.filter(F.regexp_extract_all(fold_name(t), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    words = F.filter(letters(summary), lambda w: ~w.isin(*GENERIC_WORDS))
    stems = F.array_distinct(F.transform(letters(evidence), lambda w: F.substring(w, 1, stem)))
    hit = F.size(F.filter(words, lambda w: F.array_contains(stems, F.substring(w, 1, stem))))
    return F.when(F.size(words) > 0, hit / F.size(words))


def effect_direction(folded: Column) -> Column:
    return F.when(folded.rlike(INCREASE), F.lit("AUMENTO")).when(folded.rlike(DECREASE), F.lit("REDUCAO")).otherwise(F.lit("OUTRO"))


def fidelity_flags(summary: Column, evidence: Column, about: Column | None = None) -> Column:
    """struct of what a summary adds or loses against its evidence; ``about`` is the folded text of the
    clauses about its target (the whole evidence if None)."""
    s, e = fold_name(summary), fold_name(evidence)
    own = e if about is None else about
    invented = F.exists(F.regexp_extract_all(s, F.lit(SEVERITY), F.lit(1)), lambda g: ~e.contains(F.substring(g, 1, 5)))
    return F.struct(
        (own.rlike(NEGATION) & ~s.rlike(RESTRICTION)).alias("negacao_perdida"),
        (F.size(F.array_except(amounts(own), numbers(s))) > 0).alias("quantidade_perdida"),
        (own.rlike(QUALITATIVE_DOSE) & ~s.rlike(DOSE_IN_SUMMARY)).alias("condicao_perdida"),
        F.exists(routes(own), lambda r: ~s.contains(r)).alias("via_perdida"),
        invented.alias("gravidade_inventada"),
        ((s.rlike(INCREASE) & ~e.rlike(INCREASE)) | (s.rlike(DECREASE) & ~e.rlike(DECREASE))).alias("direcao_inventada"),
        (F.coalesce(lexical_support(summary, evidence), F.lit(1.0)) < 0.5).alias("pouco_apoio"),
    )
