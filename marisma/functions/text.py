"""Normal forms of names and texts, as JVM column expressions.

Null stays null everywhere.  Accents are removed for composed Latin letters and for combining
marks; ``lower`` stands in for case folding, which differs only for letters such as the sharp s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions.vocabulary import STOP_WORDS

# Composed Latin letters and their base letters.
_ACCENTED = "áàâãäåāăąéèêëēėęěíìîïīįóòôõöōőúùûüūůűçćčñńňýÿžźżšśğťřďľ"
_PLAIN = "aaaaaaaaaeeeeeeeeiiiiiiooooooouuuuuuucccnnnyyzzzssgtrdl"


def without_accents(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), _ACCENTED, _PLAIN)


def fold_name(text: Column) -> Column:
    """Identity of a name: lower case, no accents, single blanks, no outer blanks."""
    return F.trim(F.regexp_replace(without_accents(text), r"(?U)\s+", " "))


def fold_target(text: Column) -> Column:
    """Identity of a mentioned target: no trade marks, no border punctuation."""
    bare = fold_name(F.regexp_replace(text, "[®™©]", " "))
    return F.regexp_replace(bare, r"^[\s.,;:!?()\[\]{}\"'*…-]+|[\s.,;:!?()\[\]{}\"'*…-]+$", "")


def quotation_key(text: Column) -> Column:
    """Identity of a quotation: no blanks, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def plain_words(folded: Column) -> Column:
    """[a-z0-9]+ words of a folded text."""
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))


def relevant_words(folded: Column) -> Column:
    """Words of three letters or more that carry content."""
    return F.filter(plain_words(folded), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term containment between two folded columns, never inside a word."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(plain_words(c), " "), F.lit(" "))
    return (F.size(plain_words(term)) > 0) & pad(text).contains(pad(term))


def not_blank(text: Column) -> Column:
    """Text that is not null and not made of spaces only."""
    return F.nullif(F.btrim(text), F.lit("")).isNotNull()


def is_filled(text: Column) -> Column:
    """Text that is not null and has more than white space of any kind."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def display_name(name: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(name), F.lit("")), key)


def list_of(text: Column) -> Column:
    """Entries of a ;-separated list, trimmed, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def slug(name: Column) -> Column:
    """File-name form, at most 100 characters, a hash where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(fold_name(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 100), F.lit("")), F.substring(F.sha2(name, 256), 1, 12))
