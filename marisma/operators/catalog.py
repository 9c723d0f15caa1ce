"""Keys under which catalogue entries are known, and the links of a mentioned target."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.text import fold_target, list_of, plain_words
from marisma.functions.vocabulary import ANIONS, EQUIVALENCE, EXCIPIENT_LABEL, NEW_BLOCK, NOT_CONTAINED, SALT_AFTER, SALT_BEFORE

# The criteria in order of preference.
PRIORITY = {"NOME_MEDICAMENTO_EXATO": 0, "PRINCIPIO_ATIVO_EXATO": 1, "COMPOSICAO_EQUIVALENCIA_DECLARADA": 2, "PRINCIPIO_ATIVO_SEM_SAL": 3}


def key_words(text: Column) -> Column:
    """Words of a folded target joined by single blanks."""
    return F.array_join(plain_words(text), " ")


def without_salt(key: Column) -> Column:
    """Key without one leading salt and all trailing salts and hydrates; unchanged if fewer than four
    letters or only an anion is left."""
    bare = F.regexp_replace(key, SALT_BEFORE, "")
    for _ in range(4):
        bare = F.regexp_replace(bare, SALT_AFTER, "")
    return F.when((F.length(bare) >= 4) & ~bare.isin(*ANIONS), bare).otherwise(key)


def _keys_of(ingredient: Column) -> Column:
    """Keys of one ingredient: as it is, without a trailing note in parentheses, without " base"."""
    head = F.nullif(F.regexp_extract(F.trim(ingredient), r"^([^()]+?)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*$", 1), F.lit(""))
    both = F.array(fold_target(ingredient), fold_target(F.coalesce(head, ingredient)))
    every = F.concat(both, F.transform(both, lambda k: F.when(F.length(k) > 5, F.regexp_replace(k, r"\s* base$", "")).otherwise(k)))
    return F.array_distinct(F.filter(F.transform(every, key_words), lambda k: k != ""))


def ingredient_keys(ingredients: Column) -> Column:
    """Keys of a ;-separated ingredient list."""
    return F.array_distinct(F.flatten(F.transform(list_of(ingredients), _keys_of)))


def _equivalences(composition: str | None, ingredients: str | None) -> list[str]:
    names = [n for n in (_plain(x) for x in (ingredients or "").split(";")) if n]
    found, skipped, owner = [], False, None
    for line in filter(None, (x.strip() for x in (composition or "").splitlines())):
        skipped = bool(re.match(EXCIPIENT_LABEL, line)) or (skipped and not re.match(NEW_BLOCK, line))
        if skipped or re.search(NOT_CONTAINED, line):
            owner = None
            continue
        words = f" {_plain(line)} "
        named = next((n for n in names if f" {n} " in words), None)
        # A note on a line of its own belongs to the ingredient before it.
        owner = named or (owner if line[0] in "(*" else None)
        if owner:
            keys = (_plain(m.group(1)) for m in re.finditer(EQUIVALENCE, line))
            found += [k for k in keys if len(k) >= 3 and k != owner and re.search("[a-z]", k)]
    return found


def _plain(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", bare))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _declared(composition: pd.Series, ingredients: pd.Series) -> pd.Series:
    return pd.Series([_equivalences(c, i) if c else [] for c, i in zip(composition, ingredients)], dtype=object)


def declared_equivalences(composition: Column, ingredients: Column) -> Column:
    """Keys of substances that a composition declares equivalent to one of the ingredients; lines of
    excipients and of absence are skipped.  Only compositions that declare any reach Python."""
    return _declared(F.when(composition.rlike("(?i)equivalente|correspond"), composition), ingredients)


def catalog_keys(catalog: DataFrame) -> DataFrame:
    """(chave, nome_normalizado, criterio, prioridade): every key of every entry, one row for each
    criterion."""
    of = lambda keys, criterion: F.transform(keys, lambda k: F.struct(k.alias("chave"), F.lit(criterion).alias("criterio")))
    own = ingredient_keys(F.col("principios_ativos"))
    names = F.array_distinct(F.array(*[key_words(fold_target(F.coalesce(c, F.lit("")))) for c in ("nome_normalizado", "nome_anvisa")]))
    rows = catalog.where(F.col("nome_normalizado").isNotNull()).withColumn("_d", declared_equivalences(F.col("composicao"), F.col("principios_ativos")))
    every = F.concat(of(names, "NOME_MEDICAMENTO_EXATO"), of(own, "PRINCIPIO_ATIVO_EXATO"), of(F.array_except("_d", own), "COMPOSICAO_EQUIVALENCIA_DECLARADA"), of(F.transform(own, without_salt), "PRINCIPIO_ATIVO_SEM_SAL"))
    order = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    rows = rows.select("nome_normalizado", F.explode(every).alias("_k")).select("_k.chave", "nome_normalizado", "_k.criterio", order[F.col("_k.criterio")].alias("prioridade"))
    return rows.where("chave <> ''").distinct()


def substances(catalog: DataFrame) -> DataFrame:
    """(nome_normalizado, substancias): the shortest key of each ingredient, salt-free, sorted."""
    shortest = lambda i: F.array_min(F.transform(_keys_of(i), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    own = F.array_sort(F.array_distinct(F.filter(F.transform(list_of(F.col("principios_ativos")), lambda i: without_salt(shortest(i))), lambda k: k.isNotNull())))
    return catalog.select("nome_normalizado", own.alias("substancias"))


def terms(catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(termo, tipo): searchable names of three letters or more; an ingredient wins over a name.
    Declared equivalences come from free text and only link, they are not searched.  ``keys`` are the
    catalogue's keys, if they are made already."""
    rows = (catalog_keys(catalog) if keys is None else keys).where((F.length("chave") >= 3) & ~F.col("chave").rlike("^[0-9 ]+$") & (F.col("criterio") != "COMPOSICAO_EQUIVALENCIA_DECLARADA"))
    return rows.groupBy(F.col("chave").alias("termo")).agg(F.when(F.max("prioridade") > 0, "PRINCIPIO_ATIVO").otherwise("MEDICAMENTO").alias("tipo"))


def term_entries(catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(termo, tipo, nome_normalizado): the entries a searchable term links, by its type: names by
    their name, ingredients by their keys, equivalences and salt-free form."""
    keys = catalog_keys(catalog) if keys is None else keys
    by_name = keys.where("prioridade = 0").select(F.col("chave").alias("termo"), F.lit("MEDICAMENTO").alias("tipo"), "nome_normalizado")
    exact = keys.where("prioridade > 0 AND prioridade < 3").select(F.col("chave").alias("termo"), F.lit("PRINCIPIO_ATIVO").alias("tipo"), "nome_normalizado")
    bare = keys.where("prioridade = 3").select(F.col("chave").alias("_b"), "nome_normalizado")
    searched = terms(catalog, keys).where("tipo = 'PRINCIPIO_ATIVO'").withColumn("_b", without_salt(F.col("termo")))
    by_bare = searched.join(bare, "_b").select("termo", "tipo", "nome_normalizado")
    return by_name.unionByName(exact).unionByName(by_bare).distinct()


def resolve(mentions: DataFrame, catalog: DataFrame, target: str, origin: str) -> DataFrame:
    """``mentions`` joined to the entries their target names, other than the origin, each by its
    preferred criterion: exact key first, then the salt-free key."""
    keys = catalog_keys(catalog)
    key = key_words(fold_target(F.col(target)))
    asked = mentions.withColumn("_k", F.explode(F.array(F.struct(key.alias("k"), F.lit(0).alias("s")), F.struct(without_salt(key).alias("k"), F.lit(3).alias("s"))))).withColumn("chave", F.col("_k.k"))
    # The salt-free form of a target meets salt-free keys only, its full form the exact ones.
    fits = F.when(F.col("_k.s") == 0, F.col("prioridade") < 3).otherwise(F.col("prioridade") == 3)
    met = asked.join(keys, "chave").where(fits & (F.col("nome_normalizado") != F.coalesce(F.col(origin), F.lit(""))))
    rows = met.groupBy(*mentions.columns, F.col("nome_normalizado").alias("medicamento_relacionado")).agg(F.min_by("criterio", "prioridade").alias("criterio_vinculo"))
    return rows.select(*mentions.columns, "medicamento_relacionado", "criterio_vinculo")
