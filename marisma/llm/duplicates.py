"""Duplicates hidden by formatting differences (problem 3).

A statement is a multiset of (field name, normalised value) pairs: one unnamed field for free
text, one per label for statements made of labelled fields.  Normalising keeps letters and digits
in order, and a comma or point between two digits, because it is part of the number.  Each pair is
hashed and the hashes are added modulo a prime, which does not depend on the order of the fields;
rows of equal fingerprint are grouped on that number alone, so the text is not shuffled for rows
without a copy, and field equality is then verified by counting pairs, without sorting.

Null texts take part in nothing; texts without any letter or digit have no statement and take
part in nothing; the same row delivered twice under one id is one member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.session import cut_lineage, is_small

# The labels of statements made of fields.
LABELS = ("medicamento", "efeito", "conduta", "dados")
#: Modulus of the commutative hash (the Mersenne prime 2^61 - 1); two seeds make 122 bits.
PRIME = (1 << 61) - 1
#: Rows of one group are spread over so many keys when they meet their representative.
SALTS = 16
#: Up to so many groups (three numbers each) are broadcast to find their rows; beyond, a salted join.
MAX_BROADCAST_GROUPS = 500_000

_LABEL = rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(LABELS)})\s*[:\x{{ff1a}}]"
_MARK = "\ue000"


def normal_value(value: Column) -> Column:
    """Letters and digits in order, decimal signs kept, lower case."""
    kept = F.regexp_replace(F.lower(value), r"(?<=\p{N}),(?=\p{N})", "\ue001")
    kept = F.regexp_replace(kept, r"(?<=\p{N})\.(?=\p{N})", "\ue002")
    return F.regexp_replace(kept, r"[^\p{L}\p{N}\x{e001}\x{e002}]+", "")


def statement_fields(text: Column) -> Column:
    """array<struct<nome, valor>> of a statement."""
    pieces = F.split(F.regexp_replace(text, _LABEL, _MARK + "$1" + "\ue003"), _MARK)
    labelled = F.transform(
        pieces,
        lambda p: F.when(
            p.contains("\ue003"),
            F.struct(F.lower(F.substring_index(p, "\ue003", 1)).alias("nome"), normal_value(F.substring_index(p, "\ue003", -1)).alias("valor")),
        ).otherwise(F.struct(F.lit("").alias("nome"), normal_value(p).alias("valor"))),
    )
    # What stands before the first label (a bullet, a quote) is a field only if it says something.
    labelled = F.filter(labelled, lambda f: (f["nome"] != "") | (f["valor"] != ""))
    whole = F.array(F.struct(F.lit("").alias("nome"), normal_value(text).alias("valor")))
    return F.when(F.size(pieces) > 2, labelled).otherwise(F.filter(whole, lambda f: f["valor"] != ""))


def fingerprint(fields: Column) -> Column:
    """struct<h1, h2>: sums of the pair hashes modulo a prime, equal for any order of the fields."""
    pair = lambda f, seed: F.pmod(F.xxhash64(F.lit(seed), f["nome"], f["valor"]), F.lit(PRIME))
    zero = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    add = lambda acc, f: F.struct(F.pmod(acc["h1"] + pair(f, 1), F.lit(PRIME)).alias("h1"), F.pmod(acc["h2"] + pair(f, 2), F.lit(PRIME)).alias("h2"))
    return F.aggregate(fields, zero, add)


def same_fields(left: Column, right: Column) -> Column:
    """Multiset equality by counting each pair on both sides."""
    count = lambda fields, x: F.size(F.filter(fields, lambda y: y == x))
    return (F.size(left) == F.size(right)) & F.forall(left, lambda x: count(left, x) == count(right, x))


def statement_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_mantido, id_membro) of every row that has a copy, the kept row included.

    One shuffle of (key, two longs) finds the groups, with partial aggregation, so a group that
    holds a third of all rows arrives as one row per task.  Where the groups are few enough to be
    broadcast, only rows of groups carry their fields further; a hot group is salted over ``SALTS``
    keys.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    rows = rows.select("id", statement_fields(F.col("_t")).alias("campos"))
    rows = rows.withColumn("h", fingerprint(F.col("campos")))
    groups = rows.groupBy("h").agg(F.min("id").alias("id_mantido"), F.max("id").alias("_ultimo"), F.max(F.size("campos")).alias("_n"))
    groups = cut_lineage(groups.where("id_mantido < _ultimo and _n > 0").select("h", "id_mantido"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    if is_small(groups, MAX_BROADCAST_GROUPS):
        met = rows.join(F.broadcast(groups), "h").withColumn("_s", salt)
    else:
        met = rows.withColumn("_s", salt).join(groups.withColumn("_s", F.explode(salts)), ["h", "_s"])
    # Rows that have a copy are written once, so that neither the scan nor the hashing repeats.
    members = cut_lineage(met.select("id_mantido", "id", "_s", "campos"))
    kept = members.where("id = id_mantido").groupBy("id_mantido").agg(F.first("campos").alias("_campos"))
    kept = kept.withColumn("_s", F.explode(salts))
    met = members.join(kept, ["id_mantido", "_s"])
    met = met.select("id_mantido", "id", "campos", same_fields(F.col("campos"), F.col("_campos")).alias("_igual"))
    # Different statements of one 122-bit fingerprint: grouped again by the fields themselves.
    apart = met.where(~F.col("_igual")).withColumn("_k", F.array_sort("campos").cast("string"))
    again = apart.groupBy("_k").agg(F.min("id").alias("id_mantido"))
    apart = apart.drop("id_mantido").join(again, "_k").select("id_mantido", "id")
    return met.where("_igual").select("id_mantido", "id").unionByName(apart).withColumnRenamed("id", "id_membro")


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_mantido, id_copia), one row for each member other than the kept one."""
    return statement_groups(df, key, text).where("id_membro <> id_mantido").select("id_mantido", F.col("id_membro").alias("id_copia")).distinct()


def collapsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_mantido, copias) of every kept row, 0 for statements without a copy."""
    pairs = copies(df, key, text)
    counted = pairs.groupBy("id_mantido").agg(F.count("*").alias("copias"))
    said = normal_value(F.col(text)) != ""
    rows = df.where(said).select(F.col(key).alias("id_mantido")).distinct()
    kept = rows.join(pairs.select(F.col("id_copia").alias("id_mantido")), "id_mantido", "left_anti")
    return kept.join(counted, "id_mantido", "left").select("id_mantido", F.coalesce("copias", F.lit(0)).cast("long").alias("copias"))
