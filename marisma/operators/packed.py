"""Several values packed in one field (problem 4).

Fields are split into one value per row with its position.  Which marks separate is inferred per
source (the field): every candidate mark is tried on every row that has it outside quotes,
parentheses, numbers and units, and scored by the type regularity of the pieces it makes (balanced,
starting with a letter, of value length; by piece and by whole row) and by the consistency of their
number over the rows.  Marks that pass are used together, because hand-packed rows mix them.

Null fields give no row; blank fields and runs of separators give none either; an unbalanced quote
or parenthesis is an ordinary character; enclosing quotes and list bullets are removed and a
doubled quote is one quote.  Everything runs as JVM expressions over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate marks by name: the pattern of the mark where it separates.
CANDIDATES = {
    "ponto_e_virgula": r";",
    "virgula": r"(?<!\d),|,(?!\d)",
    "barra_vertical": r"\|",
    "tabulacao": r"\t",
    "linha": r"[\r\n]",
    "mais": r"(?<=\s)\+(?=\s)",
    "barra": r"(?<=\s)/(?=\s)",
    "marcador": r"[\x{2022}\x{b7}\x{25aa}]",
    "e": r"(?<=\s)e(?=\s)",
    "ponto": r"\.",
    "dois_pontos": r":",
    "hifen": r"-",
}
#: Weights of the score: regular pieces, regular rows, rows that agree in their number of pieces.  A
#: field holds as many values as it happens to, so agreement in number is the weakest sign.
WEIGHTS = (0.45, 0.45, 0.1)
#: A candidate separates from this score on.
LEAST_SCORE = 0.7

# One character, or a region inside which nothing separates.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_SINGLE = r"(?<![\p{L}\p{N}])'[^']*'(?![\p{L}\p{N}])"
_PARENS = r"\([^()]*\)"
_BULLET = r"^[\s\x{2022}\x{b7}\x{25aa}*]+|^\s*[-\x{2013}](?=\s)"
# A regular piece: starts with a letter, a name of three letters or more, at most sixteen words.
_REGULAR = r"^\p{L}[\p{L}-]{2,}(?:\s+\S+){0,15}$|^['\"\(]"


def piece_pattern(marks: list[str]) -> str:
    """Pattern of one piece: the longest run of regions and of characters that do not separate."""
    stop = "|".join(f"(?:{CANDIDATES[m]})" for m in marks)
    return rf"(?s)(?:{_QUOTED}|{_SINGLE}|{_PARENS}|(?!{stop}).)++"


def clean_piece(piece: Column) -> Column:
    """A piece without outer blanks, list bullets and enclosing quotes."""
    text = F.regexp_replace(F.regexp_replace(piece, r"^\s+|\s+$", ""), _BULLET, "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    double = F.regexp_replace(F.regexp_replace(text, r'^"|"$', ""), '""', '"')
    single = F.regexp_replace(text, r"^'|'$", "")
    inner = F.when(text.rlike(rf"(?s)^{_QUOTED}$"), double).when(text.rlike(r"(?s)^'[^']*'$"), single).otherwise(text)
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def pieces_of(field: Column, pattern: Column) -> Column:
    """Non-empty values of a field in order."""
    return F.filter(F.transform(F.regexp_extract_all(field, pattern, F.lit(0)), clean_piece), lambda p: p != "")


def _long(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("texto")) for f in fields])
    return df.select(F.col(key), F.explode(F.filter(pairs, lambda p: p["texto"].isNotNull())).alias("_p")).select(key, "_p.campo", "_p.texto")


def score_marks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(campo, marca, linhas, pecas_regulares, linhas_regulares, contagem_consistente, pontuacao): the
    score of each candidate mark.

    ``contagem_consistente`` is the chance that two rows of the mark agree in their number of pieces.
    One row per source, candidate and number of pieces is shuffled, whatever the size of the table.
    """
    marks = F.array(*[F.struct(F.lit(m).alias("marca"), F.lit(piece_pattern([m])).alias("padrao")) for m in CANDIDATES])
    tried = _long(df, key, fields).withColumn("_m", F.explode(marks))
    tried = tried.select("campo", "_m.marca", F.filter(F.regexp_extract_all("texto", F.col("_m.padrao"), F.lit(0)), lambda p: F.trim(p) != "").alias("pecas"))
    tried = tried.where(F.size("pecas") > 1)
    good = F.size(F.filter("pecas", lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), _BULLET, "").rlike(_REGULAR)))
    counted = tried.select("campo", "marca", F.size("pecas").alias("n"), good.alias("bons"))
    by_number = counted.groupBy("campo", "marca", "n").agg(F.count("*").alias("linhas"), F.sum("bons").alias("bons"), F.count_if(F.col("bons") == F.col("n")).alias("inteiras"))
    scored = by_number.groupBy("campo", "marca").agg(
        F.sum("linhas").alias("linhas"),
        (F.sum("bons") / F.sum(F.col("n") * F.col("linhas"))).alias("pecas_regulares"),
        (F.sum("inteiras") / F.sum("linhas")).alias("linhas_regulares"),
        (F.sum(F.col("linhas") * F.col("linhas")) / (F.sum("linhas") * F.sum("linhas"))).alias("contagem_consistente"),
    )
    score = sum((F.col(c) * w for c, w in zip(("pecas_regulares", "linhas_regulares", "contagem_consistente"), WEIGHTS)), F.lit(0.0))
    return scored.withColumn("pontuacao", score)


def inferred_marks(df: DataFrame, key: str, fields: list[str]) -> dict[str, list[str]]:
    """Accepted marks of each source; at most one short list per source reaches the driver."""
    scored = score_marks(df, key, fields).where(F.col("pontuacao") >= LEAST_SCORE)
    accepted: dict[str, list[str]] = {f: [] for f in fields}
    for row in scored.select("campo", "marca").collect():
        accepted[row["campo"]].append(row["marca"])
    return {f: [m for m in CANDIDATES if m in found] for f, found in accepted.items()}


def _positioned(values: Column, field: str) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(field).alias("campo"), (i + 1).cast("long").alias("posicao"), v.alias("valor")))


def unpack(df: DataFrame, key: str, fields: list[str], marks: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, campo, posicao, valor): one row per value, ``posicao`` from 1 over non-empty values."""
    marks = inferred_marks(df, key, fields) if marks is None else marks
    parts = []
    for f in fields:
        found = marks.get(f)
        whole = F.filter(F.array(clean_piece(F.col(f))), lambda p: p != "")
        values = pieces_of(F.col(f), F.lit(piece_pattern(found))) if found else whole
        parts.append(F.when(F.col(f).isNotNull(), _positioned(values, f)).otherwise(F.array()))
    return df.select(F.col(key), F.explode(F.flatten(F.array(*parts))).alias("_v")).select(key, "_v.campo", "_v.posicao", "_v.valor")
