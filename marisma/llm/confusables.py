"""Visually identical text with different characters (problem 2).

A *skeleton* of a text is made by decomposing it, replacing every character by the prototype of
its look-alike class and decomposing again; texts of equal skeleton look the same.  The consistent
form is what a reader sees, written with the usual characters: full-width forms and ligatures
become plain letters, combining marks are composed, invisible characters go, every space is U+0020
and a letter of another alphabet inside a Latin word is its Latin prototype.  Signs in proper use
(®, º, ª, ², ≥, –, curly quotes, a Greek letter that stands alone) stay as they are.

Prototypes come from the public confusables data, which the session's ICU library carries
(:func:`prototypes`); a short table of fixed values goes before it, for letters whose lower-case
form that data keeps apart.  Data that cannot be read is an error: by the fixed values alone fewer
texts would look the same, and nothing in the rows would say so.

A case is a text that another text of its skeleton class shows in the usual characters: its own
consistent form is put into the class, so that a damaged text whose clean twin is stored nowhere is
found too.  An exact test of its characters follows.

Nulls give null and no case; the empty text gives the empty text and no case.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letter they look like.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝѵкмнтвгпАВЕКМНОРСТУХІЈЅԚԜЗ"
        "οναικρτυχηεγωςΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
        "օսոհցքաеԱՍՕլ",
        "aeopcyxijshdqwvkmhtbrnABEKMHOPCTYXIJSQWZ"
        "ovaikptuxneywsABEZHIKMNOPTYX"
        "ounhgpueUUOl",
        strict=True,
    )
)
# Latin letters and signs that share a prototype when only the look counts.
SAME_LOOK = {"ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "´": "'", "`": "'"}

# Code point ranges (first, last).
FULL_WIDTH = ((0xFF01, 0xFF60), (0xFFE0, 0xFFE6), (0xFB00, 0xFB06))
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0))
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0x2028, 0x2029))


def _jvm_class(ranges: tuple) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _python_class(ranges: tuple) -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


_FOREIGN = r"[\p{L}&&[^\p{IsLatin}\p{Lm}\x{b5}]]"
_BETWEEN = rf"[\p{{M}}{_jvm_class(INVISIBLE)}]*"
#: Matches, in the JVM, a text that may need another form; everything else never reaches Python.
SUSPECT = rf"[{_jvm_class(FULL_WIDTH + INVISIBLE + SPACES)}\p{{M}}]|\p{{IsLatin}}{_BETWEEN}{_FOREIGN}|{_FOREIGN}{_BETWEEN}\p{{IsLatin}}"

# A first look for any character that SUSPECT could need: none of the letters and signs of ordinary text.
_UNUSUAL = r"[\x{a0}\x{ad}[\x{250}-\x{10ffff}&&[^\x{2010}-\x{2027}\x{2030}-\x{205e}\x{2190}-\x{2bff}]]]"

_RE_WIDTH, _RE_SPACE, _RE_UNSEEN = _python_class(FULL_WIDTH), _python_class(SPACES), _python_class(INVISIBLE)
_RE_RUN = re.compile(r"[^\W\d_]+")
_MICRO = re.compile("\u03bc(g|l|L|m|mol)")
@dataclass(frozen=True)
class Prototypes:
    """``letters``: the Latin letter of the same case that a letter of another alphabet looks like;
    ``looks``: the prototype of every character that has one."""

    letters: dict[int, str]
    looks: dict[int, str]


#: The fixed values alone.
FIXED = Prototypes({ord(k): v for k, v in LOOKALIKES.items()}, {ord(k): v for k, v in (LOOKALIKES | SAME_LOOK).items()})


@lru_cache(maxsize=1)
def prototypes(spark: SparkSession) -> Prototypes:
    """Prototypes of all characters outside the ideographic scripts, from the confusables data of the
    ICU library in the session's JVM, read in one call on the driver.  Spark SQL needs that library
    itself, so there is no session without it; any failure to read it is raised, and not kept."""
    chars = [chr(i) for i in (*range(0x21, 0x3400), *range(0xA4D0, 0xAC00), *range(0xF900, 0x17000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)) if unicodedata.category(chr(i))[0] in "LNPS"]
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        looks = checker.getSkeleton("\n".join(chars)).split("\n")
    except Exception as cause:
        raise RuntimeError("the confusables data of the ICU library in the session's JVM cannot be read") from cause
    if len(looks) != len(chars):
        raise RuntimeError(f"the confusables data gave {len(looks)} prototypes for {len(chars)} characters")
    look = dict(zip(chars, looks))
    latin: dict[str, list[str]] = {}
    for c in [*string.ascii_letters, *(c for c in chars if c > "z" and c.isalpha() and unicodedata.name(c, "").startswith("LATIN"))]:
        latin.setdefault(look[c], []).append(c)
    letters = {}
    for c in chars:
        near = latin.get(look[c]) if _foreign(c) else None
        if near:
            letters[ord(c)] = next((x for x in near if x.isupper() == c.isupper()), near[0])
    letters |= FIXED.letters
    fixed = {ord(k): v for k, v in SAME_LOOK.items()} | FIXED.letters
    return Prototypes(letters, {ord(c): look.get(x, x) for c in chars if (x := fixed.get(ord(c), look[c])) != c or look.get(x, x) != c})


def _latin(char: str) -> bool:
    return char in "ªº" or unicodedata.name(char, "").startswith(("LATIN", "FULLWIDTH LATIN"))


def _foreign(char: str) -> bool:
    return char.isalpha() and char != "µ" and unicodedata.category(char) != "Lm" and not _latin(char)


def _unmarked(text: str) -> str:
    """``text`` composed, without the combining marks that no letter takes up."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c)[0] != "M")


def skeleton(text: str, known: Prototypes = FIXED) -> str:
    """Prototype form of ``text``: decompose, replace every character by its prototype, decompose
    again; what is unseen goes and every run of spaces is one."""
    text = _RE_WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFKD", _unmarked(_RE_UNSEEN.sub("", text)))
    text = unicodedata.normalize("NFKD", text.translate(known.looks))
    return " ".join(text.split())


def _mixed(run: str) -> bool:
    """Whether a run of letters has Latin and other letters; the unit prefix in "μg" is proper use."""
    return any(map(_foreign, run)) and any(map(_latin, run)) and not _MICRO.fullmatch(run)


def _own_script(run: str, known: Prototypes) -> str:
    """A run of letters; where it mixes Latin with another alphabet, the latter's prototypes."""
    if not _mixed(run):
        return run
    return "".join(known.letters.get(ord(c)) or unicodedata.normalize("NFKC", c) if _foreign(c) else c for c in run)


def consistent_form(text: str, known: Prototypes = FIXED) -> tuple[str, list[str]]:
    """(the text in its consistent form, the kinds of defect it had)."""
    kinds = []
    if _RE_WIDTH.search(text):
        kinds.append("largura")
        text = _RE_WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if any(unicodedata.category(c)[0] == "M" for c in text):
        kinds.append("combinante")
    if _RE_UNSEEN.search(text):
        kinds.append("invisivel")
        text = _RE_UNSEEN.sub("", text)
    if _RE_SPACE.search(text):
        kinds.append("espaco")
        text = _RE_SPACE.sub(" ", text)
    if "combinante" in kinds:
        text = _unmarked(text)
    mixed = _RE_RUN.sub(lambda m: _own_script(m.group(), known), text)
    if any(map(_mixed, _RE_RUN.findall(text))):
        kinds.append("alfabeto")
    return mixed, kinds


def canonical_text(text: str) -> str:
    return consistent_form(text)[0]


_FORM = T.StructType().add("forma", T.StringType()).add("defeitos", T.ArrayType(T.StringType())).add("mesma_classe", T.BooleanType())


def _consistent(spark: SparkSession):
    """Column function text -> struct<forma, defeitos, mesma_classe>; ``mesma_classe`` says that the
    text has the skeleton of its form.  Null gives nulls."""
    shipped = spark.sparkContext.broadcast(prototypes(spark))

    def formed(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for series in values:
            rows = []
            for v in series:
                form, kinds = (None, None) if v is None else consistent_form(v, known)
                rows.append((form, kinds, None if v is None else skeleton(v, known) == skeleton(form, known)))
            yield pd.DataFrame(rows, columns=["forma", "defeitos", "mesma_classe"])

    formed.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(formed, _FORM)


def skeleton_of(spark: SparkSession):
    """Column version of :func:`skeleton`."""
    shipped = spark.sparkContext.broadcast(prototypes(spark))

    def look(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(lambda v: skeleton(v, shipped.value), na_action="ignore")

    look.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(look, T.StringType())


def is_suspect(column: Column) -> Column:
    """Whether a text may hold a defect; null counts as no."""
    return F.coalesce(column.rlike(_UNUSUAL) & column.rlike(SUSPECT), F.lit(False))


def defects(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, campo, valor, forma, defeitos) for each field that needed another form.

    A case shares its skeleton with its consistent form and holds one of the kinds of characters (a
    foreign letter that looks like no Latin one stays in the form, and is a case).  Only suspect texts reach Python; the scan, the test and the unpivot
    stay in the JVM and there is no shuffle.  A row that occurs twice is reported twice.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor")) for f in fields])
    hit = F.filter(pairs, lambda p: is_suspect(p["valor"]))
    rows = df.select(F.col(key), F.explode(hit).alias("_p")).select(key, "_p.campo", "_p.valor")
    rows = rows.withColumn("_c", _consistent(df.sparkSession)("valor"))
    return rows.where(F.col("_c.mesma_classe") & (F.size("_c.defeitos") > 0)).select(key, "campo", "valor", F.col("_c.forma").alias("forma"), F.col("_c.defeitos").alias("defeitos"))


def with_consistent_form(df: DataFrame, field: str, to: str) -> DataFrame:
    """``df`` with ``to`` = the consistent form of ``field``, in one pass; of clean texts only a null
    reaches Python."""
    form = _consistent(df.sparkSession)(F.when(is_suspect(F.col(field)), F.col(field)))
    return df.withColumn(to, F.coalesce(form["forma"], F.col(field)))


def skeleton_groups(df: DataFrame, field: str) -> DataFrame:
    """Originals of equal skeleton: (esqueleto, forma, grafias, linhas).

    Equal values are first counted map-side, so a value that holds a third of all rows is one row
    by the time it is shuffled; no list of originals is built.  ``forma`` is the smallest
    consistent form of the group.
    """
    counted = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("valor")).agg(F.count("*").alias("n"))
    formed = with_consistent_form(counted, "valor", "forma").withColumn("esqueleto", skeleton_of(df.sparkSession)("valor"))
    return formed.groupBy("esqueleto").agg(F.min("forma").alias("forma"), F.count("*").alias("grafias"), F.sum("n").alias("linhas"))
