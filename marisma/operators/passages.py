"""Passages of a text, its structured blocks, and literal evidence cut from them.

A structured block is a list of medicines with the effect they share: from a "Medicamentos:" label
to the next one, if an "Efeito da interação:" label stands between, and not beyond the next numbered
topic in capitals.  A passage never ends inside a block.  Texts without such labels are split by the
JVM; the others, which need character positions, go through Arrow-batched functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions.text import not_blank
from marisma.functions.vocabulary import BLOCK_LABEL, BLOCK_TOPIC, LIST_MARKS, PASSAGE_END

MAX_EVIDENCE, MAX_SUMMARY = 1200, 300
#: Characters kept after the target of a longer passage, and around a late target.
AFTER, WINDOW = 200, 400
#: Where structured blocks are possible at all.
_EFFECT = r"(?i)efeitos?\s+(?:da\s+)?intera[çc][aã]o\s*:"


def blocks_of(text: str) -> list[tuple[int, int]]:
    """(first, behind the last) character of each structured block, without outer blanks."""
    labels = [(m.start(), m.end(), m["tipo"].lower().startswith("medicamento")) for m in re.finditer(BLOCK_LABEL, text)]
    starts = [at for at, _, medicine in labels if medicine]
    out = []
    for start, stop in zip(starts, [*starts[1:], len(text)]):
        effect = next((end for at, end, medicine in labels if start < at < stop and not medicine), None)
        if effect is None:
            continue
        topic = re.compile(BLOCK_TOPIC).search(text, effect, stop)
        part = text[start : topic.start() if topic else stop]
        out.append((start + len(part) - len(part.lstrip()), start + len(part.rstrip())))
    return out


def passages_of(text: str) -> list[str]:
    """Passages in order, blank ones as empty strings, so that numbers count all of them."""
    blocks, at, out = blocks_of(text), 0, []
    for end in re.finditer(PASSAGE_END, text):
        if not any(a < end.start() < b for a, b in blocks):
            out.append(text[at : end.start()])
            at = end.end()
    return [p.strip() for p in [*out, text[at:]]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _passages(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else passages_of(t) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def structured_blocks(texts: pd.Series) -> pd.Series:
    """Column version of :func:`blocks_of`: the texts of the blocks."""
    return pd.Series([None if t is None else [t[a:b] for a, b in blocks_of(t)] for t in texts], dtype=object)


def passages(source: DataFrame, key: str, text: str) -> DataFrame:
    """(key, trecho, texto): sentences and list items in order, trimmed, none empty."""
    rows = source.where(not_blank(F.col(text)))
    labelled = _passages(F.when(F.col(text).rlike(_EFFECT), F.col(text)))
    rows = rows.select(key, F.posexplode(F.coalesce(labelled, F.split(text, PASSAGE_END))).alias("trecho", "_t"))
    rows = rows.withColumn("texto", F.regexp_replace("_t", r"(?U)^\s+|\s+$", ""))
    return rows.where("texto <> ''").select(key, "trecho", "texto")


def block_effect(evidence: Column) -> Column:
    """What stands behind the first effect label; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(evidence, F.lit("")), rf"(?is)(?:^|\n|[.;]\s)[ \t]*{_EFFECT[4:]}(.*)$", 1))


def completed(text: str, evidence: str) -> str:
    """A cut of a block widened to the block, if all its occurrences lie in one block's text."""
    spans, found = blocks_of(text) if text and evidence else [], set()
    for m in re.finditer(re.escape(evidence), text) if spans else ():
        inside = next(((a, b) for a, b in spans if a <= m.start() and m.end() <= b), None)
        # The cut may begin with the section title that stands before the block.
        headed = next(((m.start(), b) for a, b in spans if m.start() <= a < m.end() <= b and re.fullmatch(r"[\s\d.\-•A-ZÁÉÍÓÚÂÊÔÃÕÇ]+", text[m.start() : a])), None)
        a, b = inside or headed or (None, None)
        found.add(None if a is None else text[a:b])
    return next(iter(found)) if len(found) == 1 and None not in found else evidence


@F.pandas_udf(T.StringType())
def complete_evidence(texts: pd.Series, evidence: pd.Series) -> pd.Series:
    """Column version of :func:`completed`; null evidence stays null."""
    return pd.Series([None if e is None else completed(t or "", e) for t, e in zip(texts, evidence)], dtype=object)


def cut_evidence(text: str, first: int, behind: int) -> str:
    """A literal part of a passage with the target at ``first``: its structured block, or the passage
    up to ``MAX_EVIDENCE`` characters; of a longer one from its start to a little behind the target, or
    a window around a target far from the start."""
    block = next(((a, b) for a, b in blocks_of(text) if a <= first < b), None)
    if block:
        return text[slice(*block)]
    if len(text) <= MAX_EVIDENCE:
        return text
    if behind <= MAX_EVIDENCE - AFTER:
        start, end = 0, min(len(text), behind + AFTER)
    else:
        start = max(0, first - WINDOW // 3)
        end = min(len(text), max(behind, start + WINDOW))
        line, blank = text.rfind("\n", start, first), text.find(" ", start, first)
        if line >= 0:
            start = line + 1
        elif blank >= 0:
            start = blank + 1
    if end < len(text):
        blank = text.rfind(" ", behind, end)
        end = blank if blank >= 0 else end
    return text[start:end].strip()


def needs_cut(text: Column) -> Column:
    """Whether the evidence of a passage can be other than the whole of it."""
    return (F.length(text) > MAX_EVIDENCE) | text.rlike(_EFFECT)


def compact(text: Column) -> Column:
    """Single blanks, no list marks and blanks at the borders."""
    marks = f"[{re.escape(LIST_MARKS)} ]+"
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), f"^{marks}|{marks}$", "")


def literal_summary(evidence: Column, target: Column) -> Column:
    """What stands behind "Name:" where the item is built so and says enough, else the evidence; at
    most ``MAX_SUMMARY`` characters, cut at a blank with a mark of omission."""
    colon, at = F.instr(evidence, ":"), F.instr(evidence, target)
    behind = F.substring(evidence, colon + 1, F.length(evidence))
    built = (colon > 0) & (colon <= 161) & (at > 0) & (at < colon) & (F.length(F.regexp_replace(behind, r"(?U)\W", "")) >= 10)
    text = F.coalesce(F.nullif(compact(F.when(built, behind).otherwise(evidence)), F.lit("")), compact(evidence))
    head = F.substring(text, 1, MAX_SUMMARY - 1)
    short = F.when(head.contains(" "), F.regexp_replace(head, r"(?s)\s[^\s]*$", "")).otherwise(head)
    return F.when(F.length(text) > MAX_SUMMARY, F.concat(F.regexp_replace(short, "[ ,;:]+$", ""), F.lit("…"))).otherwise(text)
