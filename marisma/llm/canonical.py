"""Mapping freely typed values to a canonical list (problem 1).

Values are deduplicated first, so a value that fills a third of all rows is scored once.  Each
distinct value is normalised, its character n-grams probe an inverted index of the reference
names, and every candidate is scored by weighted cosine.  Candidates above the threshold pass an
exact check by edits; the best of them is accepted if it leads the best one of another entry by a
margin.  What is not accepted is reported with termo_id 0.

Normalisation removes what is typed beside a name: trade marks, doses, dosage forms, salts,
makers in parentheses; it expands clipped head words ("inib." -> "inibidores") from the reference
vocabulary itself.  Null, empty and blank values name no entry; equal names keep the lowest
termo_id, other ties are rejected by the margin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.llm.confusables import canonical_text
from marisma.session import cut_lineage, is_small, join_back

#: Up to so many reference names the index is shipped to the executors; beyond it the inverted index
#: is a table and the probe a join (:func:`match_by_join`) with the same scores and decisions.
MAX_SHIPPED_NAMES = 200_000
#: Up to so many distinct values are broadcast back to their rows.
MAX_BROADCAST_VALUES = 300_000
#: Acceptance: least cosine, least lead over the best other entry.
THRESHOLD, MARGIN = 0.25, 0.03
#: Exact check: share of characters that may differ; names of so few letters (codes) must be equal.
MAX_EDITS, CODE = 0.34, 5
#: A first word of names is a head word if at least this share of the names begins with it; at most
#: 1 / HEAD_SHARE words are, whatever the length of the list.
HEAD_SHARE = 0.001

# What is written beside a medicine's name.
FORMS = "comprimido comprimidos capsula capsulas pomada gotas xarope injetavel solucao oral creme gel suspensao drageas spray generico base"
SALTS = "cloridrato maleato mesilato fosfato sulfato acetato citrato tartarato bromidrato"
SALT_ENDS = "sodica sodico calcica calcico potassica potassico monoidratada monoidratado anidra anidro hidratada hidratado"

LINKS = frozenset(("de", "da", "do"))

_DOSE = re.compile(r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|ui|%)?(?:/\w+)?(?!\w)")
_LEAD_SALT = re.compile(rf"^(?:{'|'.join(SALTS.split())}) d[eo] ")
_BESIDE = frozenset(FORMS.split()) | frozenset(SALT_ENDS.split())
_PAREN = re.compile(r"\(([^()]*)\)")


def fold(text: str) -> str:
    """Lower case without accents, in the consistent form, letters, digits and some signs kept."""
    text = unicodedata.normalize("NFKD", canonical_text(text).lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two strings; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def grams(key: str, n: int = 3) -> Counter:
    """Character n-grams of a key without blanks, with edge marks."""
    padded = f"^{key}$"
    return Counter(padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))


def name_rows(termo_id: int, termo: str | None, other: str | None) -> list[tuple[str, int, str | None]]:
    """(key, termo_id, first word of a name of several words) of the accepted names of an entry."""
    out = []
    for name in (termo, other):
        words = [w for w in re.findall(r"\w+", fold(name)) if w not in LINKS] if name else []
        if words:
            out.append(("".join(words), termo_id, words[0] if len(words) > 1 else None))
    return out


def passes(key: str, name: str) -> bool:
    """The exact check of a candidate: few edits between key and name, none for a code."""
    most = 0 if len(name) <= CODE else max(1, int(MAX_EDITS * min(len(name), len(key))))
    return osa_distance(key, name, most) <= most


class Cleaner:
    """Normalisation of values by the head words of the reference list."""

    def __init__(self, heads: set[str]):
        self.heads = heads

    def clean_words(self, value: str) -> list[str]:
        """Words of a value without what is written beside the name, head words expanded."""
        text = fold(value)

        def inner(match: re.Match) -> str:
            words = re.findall(r"\w+", match.group(1))
            return f" {match.group(1)} " if any(self.head_of(w) for w in words) else " "

        text = _PAREN.sub(inner, text)
        text = _DOSE.sub(" ", text)
        text = _LEAD_SALT.sub("", " ".join(text.split()))
        text = re.sub(r"(?<=\w)-(?=\w)", "", text)
        out = []
        for word, dot in re.findall(r"(\w+)(\.?)", text):
            head = self.head_of(word, clipped=bool(dot)) if len(word) > 1 else None
            out.append(head or word)
        words = [w for w in out if w not in _BESIDE] or out
        words = [w for w in words if w not in LINKS] or words
        # "vicobiase (inibidores)", "vicobiase, inibidores da": the head word belongs in front.
        at = next((i for i, w in enumerate(words) if w in self.heads), 0)
        return words[at:] + words[:at]

    def head_of(self, word: str, clipped: bool = False) -> str | None:
        if word in self.heads:
            return word
        for plural in (word + "s", word + "es"):
            if plural in self.heads:
                return plural
        if clipped:
            full = [h for h in self.heads if h.startswith(word)]
            if len(full) == 1:
                return full[0]
        return None

    def key(self, value: str | None) -> str:
        return "".join(self.clean_words(value)) if value else ""


def frequent_heads(heads: Counter, total: int) -> set[str]:
    return {h for h, n in heads.items() if n >= HEAD_SHARE * total}


class ReferenceIndex(Cleaner):
    """Inverted n-gram index over the accepted names of the reference list."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        names: dict[str, int] = {}
        heads = Counter()
        total = 0
        for key, termo_id, head in (n for r in sorted(rows, key=lambda r: r[0]) for n in name_rows(*r)):
            total += 1
            names.setdefault(key, termo_id)
            if head:
                heads[head] += 1
        super().__init__(frequent_heads(heads, total))
        self.exact, self.keys = names, list(names)
        self.ids = np.array([names[k] for k in self.keys], dtype=np.int64)
        df = Counter(g for k in self.keys for g in set(grams(k)))
        count = max(1, len(self.keys))
        self.weight = {g: math.log(1 + count / n) for g, n in df.items()}
        self.unseen = math.log(1 + count)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, key in enumerate(self.keys):
            own = grams(key)
            norm = math.sqrt(sum((c * self.weight[g]) ** 2 for g, c in own.items()))
            for g, c in own.items():
                postings[g].append((i, c * self.weight[g] / norm))
        self.postings = {g: (np.array([i for i, _ in p], dtype=np.int32), np.array([w for _, w in p])) for g, p in postings.items()}
        self.known: dict[str, tuple[int, float]] = {}

    def match(self, value: str | None) -> tuple[int, float]:
        """(termo_id or 0, score) of one value; values of one key are decided once."""
        key = self.key(value)
        if key not in self.known:
            self.known[key] = self.decide(key)
        return self.known[key]

    def scores(self, key: str) -> np.ndarray:
        """Cosine of the key with every name, by probing the inverted index with its n-grams."""
        own = grams(key)
        weights = {g: c * self.weight.get(g, self.unseen * 0.5) for g, c in own.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        score = np.zeros(len(self.keys))
        for g, w in weights.items():
            hit = self.postings.get(g)
            if hit is not None:
                score[hit[0]] += hit[1] * (w / norm)
        return np.round(score, 9)

    def decide(self, key: str) -> tuple[int, float]:
        """Every candidate that can still win or rival is checked, best cosine first."""
        if not key:
            return 0, 0.0
        if key in self.exact:
            return self.exact[key], 1.0
        score = self.scores(key)
        near = np.flatnonzero(score >= THRESHOLD - MARGIN)
        best = None
        for i in near[np.lexsort((self.ids[near], -score[near]))]:
            cosine, termo_id = float(score[i]), int(self.ids[i])
            if best is None:
                if cosine < THRESHOLD:
                    break
                if passes(key, self.keys[i]):
                    best = termo_id, cosine
            elif best[1] - cosine >= MARGIN - 1e-12:
                break
            elif termo_id != best[0] and passes(key, self.keys[i]):
                return 0, best[1]
        return best or (0, 0.0)


_RESULT = "valor string, termo_id long, score double"


def match_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(valor, termo_id, score) for a frame of distinct ``valor``; termo_id 0 names no entry.

    ``reference`` has termo_id, termo, sinonimos.  Its size is counted first: a list beyond
    ``MAX_SHIPPED_NAMES`` is probed as a table instead of being shipped.
    """
    spark = values.sparkSession
    ref = reference.select("termo_id", "termo", "sinonimos").where(F.col("termo").isNotNull())
    if not is_small(ref, MAX_SHIPPED_NAMES):
        return match_by_join(values, ref)
    shipped = spark.sparkContext.broadcast(ReferenceIndex([tuple(r) for r in ref.collect()]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shipped.value
        for batch in batches:
            found = [index.match(v) for v in batch["valor"]]
            yield pd.DataFrame({"valor": batch["valor"], "termo_id": [f[0] for f in found], "score": [f[1] for f in found]})

    # Values are small and dear to score: their partitions follow the cores, not their bytes.
    cores = max(2, spark.sparkContext.defaultParallelism)
    return values.select("valor").repartition(2 * cores, F.xxhash64("valor")).mapInPandas(score, _RESULT)


def _key_grams(keys: DataFrame) -> DataFrame:
    """(chave, g, c): the n-grams of each key with their counts."""
    padded = F.concat(F.lit("^"), F.col("chave"), F.lit("$"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    return keys.select("chave", F.explode(parts).alias("g")).groupBy("chave", "g").agg(F.count("*").alias("c"))


@F.pandas_udf(T.BooleanType())
def _passes(keys: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([passes(k, n) for k, n in zip(keys, names)], dtype=bool)


def match_by_join(values: DataFrame, ref: DataFrame) -> DataFrame:
    """:func:`match_values` for a reference list of any size: the inverted index is a table.

    n-gram weights come from the whole list.  A key probes the index with its heaviest n-grams only,
    down to those whose rest has too little weight to lift any cosine to ``THRESHOLD - MARGIN``, so
    the commonest n-grams, whose postings are long, are rarely probed and no candidate is lost.
    Threshold, exact check and margin are applied once to all candidates of a key.
    """
    spark = values.sparkSession

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([n for r in batch.itertuples(index=False) for n in name_rows(*r)], columns=["chave", "termo_id", "cabeca"])

    spelled = cut_lineage(ref.mapInPandas(split, "chave string, termo_id long, cabeca string"))
    least = HEAD_SHARE * spelled.count()
    heads = {r[0] for r in spelled.where("cabeca is not null").groupBy("cabeca").count().where(F.col("count") >= least).select("cabeca").collect()}
    names = cut_lineage(spelled.groupBy("chave").agg(F.min("termo_id").alias("termo_id")))
    total = max(1, names.count())

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Cleaner(heads)
        for batch in batches:
            yield pd.DataFrame({"valor": batch["valor"], "chave": [own.key(v) for v in batch["valor"]]})

    cores = max(2, spark.sparkContext.defaultParallelism)
    keyed = cut_lineage(values.select("valor").repartition(2 * cores, F.xxhash64("valor")).mapInPandas(clean, "valor string, chave string"))
    keys = keyed.select("chave").where("chave <> ''").distinct()
    exact = keys.join(names, "chave").select("chave", "termo_id", F.lit(1.0).alias("score"))
    asked = keys.join(names, "chave", "left_anti")

    own = cut_lineage(_key_grams(names))
    weights = own.groupBy("g").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("w"))
    unit = lambda df: df.groupBy("chave").agg(F.collect_list(F.struct(F.col("x").alias("x"), "g")).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    known = unit(own.join(weights, "g").select("chave", "g", (F.col("c") * F.col("w")).alias("x")))
    known = known.join(names, "chave").select(F.col("chave").alias("nome"), "termo_id", "v", "n")
    probes = _key_grams(asked).join(weights, "g", "left").select("chave", "g", (F.col("c") * F.coalesce("w", F.lit(0.5 * math.log(1 + total)))).alias("x"))
    probes = unit(probes).withColumn("v", F.sort_array("v", asc=False))
    # An n-gram is probed if it and the lighter ones together could still reach the least cosine.
    rest = lambda i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda a, e: a + e["x"] * e["x"])
    probes = cut_lineage(probes.withColumn("p", F.filter("v", lambda e, i: F.sqrt(rest(i)) >= (THRESHOLD - MARGIN) * 0.999 * F.col("n"))))
    postings = own.select(F.col("chave").alias("nome"), "g")
    pairs = probes.select("chave", F.explode(F.transform("p", lambda e: e["g"])).alias("g")).join(postings, "g").select("chave", "nome").distinct()
    met = pairs.join(probes.select("chave", F.map_from_arrays(F.transform("v", lambda e: e["g"]), F.transform("v", lambda e: e["x"])).alias("_m"), F.col("n").alias("_n")), "chave").join(known, "nome")
    cosine = F.aggregate("v", F.lit(0.0), lambda a, e: a + e["x"] * F.coalesce(F.try_element_at("_m", e["g"]), F.lit(0.0))) / (F.col("n") * F.col("_n"))
    near = met.select("chave", "nome", "termo_id", F.round(cosine, 9).alias("score")).where(F.col("score") >= THRESHOLD - MARGIN).where(_passes("chave", "nome"))
    best = near.groupBy("chave", "termo_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("chave").orderBy(F.desc("score"), "termo_id")
    two = best.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("chave").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("score", "termo_id"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("b")
    )
    won = F.when((F.col("a.score") >= THRESHOLD) & (F.col("b").isNull() | (F.col("a.score") - F.col("b") >= MARGIN - 1e-12)), F.col("a.termo_id")).otherwise(0)
    decided = two.select("chave", won.alias("termo_id"), F.when(F.col("a.score") >= THRESHOLD, F.col("a.score")).otherwise(0.0).alias("score")).unionByName(exact)
    return keyed.join(decided, "chave", "left").select("valor", F.coalesce("termo_id", F.lit(0)).cast("long").alias("termo_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_fields(fields: DataFrame, reference: DataFrame) -> DataFrame:
    """(campo, interacao_id, valor, termo_id, score) of every value not written exactly as a termo.

    ``fields`` has campo, interacao_id, valor.  Repeated rows give one case; null values give none.
    Distinct values are pre-aggregated map-side before their shuffle; scored values go back to their
    rows by a broadcast or, beyond a counted number, by a join that treats hot values apart.
    """
    exact = reference.select(F.col("termo").alias("valor")).where(F.col("valor").isNotNull()).distinct()
    rows = fields.where(F.col("valor").isNotNull()).join(exact, "valor", "left_anti").select("campo", "interacao_id", "valor").distinct()
    scored = cut_lineage(match_values(rows.select("valor").distinct(), reference))
    return join_back(rows, scored, ["valor"], MAX_BROADCAST_VALUES).select("campo", "interacao_id", "valor", "termo_id", "score")
