"""Subject areas of each document (problem 10).

For each area an interpolated bigram model is trained on labelled documents, and as its background
one on all text of the other areas.  The gain of a paragraph for an area is the difference of its
per-token cross-entropies under the background and the area's model.  A document has an area if it
is the best one of a paragraph, or of a run of two or more sentences inside a paragraph, by a gain
above thresholds calibrated on labelled documents that were held out of the training.  Documents
have one to three areas: the best one is always accepted.

Sentences of documents with several labels are assigned to one of them by the models themselves,
over a few rounds.  The classifier is fitted on at most ``MAX_LABELLED`` labelled documents, chosen
by a hash of their key; every document is scored whole.  Null and empty texts have no area; a
document given twice is scored once; labels of unknown documents or areas are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.session import spread

#: Most labelled documents used to fit and calibrate.
MAX_LABELLED = 6000
#: Words in fewer training documents are one class; prior weights of the two interpolations.
LEAST_DOCUMENTS, UNIGRAM_PRIOR, BIGRAM_PRIOR = 3, 200.0, 20.0
ROUNDS, MAX_AREAS = 3, 3
#: Tokens without gain that are added to every paragraph and sentence: a mean of few tokens is unsure.
SHRINK = 5
#: Thresholds tried by the calibration, in nats a token.
THRESHOLDS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_PARAGRAPH = re.compile(r"\s*\n\s*")
_UNKNOWN = 0
# Function words that tell the corpus languages apart.
_FUNCTION = {
    "pt": frozenset("não uma com os em são da do ao na no dos das".split()),
    "es": frozenset("el los las una con del cuando y se en".split()),
    "en": frozenset("the of and with if is are to for".split()),
}


def language_of(paragraphs: list[list[list[str]]]) -> str:
    """The language with most function words; only used to balance the training counts."""
    words = Counter(w for p in paragraphs for s in p for w in s)
    return max(_FUNCTION, key=lambda name: sum(words[w] for w in _FUNCTION[name]))


def sentences_of(text: str) -> list[list[list[str]]]:
    """Paragraphs of sentences of words, lower case, accents kept."""
    text = unicodedata.normalize("NFC", text).lower()
    paragraphs = ([_WORD.findall(s) for s in _SENTENCE.split(p)] for p in _PARAGRAPH.split(text))
    return [[s for s in p if s] for p in paragraphs]


class Sentences:
    """Coded sentences of many documents as flat arrays, so that counting is a few array passes."""

    def __init__(self, documents: list[tuple[list[list[list[str]]], list[int]]], number: dict[str, int]):
        self.labels = [labels for _, labels in documents]
        words, lengths, doc, part = [], [], [], []
        parts = 0
        for d, (paragraphs, _) in enumerate(documents):
            for p in paragraphs:
                for s in p:
                    words.extend(number.get(w, _UNKNOWN) for w in s)
                    lengths.append(len(s))
                doc.extend([d] * len(p))
                part.extend([parts] * len(p))
                parts += 1
        self.words, self.lengths = np.array(words, dtype=np.int64), np.array(lengths, dtype=np.int64)
        self.doc, self.part = np.array(doc, dtype=np.int64), np.array(part, dtype=np.int64)
        self.width = len(number) + 1
        keys = self.words[:-1] * self.width + self.words[1:]
        inside = np.ones(len(keys), dtype=bool)
        inside[np.cumsum(self.lengths)[:-1] - 1] = False
        self.at = np.flatnonzero(inside)
        self.keys, self.pair = np.unique(keys[self.at], return_inverse=True)


class SubjectModels:
    """Area models, the background model of each area, and the calibrated thresholds."""

    def __init__(self, areas: list[str], number: dict[str, int]):
        self.areas, self.number, self.width = areas, number, len(number) + 1
        self.paragraph_least, self.run_least = 0.0, 0.0

    def fit(self, data: Sentences, used: np.ndarray, weights: np.ndarray) -> SubjectModels:
        """Fit on the documents marked in ``used``; sentences of documents with several labels go to
        one of them by the models themselves, over a few rounds."""
        allowed = np.zeros((len(data.labels), len(self.areas)), dtype=bool)
        for d, labels in enumerate(data.labels):
            allowed[d, labels] = True
        single = allowed.sum(1) == 1
        first = allowed.argmax(1)
        chosen = np.where(single[data.doc] & used[data.doc], first[data.doc], -1)
        several = np.flatnonzero(~single[data.doc] & used[data.doc])
        for _ in range(ROUNDS if len(several) else 0):
            self._count(data, chosen, weights)
            scores = self._sums(data.words, data.lengths)[several]
            # Sentences of a paragraph lean on the paragraph as a whole.
            _, inverse = np.unique(data.part[several], return_inverse=True)
            mean = np.zeros((inverse.max() + 1, scores.shape[1]))
            np.add.at(mean, inverse, scores)
            mean /= np.bincount(inverse)[:, None]
            lean = np.where(allowed[data.doc[several]], scores + 0.5 * mean[inverse], -np.inf)
            chosen = chosen.copy()
            chosen[several] = lean.argmax(1)
        self._count(data, chosen, weights)
        return self

    def _count(self, data: Sentences, chosen: np.ndarray, weights: np.ndarray) -> None:
        n, v = len(self.areas), self.width
        label = np.repeat(chosen, data.lengths)
        doc = np.repeat(data.doc, data.lengths)
        weight = np.where(label >= 0, weights[doc, label], 0.0)
        uni = np.bincount(np.maximum(label, 0) * v + data.words, weights=weight, minlength=n * v).reshape(n, v)
        pairs = len(data.keys)
        bi = np.bincount(np.maximum(label[data.at], 0) * pairs + data.pair, weights=weight[data.at], minlength=n * pairs).reshape(n, pairs)
        ground = (uni.sum(0) + 0.5) / (uni.sum() + 0.5 * v)
        # The background of an area is the corpus without it: its own text would hide its words.
        models = []
        for counts, both in ((uni, bi), (uni.sum(0) - uni, bi.sum(0) - bi)):
            p_uni = (counts + UNIGRAM_PRIOR * ground) / (counts.sum(1, keepdims=True) + UNIGRAM_PRIOR)
            before, after = data.keys // v, data.keys % v
            models.append((np.log(p_uni), np.log((both + BIGRAM_PRIOR * p_uni[:, after]) / (counts[:, before] + BIGRAM_PRIOR))))
        (own, own_bi), (other, other_bi) = models
        self.uni = (own - other).T.astype(np.float32)
        self.uni[_UNKNOWN] = 0
        # Only word pairs seen with known words and more than once are better than the single word.
        use = (bi.sum(0) > 1) & (before != _UNKNOWN) & (after != _UNKNOWN)
        self.pairs, self.bi = data.keys[use], (own_bi - other_bi).T[use].astype(np.float32)

    def _sums(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(sentences, areas): background minus area cross-entropy, summed over each sentence."""
        each = self.uni[words]
        ends = np.cumsum(lengths)
        if len(self.pairs) and len(words) > 1:
            keys = words[:-1] * self.width + words[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = self.pairs[at] == keys
            hit[ends[:-1] - 1] = False
            each[1:][hit] = self.bi[at[hit]]
        return np.add.reduceat(each, ends - lengths, axis=0)

    def evidence(self, paragraphs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(best paragraph gain, best run lead) of each area over the document, both per token."""
        n = len(self.areas)
        whole, run = np.full(n, -1e9), np.full(n, -1e9)
        kept = [p for p in paragraphs if p]
        if not kept:
            return whole, run
        words = np.array([self.number.get(w, _UNKNOWN) for p in kept for s in p for w in s], dtype=np.int64)
        lengths = np.array([len(s) for p in kept for s in p], dtype=np.int64)
        sums = self._sums(words, lengths)
        each = sums / (lengths[:, None] + SHRINK)
        at = 0
        for p in kept:
            rows = slice(at, at + len(p))
            total = sums[rows].sum(0) / (lengths[rows].sum() + SHRINK)
            main = int(total.argmax())
            whole[main] = max(whole[main], total[main])
            best = sums[rows].argmax(1)
            i = 0
            while i < len(best):
                end = i + 1
                while end < len(best) and best[end] == best[i]:
                    end += 1
                area = int(best[i])
                if end - i >= 2 and area != main:
                    part = each[at + i : at + end]
                    # Every sentence of the run has to speak for the area.
                    run[area] = max(run[area], float((part[:, area] - part[:, main]).min()))
                i = end
            at += len(p)
        return whole, run

    def decide(self, whole: np.ndarray, run: np.ndarray, t_whole: float, t_run: float) -> list[int]:
        strength = np.maximum(whole - t_whole, run - t_run)
        order = np.argsort(-strength, kind="stable")
        return [int(a) for i, a in enumerate(order[:MAX_AREAS]) if i == 0 or strength[a] >= 0]

    def calibrate(self, documents: list[tuple[list[list[list[str]]], list[int]]]) -> float:
        """Thresholds of best F1 on labelled documents; the F1."""
        seen = [(*self.evidence(paragraphs), set(labels)) for paragraphs, labels in documents]
        best = -1.0
        for t_whole, t_run in product(THRESHOLDS, THRESHOLDS):
            hit = said = true = 0
            for whole, run, labels in seen:
                found = set(self.decide(whole, run, t_whole, t_run))
                hit, said, true = hit + len(found & labels), said + len(found), true + len(labels)
            f1 = 2 * hit / max(1, said + true)
            if f1 > best + 1e-9:
                best, self.paragraph_least, self.run_least = f1, t_whole, t_run
        return best

    def areas_of(self, text: str) -> list[tuple[str, float]]:
        paragraphs = sentences_of(text)
        if not any(paragraphs):
            return []
        whole, run = self.evidence(paragraphs)
        return [(self.areas[a], float(max(whole[a] - self.paragraph_least, run[a] - self.run_least))) for a in self.decide(whole, run, self.paragraph_least, self.run_least)]


def language_weights(documents: list[tuple[list[list[list[str]]], list[int]]], areas: int) -> np.ndarray:
    """(documents, areas): weight of each document in each area's counts.  Every area gets the corpus
    mix of languages, else the words of a language would speak for the areas it is commoner in."""
    names = list(_FUNCTION)
    spoken = np.array([names.index(language_of(p)) for p, _ in documents])
    mass = np.full((areas, len(names)), 1e-9)
    for (_, labels), lang in zip(documents, spoken):
        mass[labels, lang] += 1 / max(1, len(labels))
    factor = np.clip((mass.sum(0) / mass.sum()) / (mass / mass.sum(1, keepdims=True)), 0.1, 10)
    return factor[:, spoken].T


def train(documents: list[tuple[str, list[str]]], areas: list[str], held_out: int = 5) -> tuple[SubjectModels, float]:
    """(models, F1 on held-out documents): every ``held_out``-th document calibrates, then all train."""
    order = {a: i for i, a in enumerate(areas)}
    known = [(sentences_of(text), [order[a] for a in labels]) for text, labels in documents if text and labels]
    df = Counter(w for paragraphs, _ in known for w in {w for p in paragraphs for s in p for w in s})
    number = {w: i + 1 for i, w in enumerate(sorted(w for w, n in df.items() if n >= LEAST_DOCUMENTS))}
    data, weights = Sentences(known, number), language_weights(known, len(areas))
    kept = np.arange(len(known)) % held_out != 0
    models = SubjectModels(areas, number).fit(data, kept if kept.any() else ~kept, weights)
    f1 = models.calibrate(known[::held_out])
    return models.fit(data, np.ones(len(known), dtype=bool), weights), f1


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> SubjectModels | None:
    """Models fitted on the labelled documents, at most ``MAX_LABELLED`` of them."""
    names = sorted(r[0] for r in areas.select("area").where(F.col("area").isNotNull()).distinct().collect())
    known = labels.join(F.broadcast(areas.select("area").distinct()), "area").groupBy("doc_id").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "areas").collect()
    return train([(r["text"], r["areas"]) for r in rows], names)[0] if rows else None


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, area, forca) of every document: one narrow pass, no shuffle of texts."""
    spark = documents.sparkSession
    models = fit_subjects(documents, labels, areas)
    if models is None:
        return spark.createDataFrame([], "doc_id long, area string, forca double")
    shipped = spark.sparkContext.broadcast(models)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for batch in batches:
            rows = [(d, a, s) for d, text in zip(batch["doc_id"], batch["text"]) for a, s in own.areas_of(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "area", "forca"])

    scored = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInPandas(classify, "doc_id long, area string, forca double")
    return scored.groupBy("doc_id", "area").agg(F.max("forca").alias("forca"))


def composition(found: DataFrame) -> DataFrame:
    """(area, documentos): the corpus by area."""
    return found.groupBy("area").agg(F.count_distinct("doc_id").alias("documentos"))
