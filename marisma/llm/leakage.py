"""Evaluation texts leaking into training text (problem 9).

Words are runs of letters or digits, compared without case and accents.  Seeds are word n-grams of
the items: in every window of ``RUN`` words of an item the n-gram that is rarest in the corpus is
kept, so any shared run of ``RUN`` words holds at least one seed.  Corpus n-grams first meet the
different item n-grams by hash, which also counts them; the seeds are chosen from these counts, and
only they are matched with the items they stand in, so text that many items share costs nothing for
each of them.  Each meeting is aligned locally (Smith-Waterman over words) around the seed, which
scores edited and paraphrased copies too, and an exact check measures the longest run of equal words.

:func:`leaked` asks for runs of equal words, for which long seeds do; :func:`edited_leaks` asks for
an alignment as good as that of such a run and uses short seeds, which edits leave whole.

Null and empty texts and items leak nothing; an item shorter than the seed has no seed; the same
document or item given twice counts once.  Whole texts are searched, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.session import cut_lineage, is_small

#: Words of a seed for runs of equal words and for edited copies, words of a shared run.
SEED, SHORT_SEED, RUN = 8, 5, 15
#: Most item n-grams that may be broadcast.
MAX_BROADCAST_SEEDS = 200_000
#: Up to so many affected documents their keys are broadcast, so that no other text is shuffled.
MAX_BROADCAST_DOCUMENTS = 1_000_000
#: Smith-Waterman scores of equal words, different words and gaps.
MATCH, MISMATCH, GAP = 2, -1, -1

_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def words(text: Column) -> Column:
    """Words of a text, lower case, without accents, composed or not."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\pL\pN]+"), F.lit(0))


#: Multiplier of the rolling hash of an n-gram (odd, so that no word's hash is lost).
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the n-grams of many texts, whose word hashes lie behind each other; ``ends`` is
    where the text of each word ends.  n-grams over two texts are left out."""
    if len(words) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values, size = words.view(np.uint64), len(words) - n + 1
    hashes = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        hashes = hashes * _BASE + values[j : j + size]
    places = np.flatnonzero(np.arange(size) + n <= ends[:size])
    return places, hashes[places].view(np.int64)


def _grams(df: DataFrame, key: str, text: str, n: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, pos, h): the hash of the n words from each position; only those among the sorted ``wanted``.

    Words are found and hashed in the JVM; n-grams are array arithmetic over whole batches, so that no
    row is made for an n-gram that no item has."""
    spark = df.sparkSession
    tokens = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") >= n)
    shipped = None if wanted is None else spark.sparkContext.broadcast(wanted)
    schema = pa.schema([("k", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("w")
            lengths = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            row = np.repeat(np.arange(len(lengths)), lengths)
            places, hashes = gram_hashes(flat, np.repeat(starts + lengths, lengths), n)
            if shipped is not None and len(shipped.value):
                at = np.minimum(np.searchsorted(shipped.value, hashes), len(shipped.value) - 1)
                hit = shipped.value[at] == hashes
                places, hashes = places[hit], hashes[hit]
            elif shipped is not None:
                places, hashes = places[:0], hashes[:0]
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row[places]], pa.int64()), pa.array((places - starts[row[places]]).astype(np.int32)), pa.array(hashes)], schema=schema)

    return tokens.mapInArrow(grams, "k long, pos int, h long").withColumnRenamed("k", key)


def seeds(items: DataFrame, documents: DataFrame, item: str, item_text: str, doc: str, doc_text: str, n: int = SEED) -> DataFrame:
    """(item, doc, pos): the places of documents that hold the rarest n-gram of a window of an item."""
    own = cut_lineage(_grams(items.dropDuplicates([item]), item, item_text, n).withColumnRenamed("pos", "item_pos"))
    few = is_small(own, MAX_BROADCAST_SEEDS)
    asked = own.select("h").distinct()
    # Few item n-grams are shipped as one sorted array; more are joined.
    wanted = np.sort(asked.toPandas()["h"].to_numpy(dtype=np.int64)) if few else None
    theirs = _grams(documents, doc, doc_text, n, wanted)
    met = cut_lineage(theirs if few else theirs.join(asked, "h").select(doc, "pos", "h"))
    # Corpus frequency of each item n-gram; those that never occur are rarest and cannot meet.
    often = met.groupBy("h").agg(F.count("*").alias("vezes"))
    ranked = own.join(F.broadcast(often) if few else often, "h", "left").select(item, "item_pos", "h", F.coalesce("vezes", F.lit(0)).alias("vezes"))
    span = RUN - n
    window = Window.partitionBy(item).orderBy("item_pos").rangeBetween(0, span)
    rarest = ranked.withColumn("_s", F.min(F.struct("vezes", "item_pos", "h")).over(window)).withColumn("_fim", F.max("item_pos").over(Window.partitionBy(item)))
    # Windows that lie whole inside the item; an item shorter than a run keeps its rarest n-gram.
    rarest = rarest.where((F.col("item_pos") + span <= F.col("_fim")) | ((F.col("_fim") < span) & (F.col("item_pos") == 0)))
    kept = rarest.select(item, F.col("_s.h").alias("h")).distinct()
    return met.join(F.broadcast(kept) if few else kept, "h").select(item, doc, "pos")


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score of two sequences of word numbers."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int32)
    steps = np.arange(len(b) + 1, dtype=np.int32) * GAP
    for x in a:
        diagonal = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, np.maximum(diagonal, row[1:] + GAP))
        # Gaps along the row: a running maximum after the linear gap cost is taken out.
        new = np.maximum(new, np.maximum.accumulate(new - steps) + steps)
        best = max(best, int(new.max()))
        row = new
    return best


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of equal words."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        new = np.zeros_like(row)
        new[1:] = np.where(b == x, row[:-1] + 1, 0)
        best = max(best, int(new.max()))
        row = new
    return best


def stretches(places: Column, length: Column, n: int) -> Column:
    """array<struct<ini, fim>>: word ranges that hold every alignment through the seeds at ``places``
    (sorted); seeds closer than an item's length share one."""
    kind = "array<struct<ini:int,fim:int>>"

    def add(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        first, end = F.greatest(p - length, F.lit(0)), p + length + n
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["ini"].alias("ini"), end.alias("fim"))))
        apart = F.concat(acc, F.array(F.struct(first.alias("ini"), end.alias("fim"))))
        return F.when(F.coalesce(first <= last["fim"], F.lit(False)), joined).otherwise(apart).cast(kind)

    return F.aggregate(places, F.array().cast(kind), add)


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "texto", n: int = SEED) -> DataFrame:
    """(item, doc, alinhamento, corrida) of every item and document that share a seed.

    ``alinhamento`` is the best Smith-Waterman score over the item's length, ``corrida`` the
    longest run of shared words.  Only documents that meet a seed are read again, and of a long
    document only the stretches around its seeds are aligned.
    """
    met = seeds(items, documents, item, item_text, doc, doc_text, n)
    hits = cut_lineage(met.groupBy(item, doc).agg(F.array_sort(F.collect_set("pos")).alias("_pos")))
    item_words = items.dropDuplicates([item]).where(F.col(item_text).isNotNull()).select(item, words(F.col(item_text)).alias("_iw"))
    hits = hits.join(item_words, item)
    affected = hits.select(doc).distinct()
    texts = documents.where(F.col(doc_text).isNotNull())
    if is_small(affected, MAX_BROADCAST_DOCUMENTS):
        texts = texts.join(F.broadcast(affected), doc, "left_semi")
    texts = texts.select(doc, words(F.col(doc_text)).alias("_dw"))
    # Only the stretches go to Python: a long document is never a row there.
    pairs = texts.join(hits, doc).select(item, doc, "_iw", "_dw", F.explode(stretches(F.col("_pos"), F.size("_iw"), n)).alias("_s"))
    pairs = pairs.select(item, doc, "_iw", F.slice("_dw", F.col("_s.ini") + 1, F.col("_s.fim") - F.col("_s.ini")).alias("_trecho"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, part in zip(batch["_iw"], batch["_trecho"]):
                number = {w: n for n, w in enumerate(dict.fromkeys(own))}
                a, b = np.array([number[w] for w in own]), np.array([number.get(w, -1) for w in part])
                out.append((smith_waterman(a, b), longest_run(a, b)))
            yield pd.DataFrame({item: batch[item], doc: batch[doc], "alinhamento": [o[0] for o in out], "corrida": [o[1] for o in out]})

    scored = pairs.mapInPandas(align, f"{item} long, {doc} long, alinhamento int, corrida int")
    return scored.groupBy(item, doc).agg(F.max("alinhamento").alias("alinhamento"), F.max("corrida").alias("corrida"))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) that share at least ``RUN`` consecutive words."""
    return leaks(documents, items).where(F.col("corrida") >= RUN).select("item_id", "doc_id")


def edited_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, alinhamento, corrida) of every document with a passage, copied or edited, that
    aligns with an item as well as a run of ``RUN`` equal words does."""
    return leaks(documents, items, n=SHORT_SEED).where(F.col("alinhamento") >= MATCH * RUN)
