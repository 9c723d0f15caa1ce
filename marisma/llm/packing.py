"""Filling fixed-capacity containers with items (problem 8).

Texts are measured in tokens of a public tokenizer; a text is split only if it alone exceeds a
container.  Everything that has to be decided is decided on the global histogram of sizes, which
has at most ``capacity`` rows whatever the number of texts:

* ``length_buckets``: dynamic programming chooses the bucket boundaries that need the fewest
  containers when a container takes as many items of one bucket as fit at the bucket's width.
* ``fill_plan``: since a bucket above half the capacity can hold one item a container, buckets
  alone leave much space unused; best-fit decreasing over the same histogram combines sizes of
  different buckets, many equal containers at a time.

Items are then numbered within their size, in salted groups, and look their container up.
Null texts are no item; an empty text is an item of no tokens and is left out of the containers;
a document given twice under one key is one item.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.session import cut_lineage

CAPACITY, BUCKETS = 2048, 32
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabulary (a fixed value of that public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Items of one size are numbered in groups of about so many.
NUMBERED = 200_000


def token_counts(documents: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every different key with a text."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in batch], dtype="int32")

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("_t"))
    return rows.select("id", count("_t").alias("tokens")).groupBy("id").agg(F.max("tokens").alias("tokens"))


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, parte, inicio, tokens): whole items, and the parts of those that exceed the capacity."""
    parts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))
    rows = sizes.where("tokens > 0").select("id", F.col("tokens").alias("_n"), F.explode(parts).alias("parte"))
    start = F.col("parte") * capacity
    return rows.select("id", "parte", start.alias("inicio"), F.least(F.col("_n") - start, F.lit(capacity)).cast("int").alias("tokens"))


def histogram(items: DataFrame) -> dict[int, int]:
    """Number of items of each size; at most ``capacity`` rows reach the driver."""
    return {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}


def length_buckets(counts: dict[int, int], buckets: int = BUCKETS, capacity: int = CAPACITY) -> list[int]:
    """Upper bounds of the buckets that need the fewest containers, by dynamic programming."""
    if not counts:
        return []
    sizes = np.array(sorted(counts))
    before = np.concatenate([[0], np.cumsum([counts[s] for s in sizes])]).astype(np.float64)
    room = capacity // sizes
    n = len(sizes)
    # cost[i, j]: containers of the bucket that holds sizes i..j.
    cost = np.ceil((before[None, 1:] - before[:-1, None]) / room[None, :])
    cost[np.tril_indices(n, -1)] = np.inf
    best, back = cost[0].copy(), [np.zeros(n, dtype=int)]
    for _ in range(1, min(buckets, n)):
        through = best[:-1, None] + cost[1:, :]
        first = through.argmin(0) + 1
        value = np.concatenate([[np.inf], through.min(0)[1:]])
        first = np.where(value < best, first, -1)
        back.append(first)
        best = np.minimum(best, value)
    bounds, j, k = [], n - 1, len(back) - 1
    while j >= 0:
        while k > 0 and back[k][j] < 0:
            k -= 1
        bounds.append(int(sizes[j]))
        j = (back[k][j] if k else 0) - 1
        k = max(0, k - 1)
    return bounds[::-1]


def bucket_report(counts: dict[int, int], bounds: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, float]]:
    """(limite, itens, tokens, recipientes, sem_uso) of each bucket."""
    rows, low = [], 0
    for bound in bounds:
        own = {s: c for s, c in counts.items() if low < s <= bound}
        items, tokens = sum(own.values()), sum(s * c for s, c in own.items())
        used = -(-items // (capacity // bound))
        rows.append((bound, items, tokens, used, 1 - tokens / (used * capacity)))
        low = bound
    return rows


def fill_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """(number of containers, {size: [(first item number, first container)]}).

    Best-fit decreasing on counts: all items of a size that find equally full containers are placed
    together.  Containers of a group are consecutive, and so are the items placed in them.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> [(first container, number)]
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    containers = 0
    for size in sorted(counts, reverse=True):
        left, number = counts[size], 0
        while left:
            space = next((x for x in range(size, capacity + 1) if free.get(x)), None)
            if space is None:
                break
            first, many = free[space].pop()
            take = min(many, left)
            ranges[size].append((number, first))
            number, left = number + take, left - take
            if many > take:
                free[space].append((first + take, many - take))
            if space > size:
                free[space - size].append((first, take))
        # New containers: as many of this size in each as fit, and one with the rest.
        fit = capacity // size
        for many, layers in ((left // fit, fit), (1, left % fit)):
            if many and layers:
                for _ in range(layers):
                    ranges[size].append((number, containers))
                    number += many
                if capacity > layers * size:
                    free[capacity - layers * size].append((containers, many))
                containers += many
    return containers, dict(ranges)


def containers(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(recipiente, id, parte, inicio, tokens) of every item."""
    items = cut_lineage(items)
    counts = histogram(items)
    _, ranges = fill_plan(counts, capacity)
    spark = items.sparkSession
    plan = spark.createDataFrame(
        [(size, [r[0] for r in own], [r[1] for r in own]) for size, own in ranges.items()], "tokens int, _de array<long>, _para array<long>"
    )
    salts = max(1, -(-sum(counts.values()) // NUMBERED))
    salted = items.withColumn("_s", F.pmod(F.xxhash64("id", "parte"), F.lit(salts)))
    groups = salted.groupBy("tokens", "_s").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("tokens").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("_o", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = Window.partitionBy("tokens", "_s").orderBy("id", "parte")
    numbered = salted.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["tokens", "_s"]).withColumn("_i", F.col("_i") + F.col("_o"))
    # The plan has one row per size, at most ``capacity``.
    placed = numbered.join(F.broadcast(plan), "tokens").withColumn("_r", F.expr("size(filter(_de, x -> x <= _i))"))
    container = F.expr("element_at(_para, _r) + _i - element_at(_de, _r)")
    return placed.select(container.alias("recipiente"), "id", "parte", "inicio", "tokens")
