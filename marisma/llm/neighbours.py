"""Most similar vectors for every vector (problem 6): balanced posting lists.

An index of centroids is fitted on a bounded sample (``SAMPLE_PER_LIST`` vectors for each list, at
most ``MAX_SAMPLE``) by balanced splitting and a few k-means rounds.  Every usable vector is then
searched in a graph of the centroids held in memory, and replicated to the lists whose centroid is
almost as near as the nearest one (distance-ratio pruning).  As every row is a query, the lists a
vector is written to are also the lists it searches.  A list longer than ``BLOCK`` is cut into
blocks and every pair of blocks is compared in a task of its own, so a dense region of any size
costs more tasks and never a larger one.

Equal vectors are collapsed before the index: a group of copies is one entry however many rows it
holds, and its members get their equals as neighbours first.  Null vectors, vectors of another
length, with NaN, infinite or null elements, or all zero take no part.  Ties keep smaller ids.
Rows given twice under one id are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.session import cut_lineage, join_back

LIST_SIZE = 1024
SAMPLE_PER_LIST, MAX_SAMPLE, MAX_LISTS = 48, 32_768, 4096
#: At most so many lists for a vector, and only those with distance <= RATIO x the least distance.
REPLICAS, RATIO = 4, 1.12
BLOCK = 2048
#: Up to so many rows of classes of equal vectors are broadcast to find their members.
MAX_BROADCAST_CLASSES = 200_000


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimension) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    """Unit centroids: the sample is halved along its two-means direction until each part is one
    list, which balances the lists whatever the density, then refined."""
    rng = np.random.default_rng(0)
    parts: list[np.ndarray] = []
    todo = [(np.arange(len(sample)), lists)]
    while todo:
        idx, k = todo.pop()
        if k <= 1 or len(idx) < 2:
            parts.append(idx)
            continue
        own = sample[idx]
        a, b = own[rng.choice(len(idx), 2, replace=False)]
        for _ in range(3):
            side = own @ (a - b) > 0.5 * (a @ a - b @ b)
            if side.all() or not side.any():
                break
            a, b = own[side].mean(0), own[~side].mean(0)
        order = np.argsort(own @ (a - b), kind="stable")
        left = k // 2
        at = min(max(1, len(idx) * left // k), len(idx) - 1)
        todo += [(idx[order[:at]], left), (idx[order[at:]], k - left)]
    centroids = _unit(np.stack([sample[p].mean(0) for p in parts if len(p)]))
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 2048] @ centroids.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        filled = np.bincount(near, minlength=len(centroids)) > 0
        centroids[filled] = _unit(sums[filled])
    return centroids


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm == 0, 1, norm)).astype(np.float32)


class CentroidGraph:
    """Nearest-centroid search by walking a graph of the centroids from entry points."""

    def __init__(self, centroids: np.ndarray, degree: int = 32):
        self.centroids = centroids
        n = len(centroids)
        degree = min(degree, max(0, n - 1))
        links = []
        for i in range(0, n, 1024):
            sims = centroids[i : i + 1024] @ centroids.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
            links.append(np.argpartition(-sims, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(sims), 0), int))
        self.links = np.concatenate(links)
        self.entries = np.arange(0, n, max(1, int(np.sqrt(n) / 2)))

    def search(self, queries: np.ndarray, k: int, beam: int = 24, hops: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, cosines) of the k nearest centroids, nearest first."""
        k = min(k, len(self.centroids))
        near = np.full((len(queries), k), -1, dtype=np.int64)
        cosine = np.full((len(queries), k), -2.0, dtype=np.float32)
        entry = queries @ self.centroids[self.entries].T
        start = entry.argmax(1)
        for e in np.unique(start):
            rows = np.flatnonzero(start == e)
            own = queries[rows]
            best = np.argpartition(-entry[rows], min(beam, entry.shape[1]) - 1, axis=1)[:, :beam]
            seen = np.unique(self.entries[best])
            frontier = seen
            for _ in range(hops):
                reached = np.setdiff1d(np.unique(self.links[frontier]), seen)
                if not len(reached):
                    break
                seen = np.concatenate([seen, reached])
                sims = own @ self.centroids[seen].T
                top = np.argpartition(-sims, min(beam, len(seen)) - 1, axis=1)[:, :beam]
                frontier = np.unique(seen[top])
            sims = own @ self.centroids[seen].T
            m = min(k, len(seen))
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            got = np.take_along_axis(sims, top, 1)
            order = np.argsort(-got, axis=1, kind="stable")
            near[rows, :m] = seen[np.take_along_axis(top, order, 1)]
            cosine[rows, :m] = np.take_along_axis(got, order, 1)
        return near, cosine

    def lists_of(self, queries: np.ndarray, most: int, ratio: float) -> np.ndarray:
        """List numbers of each vector, -1 where the distance ratio prunes."""
        near, cosine = self.search(queries, most)
        distance = np.sqrt(np.maximum(0, 2 - 2 * cosine))
        near[distance > ratio * np.maximum(distance[:, :1], 1e-6)] = -1
        return near


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def _postings(reps: DataFrame, graph: CentroidGraph) -> DataFrame:
    """(lista, id, v): every vector once for each of its lists, unit length, packed."""
    shipped = reps.sparkSession.sparkContext.broadcast(graph)
    schema = pa.schema([("lista", pa.int32()), ("id", pa.int64()), ("v", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = _unit(_matrix(part.column("v")))
                lists = index.lists_of(rows, REPLICAS, RATIO)
                who, which = np.nonzero(lists >= 0)
                packed = [rows[i].tobytes() for i in range(len(rows))]
                ids = part.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(lists[who, which], pa.int32()), pa.array(ids[who], pa.int64()), pa.array([packed[i] for i in who], pa.binary())], schema=schema)

    return reps.select("id", "v").mapInArrow(assign, "lista int, id long, v binary")


def _best_in_cell(k: int):
    def best(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").drop_duplicates("id")
        ids = rows["id"].to_numpy()
        vectors = np.frombuffer(b"".join(rows["v"]), dtype=np.float32).reshape(len(rows), -1)
        out = []
        take = min(k + 3, len(ids) - 1)
        if take > 0:
            for at in range(0, len(ids), 1024):
                sims = vectors[at : at + 1024] @ vectors.T
                sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -3
                top = np.sort(np.argpartition(-sims, take - 1, axis=1)[:, :take], axis=1)
                got = np.take_along_axis(sims, top, 1)
                order = np.argsort(-got, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"id": np.repeat(ids[at : at + 1024], order.shape[1]), "vizinho": ids[np.take_along_axis(top, order, 1)].ravel(), "cosseno": np.take_along_axis(got, order, 1).ravel().astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"id": pd.Series([], dtype="int64"), "vizinho": pd.Series([], dtype="int64"), "cosseno": pd.Series([], dtype="float64")})

    return best


def _top(candidates: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each id."""
    once = candidates.groupBy("id", "vizinho").agg(F.max("cosseno").alias("cosseno"))
    w = Window.partitionBy("id").orderBy(F.desc("cosseno"), "vizinho")
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _class_neighbours(reps: DataFrame, k: int, list_size: int) -> DataFrame:
    """(id, vizinho, cosseno): the k nearest others of each vector of a frame of different vectors."""
    spark = reps.sparkSession
    total = reps.count()
    lists = int(min(MAX_LISTS, max(1, -(-total // list_size))))
    wanted = min(total, SAMPLE_PER_LIST * lists, MAX_SAMPLE)
    share = min(1.0, 1.05 * wanted / max(1, total))
    picked = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(MAX_SAMPLE).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "id long, vizinho long, cosseno double")
    sample = _unit(_matrix(picked.column("v").combine_chunks()))
    posted = cut_lineage(_postings(reps, CentroidGraph(fit_centroids(sample, lists))))
    sizes = posted.groupBy("lista").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocos"))
    # At most MAX_LISTS rows: the one side whose size does not depend on the data.
    rows = posted.join(F.broadcast(sizes), "lista").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocos")).cast("int"))
    # A cell of two blocks compares all of its rows, so cells of one block only exist for short lists.
    others = F.filter(F.sequence(F.lit(0), F.col("blocos") - 1), lambda o: (o != F.col("b")) | (F.col("blocos") == 1))
    cells = F.transform(others, lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    rows = rows.withColumn("_c", F.explode(cells)).select("lista", "_c.i", "_c.j", "id", "v")
    met = rows.groupBy("lista", "i", "j").applyInPandas(_best_in_cell(k), "id long, vizinho long, cosseno double")
    return _top(met, k)


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dimension: int = 384, list_size: int = LIST_SIZE) -> DataFrame:
    """(id, vizinho, cosseno): the k most similar other rows of every usable row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col(vector), dimension))
    v = F.transform("v", lambda x: x.cast("float"))
    keyed = rows.select("id", v.alias("v")).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b")))
    # First k + 1 members of each class of equal vectors; the limit is applied before the shuffle.
    members = keyed.select("h", "id").distinct()
    w = Window.partitionBy("h").orderBy("id")
    first = cut_lineage(members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1))
    lead = first.where("n = 1").select("h", F.col("id").alias("classe"))
    first = first.join(lead, "h").select("classe", "id", "n")
    reps = keyed.join(lead.select(F.col("classe").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "v")
    near = cut_lineage(_class_neighbours(cut_lineage(reps), k, list_size))

    # Only classes of several rows are expanded; such a class may hold any share of all rows.
    copied = first.where("n > 1").select("classe").distinct()
    shared = cut_lineage(lead.join(copied, "classe", "left_semi"))
    between = near.select(F.col("id").alias("classe"), F.col("vizinho").alias("_outra"), "cosseno")
    across = between.join(first.where(F.col("n") <= k).select(F.col("classe").alias("_outra"), F.col("id").alias("vizinho")), "_outra").select("classe", "vizinho", "cosseno")
    # Rows without a copy are their class; the others get their equals first.
    single = across.join(copied, "classe", "left_anti").withColumnRenamed("classe", "id")
    grouped = cut_lineage(join_back(members, shared, ["h"], MAX_BROADCAST_CLASSES).select("classe", "id"))
    leads = cut_lineage(first.select("classe", F.col("id").alias("vizinho")).join(shared.select("classe"), "classe", "left_semi"))
    near_classes = cut_lineage(across.join(shared.select("classe"), "classe", "left_semi"))
    equal = join_back(grouped, leads, ["classe"], MAX_BROADCAST_CLASSES).where("id <> vizinho").select("id", "vizinho", F.lit(2.0).alias("cosseno"))
    other = join_back(grouped, near_classes, ["classe"], MAX_BROADCAST_CLASSES).select("id", "vizinho", "cosseno")
    return _top(single.select("id", "vizinho", "cosseno").unionByName(equal).unionByName(other), k).withColumn("cosseno", F.least("cosseno", F.lit(1.0)))


def neighbour_pairs(df: DataFrame, key: str, vector: str, k: int = 5, dimension: int = 384) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of which at least one has the other among its k nearest."""
    near = nearest(df, key, vector, k, dimension)
    return near.select(F.least("id", "vizinho").alias("id_a"), F.greatest("id", "vizinho").alias("id_b")).distinct()
