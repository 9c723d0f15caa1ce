"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Applied by :func:`build_session`; a session made elsewhere keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "marisma", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` uses ``__`` for dots in keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table of few files is read by few tasks; where rows cost much more than their transport, that
    leaves cores idle.  A frame that has enough partitions already is returned as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    # The number of files and their size say how many tasks a scan has; nothing is executed for it.
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if max(len(df.inputFiles()), size // most) >= wanted:
        return df
    return df.repartition(wanted, *keys)


def is_small(df: DataFrame, most: int) -> bool:
    """Whether a frame has at most ``most`` rows; a count that stops early.  Guards a broadcast."""
    return df.limit(most + 1).count() <= most


def join_back(rows: DataFrame, keyed: DataFrame, on: list[str], most: int) -> DataFrame:
    """Inner join of many rows to ``keyed``, few rows a key, where a key may hold any share of the rows.

    Up to ``most`` keys are broadcast.  Beyond it only the keys of hot groups are: a group is hot from
    a quarter of a core's share of the rows, so there are at most four times as many as cores; the
    rest is an ordinary join.  ``keyed`` is read twice and should be written already.
    """
    if is_small(keyed, most):
        return rows.join(F.broadcast(keyed), on)
    counted = cut_lineage(rows.groupBy(*on).agg(F.count("*").alias("_n")))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(counted.where(F.col("_n") * 4 * rows.sparkSession.sparkContext.defaultParallelism >= total).select(*on))
    near = rows.join(F.broadcast(keyed.join(hot, on, "left_semi")), on)
    return near.unionByName(rows.join(hot, on, "left_anti").join(keyed, on))


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Only where that is unset (tests, a
    laptop) it is a local folder of our own, removed when the process ends."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marisma-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, so that a lost executor re-reads it instead of
    recomputing.  Written as Parquet: compressed, and later stages read only the columns they use."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
