"""Incremental runs over a stream of sources: each micro-batch goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marisma.schemas import TABLES
from marisma.session import cut_lineage


def source_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a table's folder as a stream."""
    return spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def process_pending(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, version: str | None = None, key: str = "nome_normalizado", poll: str | None = None) -> StreamingQuery:
    """Run ``step`` on the sources of every micro-batch that are still pending and write its rows under the
    batch's number.

    A batch that is retried overwrites its own folder.  With a ``version``, sources of one key and text
    that an earlier batch wrote under it are left out, so a source delivered again is processed once; a
    batch's sources are noted beside its rows.  ``poll`` keeps the query running at that interval instead
    of ending with what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if version is None:
            step(batch).write.mode("overwrite").parquet(f"{out}/lote={number}")
            return
        noted = f"{out}_fontes"
        mark = [F.col(key), F.sha2(F.coalesce("trecho_interacoes", F.lit("")), 256).alias("hash_texto"), F.lit(version).alias("versao")]
        due = batch.select("*", *mark[1:]).dropDuplicates([key, "hash_texto"])
        try:
            # A retried batch does not see its own note.
            done = spark.read.parquet(noted).where(F.col("lote") != number)
            due = due.join(done.select(key, "hash_texto", "versao"), [key, "hash_texto", "versao"], "left_anti")
        except AnalysisException:
            pass
        due = cut_lineage(due)
        step(due.select(*batch.columns)).write.mode("overwrite").parquet(f"{out}/lote={number}")
        due.select(key, "hash_texto", "versao").write.mode("overwrite").parquet(f"{noted}/lote={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and kind; rows later than ``late`` behind the newest are left out."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("janela"), kind).agg(F.count("*").alias("n"))
