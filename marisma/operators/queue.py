"""A queue of requests as data: de-duplication, redirects, recovery, retries and stages.

A queue has id, nome_normalizado, nome_confirmado, principal_id, estado, etapa, tentativas, criado_em and
disponivel_em.  There is one writer; every step is a function from a frame to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a request, and the stages in their order.
ACTIVE = ("AGUARDANDO", "EM_PROCESSAMENTO", "AGUARDANDO_SELECAO")
STAGES = ("AGUARDANDO", "COLETA", "EXTRACAO", "IDENTIFICACAO", "RESUMOS", "CONCLUIDO")
MAX_HOPS = 16


def accept(requests: DataFrame, queue: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pedido, nome_normalizado, destino, decisao): what becomes of each new request (pedido,
    nome_normalizado): the oldest active request of that name takes it (EXISTENTE), or the name is in
    the catalogue (CADASTRADO), or the first of the equal new ones is put into the queue (NOVO) and the
    others follow it (REPETIDO)."""
    open_ = queue.where(F.col("principal_id").isNull() & F.col("estado").isin(*ACTIVE))
    names = open_.select("id", "criado_em", F.explode(F.array_distinct(F.array("nome_normalizado", F.coalesce("nome_confirmado", "nome_normalizado")))).alias("nome_normalizado"))
    oldest = names.groupBy("nome_normalizado").agg(F.min_by("id", F.struct("criado_em", "id")).alias("_id"))
    known = catalog.select("nome_normalizado", F.lit(True).alias("_c")).distinct()
    first = requests.groupBy("nome_normalizado").agg(F.min("pedido").alias("_p"))
    rows = requests.join(oldest, "nome_normalizado", "left").join(known, "nome_normalizado", "left").join(first, "nome_normalizado")
    decision = F.when(F.col("_id").isNotNull(), "EXISTENTE").when(F.col("_c"), "CADASTRADO").when(F.col("pedido") == F.col("_p"), "NOVO").otherwise("REPETIDO")
    target = F.when(F.col("_id").isNotNull(), F.col("_id")).when(F.col("_c"), F.lit(None)).otherwise(F.col("_p"))
    return rows.select("pedido", "nome_normalizado", target.alias("destino"), decision.alias("decisao"))


def followed(queue: DataFrame) -> DataFrame:
    """(id, final, saltos): where the redirects of each request end, over at most ``MAX_HOPS`` of them;
    ``final`` is null if there is no end by then.  Pointers are doubled, so few joins are made."""
    rows = queue.select("id", F.coalesce("principal_id", "id").alias("final"), F.when(F.col("principal_id").isNull(), 0).otherwise(1).alias("saltos"))
    steps = 1
    while steps < MAX_HOPS:
        nxt = rows.select(F.col("id").alias("final"), F.col("final").alias("_f"), F.col("saltos").alias("_s"))
        rows = rows.join(nxt, "final", "left").select("id", F.coalesce("_f", "final").alias("final"), (F.col("saltos") + F.coalesce("_s", F.lit(0))).alias("saltos"))
        steps *= 2
    ends = queue.where(F.col("principal_id").isNull()).select(F.col("id").alias("final"), F.lit(True).alias("_e"))
    return rows.join(ends, "final", "left").select("id", F.when(F.col("_e"), F.col("final")).alias("final"), "saltos")


def recovered(queue: DataFrame, attempts: int = 3) -> DataFrame:
    """Requests that were being processed when their worker ended: to be tried again, or FALHA after the
    last attempt."""
    broken = (F.col("estado") == "EM_PROCESSAMENTO") & F.col("principal_id").isNull()
    state = F.when(broken & (F.col("tentativas") >= attempts), "FALHA").when(broken, "AGUARDANDO").otherwise(F.col("estado"))
    return queue.withColumn("estado", state)


def rescheduled(queue: DataFrame, ids: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Requests put back, available after a delay."""
    hit = ids.select("id", F.lit(True).alias("_h")).distinct()
    rows = queue.join(hit, "id", "left")
    later = now + F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumns({"estado": F.when(F.col("_h"), "AGUARDANDO").otherwise(F.col("estado")), "disponivel_em": F.when(F.col("_h"), later).otherwise(F.col("disponivel_em"))}).select(*queue.columns)


def next_stage(stage: Column, ok: Column) -> Column:
    """The stage after one that succeeded; the same one after a failure; the last stays."""
    following = F.create_map(*[F.lit(x) for pair in zip(STAGES, [*STAGES[1:], STAGES[-1]]) for x in pair])
    return F.when(ok, F.coalesce(following[stage], stage)).otherwise(stage)


def reservable(queue: DataFrame, now: Column, most: int, attempts: int = 3) -> DataFrame:
    """The oldest requests that wait, are available and have attempts left, at most ``most``, as they are
    once reserved."""
    free = (F.col("estado") == "AGUARDANDO") & F.col("principal_id").isNull() & (F.col("disponivel_em") <= now) & (F.col("tentativas") < attempts)
    taken = queue.where(free).orderBy("criado_em", "id").limit(most)
    return taken.withColumns({"estado": F.lit("EM_PROCESSAMENTO"), "tentativas": F.col("tentativas") + 1})


def attempts_by_state(queue: DataFrame) -> DataFrame:
    """How many requests each state has and how often they were tried, with their share of all."""
    rows = queue.groupBy("estado").agg(F.count("*").alias("pedidos"), F.sum("tentativas").alias("tentativas"))
    # One row a state.
    return rows.withColumn("parte", F.round(F.col("pedidos") / F.sum("pedidos").over(Window.partitionBy(F.lit(1))), 6))
