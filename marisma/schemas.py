"""Schemas of the five tables, their enumerations and CHECK predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The declared columns, as DDL.
COLUMNS = {
    "bulas": """
        nome_normalizado STRING, nome_anvisa STRING, numero_registro STRING, expediente STRING, principios_ativos STRING, composicao STRING, status STRING,
        tentativas INT, tempo_total_segundos DECIMAL(12,3)""",
    "bulas_interacoes": """
        nome_normalizado STRING, trecho_interacoes STRING, status_extracao STRING, detalhe_revisao STRING,
        tempo_leitura_segundos DECIMAL(12,3), tempo_inferencia_segundos DECIMAL(12,3), tempo_total_segundos DECIMAL(12,3)""",
    "processamentos_interacoes": """
        id BIGINT, medicamento_origem STRING, status STRING, versao_processamento STRING, modelo STRING,
        quantidade_janelas INT, janelas_concluidas INT, quantidade_relacoes INT, quantidade_rejeicoes INT, chamadas_llm INT,
        tempo_inferencia_segundos DECIMAL(12,3), tempo_total_segundos DECIMAL(12,3), pico_memoria_mb DECIMAL(10,1), concluido_em TIMESTAMP_NTZ, invalidado_em TIMESTAMP_NTZ,
        resumo_geral STRING, resumo_geral_simples STRING, resumo_status STRING, resumo_modelo STRING, resumo_erro STRING, resumo_gerado_em TIMESTAMP_NTZ,
        reescrita_controle STRING, resumo_tempo_inferencia_segundos DOUBLE, resumo_tempo_total_segundos DOUBLE""",
    "interacoes": """
        id BIGINT, medicamento_origem STRING, processamento_id BIGINT, alvo STRING, tipo_alvo STRING, resumo STRING, evidencia STRING,
        resumo_card STRING, resumo_card_simples STRING, resumo_status STRING, resumo_modelo STRING, resumo_origem STRING,
        resumo_tempo_segundos DOUBLE, resumo_erro STRING, resumo_atualizado_em TIMESTAMP_NTZ, reescrita_controle STRING""",
    "interacoes_medicamentos": "interacao_id BIGINT, medicamento_relacionado STRING, criterio_vinculo STRING, invalidado_em TIMESTAMP_NTZ",
}
_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "DECIMAL(12,3)": T.DecimalType(12, 3), "DECIMAL(10,1)": T.DecimalType(10, 1),
}
# Built without a session, which Spark's own DDL parser would need.
TABLES = {name: T.StructType([T.StructField(c, _TYPES[t]) for c, t in re.findall(r"(\w+) ([A-Z_]+(?:\(\d+,\d+\))?)", ddl)]) for name, ddl in COLUMNS.items()}

# The enumerations.
RUN_STATUS = ("CONCLUIDO_COM_RELACOES", "CONCLUIDO_SEM_RELACOES", "REVISAO_NECESSARIA", "FALHA")
TARGET_TYPES = ("MEDICAMENTO", "PRINCIPIO_ATIVO", "CLASSE_FARMACOLOGICA", "GRUPO_ALIMENTAR", "ALIMENTO", "EXAME_LABORATORIAL", "OUTRA_SUBSTANCIA", "OUTRO")
CRITERIA = ("NOME_MEDICAMENTO_EXATO", "PRINCIPIO_ATIVO_EXATO", "PRINCIPIO_ATIVO_SEM_SAL", "COMPOSICAO_EQUIVALENCIA_DECLARADA")


def schema_differences(df: DataFrame, table: str) -> list[tuple[str, str | None, str | None]]:
    """(column, expected type, found type) of every column that differs from the declared schema."""
    expected = {f.name: f.dataType.simpleString() for f in TABLES[table].fields}
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, expected.get(c), found.get(c)) for c in sorted({*expected, *found}) if expected.get(c) != found.get(c)]


def run_checks() -> dict[str, Column]:
    """CHECK predicates of the runs; a predicate that is NULL passes."""
    done, total = F.col("janelas_concluidas"), F.col("quantidade_janelas")
    relations = F.col("quantidade_relacoes")
    return {
        "janelas": (done >= 0) & (done <= total) & ((done == total) | (F.col("status") == "FALHA")),
        "relacoes": F.when(F.col("status") == "CONCLUIDO_COM_RELACOES", relations > 0).when(F.col("status") == "CONCLUIDO_SEM_RELACOES", relations == 0),
        "status": F.col("status").isin(*RUN_STATUS),
        "versao": F.trim("versao_processamento") != "",
    }
