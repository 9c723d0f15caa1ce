"""Functions under SQL names, and the questions with typed arguments."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL functions that are expressions of built-in ones; they stay in the JVM.
EXPRESSIONS = {
    "mr_blank": ("x STRING", "BOOLEAN", r"coalesce(btrim(x), '') = ''"),
    "mr_filled": ("x STRING", "BOOLEAN", r"coalesce(x, '') RLIKE '(?U)\\S'"),
    "mr_quotation_key": ("x STRING", "STRING", r"lower(regexp_replace(x, '(?U)\\s+', ''))"),
    "mr_words": ("x STRING", "ARRAY<STRING>", r"regexp_extract_all(x, '[a-z0-9]+', 0)"),
    "mr_key_words": ("x STRING", "STRING", r"array_join(regexp_extract_all(x, '[a-z0-9]+', 0), ' ')"),
    "mr_list_of": ("x STRING", "ARRAY<STRING>", r"filter(transform(split(coalesce(x, ''), ';'), e -> trim(e)), e -> e <> '')"),
    "mr_unit_norm": ("v ARRAY<FLOAT>", "DOUBLE", r"sqrt(aggregate(v, 0D, (a, e) -> a + CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))"),
    "mr_contains_term": ("x STRING, term STRING", "BOOLEAN", r"size(regexp_extract_all(term, '[a-z0-9]+', 0)) > 0 AND contains(concat(' ', array_join(regexp_extract_all(x, '[a-z0-9]+', 0), ' '), ' '), concat(' ', array_join(regexp_extract_all(term, '[a-z0-9]+', 0), ' '), ' '))"),
}


def register(spark: SparkSession) -> list[str]:
    """Register the functions in a session under their names: expressions as temporary SQL functions, the
    others as Arrow-batched ones.  The names registered, sorted."""
    from marisma.operators import explain, segments, summaries

    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    batched = {"mr_units": segments.units, "mr_highlights": segments.highlights, "mr_canonical_hash": summaries.canonical_hash, "mr_sequence_ratio": explain.sequence_ratio}
    for name, f in batched.items():
        spark.udf.register(name, f)
    spark.udf.register("mr_fold_name", F.pandas_udf(_fold_series, T.StringType()))
    return sorted([*EXPRESSIONS, *batched, "mr_fold_name"])


def _fold_series(x: pd.Series) -> pd.Series:
    fold = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)).split())
    return x.map(fold, na_action="ignore")
