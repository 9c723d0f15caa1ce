"""Text cut off by field limits (problem 5), in SQL.

Word n-grams are counted inside sentences and at their ends over all texts; the final n-gram of
every text that stops without closing punctuation is joined to those counts and the text is cut
where its end is frequent inside and almost never terminal; an end that many other texts share
without closing punctuation (a notice) counts as terminal.  Texts are counted and judged once however many
rows hold them, so that copies of a cut text do not vouch for each other.  Words that few texts use (names) are
one class, so that the end of "antes de começar <name>" is judged by all names.  The trigram
decides; a trigram that is both inner and terminal is settled by the longest of its 5- and 7-gram
that was seen often enough.  An end never seen at all is a broken word if a longer word begins
with it after the same two words, and a broken name if names stand there and never end a sentence.

A broken character at the end is a cut whatever stands before it.  A mark of omission at the end is
taken off before judging.  Null, empty and blank texts are no
case; a complete text without final period is none either.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.session import cut_lineage, join_back, spread

#: A word is its own class if sentences with it are at least this share of the texts.  At most
#: (mean distinct words of a text's sentences) / FREQUENT words pass, whatever the number of texts.
FREQUENT = 0.005
#: Least number of times an n-gram must have been seen to decide, and the terminal share of a cut.
SUPPORT, TERMINAL = 3, 0.05
RARE = "¤"
#: Up to so many cut texts are broadcast to find their rows.
MAX_BROADCAST_TEXTS = 100_000

_DIFFERENT = "SELECT md5(texto) AS chave, texto FROM (SELECT DISTINCT texto FROM {texts} WHERE texto IS NOT NULL)"

_SENTENCES = r"""
SELECT chave, forma, pos = n - 1 AS ultima, tokens,
       size(tokens) AS k,
       pos < n - 1 OR (corpo RLIKE '[.!?)]["”’)]*$' AND NOT omissao) AS fechada
FROM (
  SELECT chave, forma, pos, n, corpo, omissao,
         regexp_extract_all(regexp_replace(lower(corpo), '[0-9]+', '#'), '[\\pL\\pN%#]+|[,;:()!?]', 0) AS tokens
  FROM (
    SELECT chave, forma, omissao, pos, corpo, size(partes) AS n
    FROM (SELECT chave, omissao, split(limpo, '(?<=[.!?])\\s+') AS partes,
                 xxhash64(regexp_replace(lower(limpo), '[^\\pL\\pN]+', '')) AS forma
          FROM (SELECT chave,
                       texto RLIKE '(?:\\.\\.|…|�)\\s*$' AS omissao,
                       regexp_replace(texto, '(?:\\.\\.+|…|�|\\s)+$', '') AS limpo
                FROM {texts})
          WHERE limpo <> '')
    LATERAL VIEW posexplode(partes) p AS pos, corpo
  )
)
WHERE size(tokens) > 0
"""

_WORDS = """
SELECT palavra FROM (SELECT palavra, count(*) AS frases FROM (SELECT explode(array_distinct(tokens)) AS palavra FROM {sentences}) GROUP BY palavra)
WHERE frases >= {least}
"""

# The 3-, 5- and 7-gram that end at each position of a sentence.
_GRAMS = """
SELECT fechada, k, i,
       array_join(slice(fita, i + 5, 3), ' ') AS g3,
       array_join(slice(fita, i + 3, 5), ' ') AS g5,
       array_join(slice(fita, i + 1, 7), ' ') AS g7
FROM (SELECT fechada, k, concat(array_repeat('^', 6), classes) AS fita, sequence(0, k - 1) AS lugares FROM {classed})
LATERAL VIEW explode(lugares) t AS i
"""

_COUNTS = """
SELECT g, sum(dentro) AS dentro, sum(fim) AS fim, sum(solto) AS solto FROM (
  SELECT explode(array(g3, g5, g7)) AS g,
         CASE WHEN i < k - 1 THEN 1 ELSE 0 END AS dentro,
         CASE WHEN i = k - 1 AND fechada THEN 1 ELSE 0 END AS fim,
         CASE WHEN i = k - 1 AND NOT fechada THEN 1 ELSE 0 END AS solto
  FROM {grams})
GROUP BY g
"""

_ENDS = """
SELECT chave, forma, substring_index(g3, ' ', 2) AS contexto, palavra, g3, g5, g7
FROM (SELECT chave, forma, palavra,
             array_join(slice(fita, k + 4, 3), ' ') AS g3,
             array_join(slice(fita, k + 2, 5), ' ') AS g5,
             array_join(slice(fita, k, 7), ' ') AS g7
      FROM (SELECT chave, forma, k, palavra, concat(array_repeat('^', 6), classes) AS fita FROM {classed} WHERE ultima AND NOT fechada))
"""

# Words that follow a context, to tell a broken word from a whole one.
_FOLLOWERS = """
SELECT substring_index(g, ' ', 2) AS contexto, substring_index(g, ' ', -1) AS seguinte, dentro + fim AS vezes, solto
FROM {counts}
WHERE length(g) - length(replace(g, ' ', '')) = 2 AND substring_index(g, ' ', -1) <> '¤'
UNION ALL SELECT contexto, palavra, 0, count(DISTINCT forma) FROM {ends} GROUP BY contexto, palavra
"""

# ``iguais``: other texts that stop at the same word after the same two without punctuation; texts
# of the same letters and digits are one.
_JUDGED = """
SELECT e.chave, e.contexto, e.palavra, q.iguais, e.g3 LIKE '% ¤' AS raro,
       coalesce(c7.dentro + c7.fim, 0) AS n7, coalesce(c7.fim, 0) AS t7,
       coalesce(c5.dentro + c5.fim, 0) AS n5, coalesce(c5.fim, 0) AS t5,
       coalesce(c3.dentro + c3.fim, 0) AS n3, coalesce(c3.fim, 0) AS t3,
       coalesce(cr.dentro + cr.fim, 0) AS nr, coalesce(cr.fim, 0) AS tr
FROM {ends} e
JOIN (SELECT contexto, palavra, count(DISTINCT forma) - 1 AS iguais FROM {ends} GROUP BY contexto, palavra) q ON q.contexto = e.contexto AND q.palavra = e.palavra
LEFT JOIN {counts} cr ON cr.g = concat(e.contexto, ' ¤')
LEFT JOIN {counts} c3 ON c3.g = e.g3
LEFT JOIN {counts} c5 ON c5.g = e.g5
LEFT JOIN {counts} c7 ON c7.g = e.g7
"""

_BROKEN = """
SELECT DISTINCT j.contexto, j.palavra
FROM (SELECT contexto, palavra, max(iguais) AS iguais FROM {judged} WHERE n3 < {support} OR raro GROUP BY contexto, palavra) j
JOIN (SELECT contexto, vezes, solto, explode(transform(sequence(1, length(seguinte) - 1), i -> left(seguinte, i))) AS comeco
      FROM {followers} WHERE length(seguinte) > 1) f
  ON f.contexto = j.contexto AND f.comeco = j.palavra
WHERE f.vezes >= {support} OR f.solto > 5 * (j.iguais + 1)
"""

_CUT = """
SELECT chave FROM {texts} WHERE texto LIKE '%\ufffd'
UNION
SELECT j.chave FROM {judged} j
LEFT JOIN {broken} b ON b.contexto = j.contexto AND b.palavra = j.palavra
WHERE CASE
  WHEN b.contexto IS NOT NULL THEN true
  WHEN n3 >= {support} AND t3 + iguais < {terminal} * (n3 + iguais) THEN true
  WHEN n3 >= {support} AND n7 >= {support} THEN t7 + iguais < {terminal} * (n7 + iguais)
  WHEN n3 >= {support} AND n5 >= {support} THEN t5 + iguais < {terminal} * (n5 + iguais)
  WHEN n3 >= {support} THEN false
  ELSE nr >= {support} AND tr + iguais < {terminal} * (nr + iguais)
END
"""


def _frequent_words(sentences: DataFrame, texts: DataFrame) -> list[str]:
    least = max(2.0, FREQUENT * texts.count())
    return [r[0] for r in texts.sparkSession.sql(_WORDS, sentences=sentences, least=least).collect()]


def _classed(sentences: DataFrame, words: list[str]) -> DataFrame:
    """Tokens as classes: a bucketed lookup in a literal whose size the share of texts bounds."""
    spark = sentences.sparkSession
    slots = max(1, 4 * len(words))
    buckets: list[list[str]] = [[] for _ in range(slots)]
    placed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(slots)))
    for word, slot in placed.collect():
        buckets[slot].append(word)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")
    known = lambda t: F.array_contains(F.element_at(table, (F.pmod(F.xxhash64(t), F.lit(slots)) + 1).cast("int")), t)
    classes = F.transform("tokens", lambda t: F.when(known(t), t).otherwise(F.lit(RARE)))
    return sentences.select("chave", "forma", "ultima", "fechada", "k", F.element_at("tokens", -1).alias("palavra"), classes.alias("classes"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """(tabela, id) of the truncated rows among (tabela, id, texto)."""
    spark = texts.sparkSession
    # Several passes read the different texts; they are made once.
    different = cut_lineage(spread(spark.sql(_DIFFERENT, texts=texts), "chave"))
    # Texts are cut into tokens once; counting, ends and followers read the classes.
    sentences = cut_lineage(spark.sql(_SENTENCES, texts=different))
    classed = cut_lineage(_classed(sentences, _frequent_words(sentences, different)))
    grams = spark.sql(_GRAMS, classed=classed)
    # n-grams of classes are few however many texts there are; they are written once.
    counts = cut_lineage(spark.sql(_COUNTS, grams=grams))
    ends = spark.sql(_ENDS, classed=classed)
    judged = spark.sql(_JUDGED, ends=ends, counts=counts)
    followers = spark.sql(_FOLLOWERS, counts=counts, ends=ends)
    broken = spark.sql(_BROKEN, judged=judged, followers=followers, support=SUPPORT)
    cut = cut_lineage(spark.sql(_CUT, texts=different, judged=judged, broken=broken, support=SUPPORT, terminal=TERMINAL))
    rows = texts.where("texto IS NOT NULL").select("tabela", "id", F.md5("texto").alias("chave"))
    return join_back(rows, cut, ["chave"], MAX_BROADCAST_TEXTS).select("tabela", "id").distinct()


def cut_rates(texts: DataFrame) -> DataFrame:
    """(tabela, resumo_modelo, textos, cortados, taxa) for (tabela, id, texto, resumo_modelo)."""
    cut = cut_texts(texts.select("tabela", "id", "texto")).withColumn("cortado", F.lit(1))
    joined = texts.where(F.col("texto").isNotNull()).join(cut, ["tabela", "id"], "left")
    return joined.groupBy("tabela", "resumo_modelo").agg(
        F.count("*").alias("textos"), F.count("cortado").alias("cortados"), F.round(F.count("cortado") / F.count("*"), 6).alias("taxa")
    )
