"""Noise in text from scanned pages (problem 7).

Three kinds of damage are found and repaired, in this order:

* ``cabecalho_rodape``: edge lines.  Page numbers by their form; running headers and footers as
  lines that recur over many texts although at least half of their words never occur in texts
  without line breaks.  The line that opens a text is never one.
* ``hifenizacao``: words divided at a line end, by hyphen evidence: a break is a compound at its
  own hyphen if the hyphenated form occurs inside lines more often than the joined word does.
* ``caractere``: misread characters.  Every word has an anagram hash, a sum over its characters;
  the difference of the hashes of two confusable strings is constant, so rare words meet their
  frequent confusable variants in an equi-join on hash plus difference.  Words are counted over
  different texts, however many rows hold them: a text delivered again under new keys does not make
  its misread words frequent.  Confusions are ranked by
  what they explain over the whole corpus and only those with evidence are applied.

Text in other look-alike characters (problem 2) is brought to its consistent form first and is no
damage here.  Null and blank texts have no damage; a text without line breaks has neither edge
lines nor divided words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm.confusables import with_consistent_form
from marisma.session import cut_lineage, is_small, spread

# Fixed values: (misread, true) strings that scanners confuse.
CONFUSIONS = (
    ("@", "a"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"),
    ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("rn", "m"), ("m", "rn"),
    ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("n", "u"), ("u", "n"),
    ("h", "b"), ("b", "h"), ("â", "ã"), ("ã", "â"), ("c,", "ç"),
)
#: An edge line recurs in at least so many, and such a share, of the broken texts; share of its
#: words unseen in unbroken texts.
LEAST_TEXTS, LEAST_SHARE, UNSEEN = 3, 0.0005, 0.5
#: A misread word's variant is in at least so many texts, and so many times more than the word.
LEAST_VARIANT, LEAST_RATIO = 3, 3
#: A known word is a variant of words that are no more frequent, or in at most so many texts.
FEW = 2
#: Words in at least so many texts rank the confusions; least rate at which a string was misread.
SOLID, LEAST_EVIDENCE = 20, 0.0003
#: Words in at least this share of the rows; at most (mean distinct words of a text) / COMMON.
COMMON = 0.002
#: Up to so many rows are broadcast: marks of copied texts, corrections.
MAX_BROADCAST_ROWS = 200_000

_PAGE = r"^[\s|–—-]*(?:p[aá]g(?:ina|\.)?\s*)?#(?:\s*(?:/|de)\s*#)?[\s|–—-]*$"
_BREAK = r"(\\pL+)([-¬‐])[ \\t\\r]*\\n[ \\t]*(\\pL+)"
_JOIN = r"(?<=\pL)[-\x{ac}\x{2010}][ \t\r]*\n[ \t]*(?=\pL)"


def _lines(texts: DataFrame) -> DataFrame:
    """(tabela, chave, i, linha, mascara) of the texts that have line breaks."""
    rows = texts.where(F.col("texto").contains("\n")).select("tabela", "chave", F.posexplode(F.split(F.regexp_replace("texto", r"^\s+", ""), r"\r?\n")).alias("i", "linha"))
    return rows.withColumn("mascara", F.lower(F.trim(F.regexp_replace("linha", r"\d+", "#"))))


_UNBROKEN_WORDS = r"""
SELECT palavra, count(*) AS n FROM (
  SELECT explode(regexp_extract_all(lower(texto), '\\pL+', 0)) AS palavra FROM {texts} WHERE NOT contains(texto, chr(10)))
GROUP BY palavra
"""

_RECURRENT = r"""
SELECT mascara FROM {lines} WHERE i > 0 AND linha RLIKE '\\pL' AND NOT linha RLIKE '^\\PL*\\p{{Ll}}' AND NOT linha RLIKE '[-¬‐]\\s*$' AND length(mascara) <= 100
GROUP BY mascara HAVING count(DISTINCT tabela, chave) >= {least}
"""

_EDGE_LINES = r"""
SELECT mascara FROM (
  SELECT r.mascara, r.palavra, w.palavra IS NULL AS nova
  FROM (SELECT mascara, explode(regexp_extract_all(mascara, '(?<![\\pL\\pN@#])\\pL+(?![\\pL\\pN@#])', 0)) AS palavra FROM {recurrent}) r
  LEFT JOIN {unbroken} w ON w.palavra = r.palavra)
GROUP BY mascara HAVING count_if(nova) >= {unseen} * count(*)
"""


def edge_lines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the broken texts, the lines among them that are headers, footers or page numbers)."""
    spark = texts.sparkSession
    lines = _lines(texts)
    least = max(float(LEAST_TEXTS), LEAST_SHARE * texts.where(F.col("texto").contains("\n")).count())
    recurrent = spark.sql(_RECURRENT, lines=lines, least=least)
    unbroken = spark.sql(_UNBROKEN_WORDS, texts=texts)
    running = spark.sql(_EDGE_LINES, recurrent=recurrent, unbroken=unbroken, unseen=UNSEEN).withColumn("_r", F.lit(True))
    marked = lines.join(running, "mascara", "left")
    edge = (F.col("i") > 0) & ((F.coalesce("_r", F.lit(False)) & ~F.col("linha").rlike(r"^\PL*\p{Ll}")) | F.col("mascara").rlike(_PAGE))
    return marked.select("tabela", "chave", "i", "linha", edge.alias("margem")), running


def without_edges(texts: DataFrame) -> DataFrame:
    """(tabela, chave, texto, margem): texts without edge lines; ``margem`` says whether one was there.

    Only broken texts are cut into lines and put together again, by their key: a text's lines are
    bounded by the text itself.
    """
    marked, _ = edge_lines(texts)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("margem"), F.struct("i", "linha")))), lambda x: x["linha"]), "\n")
    whole = marked.groupBy("tabela", "chave").agg(body.alias("texto"), F.bool_or("margem").alias("margem"))
    plain = texts.where(~F.col("texto").contains("\n")).select("tabela", "chave", "texto", F.lit(False).alias("margem"))
    return plain.unionByName(whole)


_BREAKS = rf"""
SELECT tabela, chave, regexp_extract(achado, '{_BREAK}', 2) AS marca,
       regexp_extract(achado, '{_BREAK}', 1) AS antes, regexp_extract(achado, '{_BREAK}', 3) AS depois
FROM (SELECT tabela, chave, explode(regexp_extract_all(texto, '{_BREAK}', 0)) AS achado FROM {{bodies}} WHERE contains(texto, chr(10)))
"""

# How often the hyphenated and the joined form of each break occur inside lines, counted in one pass.
_EVIDENCE = r"""
SELECT p.antes, p.depois, coalesce(c.n, 0) > coalesce(w.n, 0) AS composto
FROM (SELECT DISTINCT lower(antes) AS antes, lower(depois) AS depois FROM {breaks} WHERE marca <> '¬') p
LEFT JOIN {forms} c ON c.forma = concat(p.antes, '-', p.depois)
LEFT JOIN {forms} w ON w.forma = concat(p.antes, p.depois)
"""

_FORMS = r"""
SELECT forma, count(*) AS n FROM (
  SELECT explode(concat(regexp_extract_all(baixo, '\\pL+-\\pL+', 0), regexp_extract_all(baixo, '\\pL+', 0))) AS forma
  FROM (SELECT lower(texto) AS baixo FROM {bodies}))
WHERE forma IN (SELECT lower(concat(antes, '-', depois)) FROM {breaks} UNION ALL SELECT lower(concat(antes, depois)) FROM {breaks})
GROUP BY forma
"""

_DIVIDED = """
SELECT b.tabela, b.chave, b.antes, b.depois, b.marca, coalesce(e.composto, false) AS composto
FROM {breaks} b LEFT JOIN {evidence} e ON e.antes = lower(b.antes) AND e.depois = lower(b.depois) AND b.marca <> '¬'
"""


def divided_words(bodies: DataFrame) -> DataFrame:
    """(tabela, chave, antes, depois, marca, composto) of every word broken at a line end."""
    spark = bodies.sparkSession
    breaks = cut_lineage(spark.sql(_BREAKS, bodies=bodies))
    forms = cut_lineage(spark.sql(_FORMS, breaks=breaks, bodies=bodies))
    return spark.sql(_DIVIDED, breaks=breaks, evidence=spark.sql(_EVIDENCE, breaks=breaks, forms=forms))


# Sum over the characters of (code mod 1009)^5: equal for anagrams, additive over replacements.
_HASH = "aggregate(split({w}, ''), 0L, (s, c) -> s + CASE WHEN c = '' THEN 0L ELSE cast(pow(ascii(c) % 1009, 5) AS bigint) END)"

# The different words of each text, and two hashes of its letters, digits and signs.
_TEXT_WORDS = r"""
SELECT tabela, chave, linha, xxhash64(1, forma) AS h1, xxhash64(2, forma) AS h2,
       filter(array_distinct(regexp_extract_all(baixo, '[\\pL\\pN@]+(?:(?<=c),(?=\\pL)[\\pL\\pN@]+)*', 0)),
              p -> p RLIKE '\\pL' AND NOT p RLIKE '^\\pN+\\pL{{1,3}}$|^\\pL{{1,3}}\\pN+$') AS palavras
FROM (SELECT *, regexp_replace(baixo, '[^\\pL\\pN@]+', '') AS forma FROM (SELECT tabela, chave, linha, lower(texto) AS baixo FROM {joined}))
"""

_VARIANTS = """
SELECT r.palavra, r.n, v.palavra AS certa, v.n AS vezes, c.de, c.para
FROM (SELECT palavra, n, {hash_r} AS h FROM {words} WHERE NOT aceita) r
JOIN {pairs} c ON contains(r.palavra, c.de)
JOIN (SELECT palavra, n, aceita, {hash_v} AS h FROM {words} WHERE n >= {least} OR aceita) v
  ON v.h = r.h + c.diferenca
WHERE v.palavra <> r.palavra
  AND ((v.n >= {least} AND v.n >= {ratio} * r.n) OR (v.aceita AND (r.n <= v.n OR r.n <= {few})))
  AND exists(sequence(1, length(r.palavra)), i -> substr(r.palavra, i, length(c.de)) = c.de
             AND concat(substr(r.palavra, 1, i - 1), c.para, substr(r.palavra, i + length(c.de))) = v.palavra)
"""

# A confusion is ranked by how often its true string was misread: the texts it explains against the
# texts with a frequent word that has the string, so that rare strings are not outweighed.
_RANKED = """
SELECT e.de, e.para, e.textos, coalesce(o.textos, 0) AS chances
FROM (SELECT de, para, sum(n) AS textos FROM {variants} WHERE vezes >= {solid} GROUP BY de, para) e
JOIN (SELECT c.de, c.para, sum(w.n) AS textos FROM {words} w JOIN {pairs} c ON contains(w.palavra, c.para) WHERE w.n >= {solid} GROUP BY c.de, c.para) o
  ON o.de = e.de AND o.para = e.para
"""

_CORRECTIONS = """
SELECT palavra, max_by(certa, vezes) AS certa FROM {variants} v
JOIN {ranked} k ON k.de = v.de AND k.para = v.para AND k.textos >= {share} * k.chances GROUP BY palavra
"""

# A sign or digit inside letters is misread even where the true word is known nowhere.
_INSIDE = r"(?:^|\pL)@\pL|\pL@|^(?=(?:[^\pL]*\pL){5}).*\pL[0156]\pL"
_SIGNS = ("@0156", "aolsb")


def _pairs(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    code = lambda s: sum((ord(c) % 1009) ** 5 for c in s)
    return spark.createDataFrame([(a, b, code(b) - code(a)) for a, b in CONFUSIONS], "de string, para string, diferenca long")


def corrections(words: DataFrame) -> DataFrame:
    """(palavra, certa) of the misread words among (palavra, n, aceita).

    ``n`` is the number of texts with the word, ``aceita`` marks words known to be right (names of
    the catalogue): they are never misread and are variants however rare.
    """
    spark = words.sparkSession
    sql = _VARIANTS.replace("{hash_r}", _HASH.replace("{w}", "palavra")).replace("{hash_v}", _HASH.replace("{w}", "palavra"))
    variants = cut_lineage(spark.sql(sql, words=words, pairs=F.broadcast(_pairs(words)), few=FEW, least=LEAST_VARIANT, ratio=LEAST_RATIO))
    ranked = spark.sql(_RANKED, variants=variants, words=words, pairs=F.broadcast(_pairs(words)), solid=SOLID)
    found = spark.sql(_CORRECTIONS, variants=variants, ranked=F.broadcast(ranked), share=LEAST_EVIDENCE)
    signs = words.where(~F.col("aceita") & F.col("palavra").rlike(_INSIDE)).select("palavra", F.translate("palavra", *_SIGNS).alias("certa"))
    return found.unionByName(signs.join(found, "palavra", "left_anti"))


def _different(rows: DataFrame) -> DataFrame:
    """(palavras, linhas): one row of each text of (linha, h1, h2, palavras), with the number of its rows.

    Texts of the same letters, digits and signs are one.  Only hashes are grouped; the few rows that
    are copies or have some are marked by their number.
    """
    first = rows.groupBy("h1", "h2").agg(F.min("linha").alias("linha"), F.count("*").alias("linhas")).select("linha", "linhas")
    marks = rows.select("linha").join(first, "linha", "left").select("linha", F.coalesce("linhas", F.lit(0)).alias("linhas"))
    marks = cut_lineage(marks.where("linhas <> 1"))
    marks = F.broadcast(marks) if is_small(marks, MAX_BROADCAST_ROWS) else marks
    marked = rows.select("linha", "palavras").join(marks, "linha", "left").select("palavras", F.coalesce("linhas", F.lit(1)).alias("linhas"))
    return marked.where("linhas > 0")


class Repair:
    """The stages over one set of texts (tabela, chave, texto), shared by what is asked of them.

    ``known`` is an optional frame of words (palavra) that are right, lower case.
    """

    def __init__(self, texts: DataFrame, known: DataFrame | None = None):
        texts = texts.where(F.col("texto").isNotNull()).withColumn("texto", F.regexp_replace("texto", "­(?=[ \\t\\r]*\\n)", "¬"))
        # Six passes read the clean texts; their consistent form is made once.
        clean = cut_lineage(with_consistent_form(spread(texts), "texto", "_c").select("tabela", "chave", F.col("_c").alias("texto")))
        self.bodies = cut_lineage(without_edges(clean).withColumn("linha", F.monotonically_increasing_id()))
        self.divided = divided_words(self.bodies)
        joined = self.bodies.withColumn("texto", F.regexp_replace("texto", _JOIN, ""))
        # Counting and finding read the words; texts are cut into words once.
        rows = cut_lineage(joined.sparkSession.sql(_TEXT_WORDS, joined=joined))
        self.text_words = rows.select("tabela", "chave", F.explode("palavras").alias("palavra"))
        counted = _different(rows).select("linhas", F.explode("palavras").alias("palavra")).groupBy("palavra").agg(F.count("*").alias("n"), F.sum("linhas").alias("linhas"))
        if known is None:
            words = counted.withColumn("aceita", F.lit(False))
        else:
            right = known.select("palavra", F.lit(True).alias("_k")).distinct()
            words = counted.join(right, "palavra", "full_outer").select("palavra", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("linhas", F.lit(0)).alias("linhas"), F.coalesce("_k", F.lit(False)).alias("aceita"))
        self.words = cut_lineage(words)
        self.corrections = cut_lineage(corrections(self.words))

    def misread(self) -> DataFrame:
        """(tabela, chave, palavra, certa) of every misread word of every text.

        Common words leave before the shuffle: their number is bounded by ``COMMON``, so they are
        broadcast; what is common and misread stays.  A misread word may stand in a third of the
        rows, so corrections are broadcast up to a counted number.
        """
        least = F.lit(COMMON) * F.lit(self.bodies.count())
        common = self.words.where(F.col("linhas") >= least).join(self.corrections, "palavra", "left_anti").select("palavra")
        rest = self.text_words.join(F.broadcast(common), "palavra", "left_anti")
        corrected = F.broadcast(self.corrections) if is_small(self.corrections, MAX_BROADCAST_ROWS) else self.corrections
        return rest.join(corrected, "palavra").select("tabela", "chave", "palavra", "certa")

    def damage(self) -> DataFrame:
        """(tabela, chave, defeito), one row for each kind of damage a text has."""
        edge = self.bodies.where("margem").select("tabela", "chave", F.lit("cabecalho_rodape").alias("defeito"))
        broken = self.divided.where(~F.col("composto")).select("tabela", "chave", F.lit("hifenizacao").alias("defeito"))
        misread = self.misread().select("tabela", "chave", F.lit("caractere").alias("defeito"))
        return edge.unionByName(broken).unionByName(misread).distinct()

    def repaired(self) -> DataFrame:
        """(tabela, chave, texto): continuous paragraphs without the damage."""
        compounds = self.divided.where("composto").groupBy("tabela", "chave").agg(F.collect_set(F.struct("antes", "depois")).alias("_h"))
        fixes = self.misread().groupBy("tabela", "chave").agg(F.collect_set(F.struct("palavra", "certa")).alias("_m"))
        rows = self.bodies.join(compounds, ["tabela", "chave"], "left").join(fixes, ["tabela", "chave"], "left")
        text = F.regexp_replace("texto", r"-[ \t\r]*\n[ \t]*", "-\n")
        keep = F.expr("aggregate(coalesce(_h, array()), _t, (t, h) -> replace(t, concat(h.antes, '-', chr(10), h.depois), concat(h.antes, '-', h.depois)))")
        fix = F.expr(r"aggregate(coalesce(_m, array()), _t, (t, m) -> regexp_replace(t, concat('(?iu)(?<![\\pL\\pN@])', m.palavra, '(?![\\pL\\pN@])'), m.certa))")
        rows = rows.withColumn("_t", text).withColumn("_t", keep).withColumn("_t", F.regexp_replace("_t", _JOIN, ""))
        rows = rows.withColumn("_t", F.regexp_replace("_t", r"[ \t\r]*\n[ \t]*", " ")).withColumn("_t", fix)
        return rows.select("tabela", "chave", F.trim("_t").alias("texto"))
