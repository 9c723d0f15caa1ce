"""Pages as they are read: reading order of lines, glued headings, and which pages need recognition."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions.text import slug

#: Least width of a gap between columns, lines on each side, share of lines that may cross it.
GAP, SIDE, CROSSING = 5, 5, 0.10


def reading_order(boxes: list[tuple[float, float, float, float, str]], depth: int = 0) -> list[int] | None:
    """Order of lines (x0, y0, x1, y1, text) by the widest real gap between two columns of prose, each
    column by itself, lines across both in their place; None if there are no columns."""
    if len(boxes) < 2 * SIDE or depth >= 3:
        return None
    edges = sorted({b[0] for b in boxes} | {b[2] for b in boxes})
    best = None
    for a, b in zip(edges, edges[1:]):
        if b - a < GAP:
            continue
        x = (a + b) / 2
        left = [i for i, r in enumerate(boxes) if r[2] <= x]
        right = [i for i, r in enumerate(boxes) if r[0] >= x]
        across = [i for i, r in enumerate(boxes) if r[0] < x < r[2]]
        prose = min(sum(len(boxes[i][4].split()) >= 5 for i in side) for side in (left, right))
        if min(len(left), len(right)) >= SIDE and len(across) <= CROSSING * len(boxes) and prose >= 3:
            rank = (len(across), -min(len(left), len(right)), a - b)
            best = min(best, (rank, x, left, right, across)) if best else (rank, x, left, right, across)
    if best is None:
        return None
    _, x, left, right, across = best
    order: list[int] = []
    rest = left + right
    for mark in [*sorted(across, key=lambda i: boxes[i][1]), None]:
        limit = float("inf") if mark is None else boxes[mark][1]
        band, rest = [i for i in rest if boxes[i][1] < limit], [i for i in rest if boxes[i][1] >= limit]
        for side in ([i for i in band if boxes[i][2] <= x], [i for i in band if boxes[i][0] >= x]):
            inner = reading_order([boxes[i] for i in side], depth + 1)
            order += [side[j] for j in inner] if inner is not None else sorted(side, key=lambda i: (boxes[i][1], boxes[i][0]))
        order += [] if mark is None else [mark]
    return order


def ordered_lines(lines: DataFrame) -> DataFrame:
    """(doc, pagina, n, texto) of boxes (doc, pagina, x0, y0, x1, y1, texto) in reading order; a page
    without columns from top to bottom.  A page's lines are bounded by the page."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        order = reading_order(list(frame[["x0", "y0", "x1", "y1", "texto"]].itertuples(index=False, name=None)))
        out = frame.iloc[order] if order is not None else frame
        return pd.DataFrame({"doc": key[0], "pagina": key[1], "n": range(len(out)), "texto": out["texto"].tolist()})

    rows = lines.where(F.trim("texto") != "")
    return rows.groupBy("doc", "pagina").applyInPandas(one, "doc string, pagina int, n int, texto string")


def split_headings(line: Column, titles: tuple[str, ...]) -> Column:
    """A numbered heading in capitals and the text glued to it as two lines; the composition heading before
    "Cada"; other lines as they are."""
    known = "|".join(sorted((re.escape(t) for t in titles), key=len, reverse=True))
    pattern = rf"^(\s*\d{{1,2}}\s*[.):–—-]\s*(?:{known})\s*(?::|(?=\s\p{{Lu}})))(\s*\S.*)$"
    composition = r"^(.*\bCOMPOSI[ÇC][ÃA]O)\s*:?\s+(Cada\b.*)$"
    pair = lambda p: F.array(F.trim(F.regexp_extract(line, p, 1)), F.trim(F.regexp_extract(line, p, 2)))
    return F.when(line.rlike(composition), pair(composition)).when(line.rlike(pattern), pair(pattern)).otherwise(F.array(line))


def recognition_reason(letters: Column, broken: Column, characters: Column, image_share: Column, letters_in_image: Column, curves: Column) -> Column:
    """Why a page has to be recognised from its image, by its figures; null if it need not: text of broken
    characters, a large image with little text, a part image without text, letters drawn as curves."""
    return (
        F.when(broken > F.greatest(F.lit(10.0), characters * 0.1), "texto_corrompido")
        .when((image_share >= 0.5) & (letters < 200), "imagem_sem_texto_suficiente")
        .when((image_share >= 0.12) & (letters_in_image < 40), "imagem_parcial_sem_texto")
        .when((letters < 40) & (curves >= 50), "texto_vetorial_sem_camada_textual")
    )


def recognition_key(*parts: Column) -> Column:
    """Address of a recognised page in a cache, by everything its text depends on."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def file_name(name: Column, registry: Column) -> Column:
    """Deterministic file name of an entry; null without digits in its registry number, and never one that
    leaves the folder, as it has no separators."""
    digits = F.nullif(F.regexp_replace(F.coalesce(registry, F.lit("")), r"\D", ""), F.lit(""))
    return F.concat(slug(name), F.lit("_"), digits, F.lit("_profissional.pdf"))
