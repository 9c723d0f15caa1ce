"""Command line: identify, relink, extract, summaries, vectors, ask, check."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from marisma.operators import answers, audit, chunks, explain, sections, selections
from marisma.plans import batches
from marisma.schemas import TABLES, schema_differences
from marisma.session import build_session, table
from marisma.sources.tables import write_report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marisma", description=__doc__)
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--report", help="folder for the report; must not exist")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("identify", help="identify pending sources and append the results")
    i.add_argument("--name", action="append", help="only this entry; may be repeated")
    i.add_argument("--limit", type=int)
    i.add_argument("--reprocess", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    r = sub.add_parser("relink", help="actions that bring links up to the catalogue")
    r.add_argument("--name", action="append")
    e = sub.add_parser("extract", help="sections of line documents and their statuses")
    e.add_argument("--lines", type=int, default=60, help="lines of a page")
    s = sub.add_parser("summaries", help="origins with pending summaries")
    s.add_argument("--before", help="also summaries made before this time")
    v = sub.add_parser("vectors", help="chunks of the sources that have no vector")
    v.add_argument("--chunk-size", type=int, default=450)
    v.add_argument("--chunk-overlap", type=int, default=50)
    a = sub.add_parser("ask", help="verdict of a pair, or of one entry")
    a.add_argument("names", nargs="+")
    sub.add_parser("check", help="schema differences and broken references")
    return p


def run(argv: list[str]) -> int:
    """0, or 2 for an invalid question and 4 for an unknown entry."""
    args = parser().parse_args(argv)
    spark = build_session()
    c = answers.Corpus.load(spark, args.data)
    try:
        if args.command == "identify":
            batch = batches.identification(c, names=args.name, reprocess=args.reprocess, limit=args.limit)
            out = batch.report
            if not args.dry_run:
                batches.save(spark, batch, args.data)
        elif args.command == "relink":
            names = c.catalog.where(F.col("nome_normalizado").isin(*args.name)) if args.name else None
            out = batches.relink(c, names)
        elif args.command == "extract":
            lines = sections.line_table(c.source, "nome_normalizado", "trecho_interacoes", args.lines)
            docs = c.source.select(F.col("nome_normalizado").alias("doc"), F.lit(None).cast("string").alias("falha"), F.lit(0).alias("paginas_ocr"))
            out = sections.extraction_status(docs, lines).drop("texto")
        elif args.command == "summaries":
            out = selections.pending_summaries(c, F.lit(args.before).cast("timestamp_ntz") if args.before else None)
        elif args.command == "vectors":
            due = selections.pending_vectors(c.source, table(spark, args.data, "bulas_interacoes_embeddings"))
            out = chunks.sliding_chunks(c.source.join(due, "nome_normalizado", "left_semi"), "nome_normalizado", "trecho_interacoes", args.chunk_size, args.chunk_overlap)
        elif args.command == "ask":
            out = explain.pair_answer(c, *args.names) if len(args.names) == 2 else answers.single_answers(c).where(F.col("nome_normalizado") == explain.known_entry(c, args.names[0]))
        else:
            found = [f"{n}.{col}: {want} expected, {got} found" for n in TABLES for col, want, got in schema_differences(table(spark, args.data, n), n)]
            print("\n".join(found) or "schema as declared")
            out = audit.orphans(c.links, "medicamento_relacionado", c.catalog, "nome_normalizado")
    except explain.InvalidRequest as error:
        print(error, file=sys.stderr)
        return 2
    except explain.UnknownEntry as error:
        print(f"unknown entry: {error}", file=sys.stderr)
        return 4
    if args.report:
        write_report(out.select(*[F.col(x).cast("string") for x in out.columns]), args.report)
    else:
        out.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
