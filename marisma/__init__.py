"""marisma: Spark-first analytics over evidence-linked relation data."""

from marisma.session import build_session

__all__ = ["build_session"]
