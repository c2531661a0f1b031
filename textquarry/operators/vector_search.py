"""Nearest neighbours by cosine: exact, and within learned cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textquarry.operators.cells import RECALL, search_cells
from textquarry.operators.topk import DenseVectors, HashedText, top_k

# Hits per chat turn and per search call.
CHAT_K = 3
DEFAULT_K = 5


def search(queries: DataFrame, table: DataFrame, k: int = DEFAULT_K, payload: list[str] | None = None,
           column: str = "embedding") -> DataFrame:
    """Exact nearest rows by cosine. ``queries``: query_id, embedding[, k]; ``table``: id, embedding."""
    return top_k(queries, table, DenseVectors(column), k, payload)


def search_text(queries: DataFrame, table: DataFrame, k: int = DEFAULT_K, payload: list[str] | None = None,
                column: str = "text", dim: int = 1536) -> DataFrame:
    """Exact nearest texts under the built-in embedder. ``queries``: query_id, text[, k]."""
    return top_k(queries, table, HashedText(column, dim), k, payload)


def search_buckets(queries: DataFrame, table: DataFrame, k: int = DEFAULT_K, payload: list[str] | None = None,
                   column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """Approximate nearest rows: only rows in the learned cells nearest to the query are scored, see ``cells``.

    Looks into as many cells as ``recall`` takes in a sample; vectors without clusters take many. Hot cells are cut into
    bounded parts, and within a cell nothing is left out. A per-query ``k`` in ``queries`` counts. ``search`` is exact.
    """
    return search_cells(queries, table, k, payload, column, recall)
