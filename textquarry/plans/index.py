"""Files to a searchable table: classify, cut, embed, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.functions.embedding import embed_with, hashed_unit
from textquarry.functions.text import MAX_FILE_BYTES, MAX_SNIPPET_BYTES
from textquarry.operators.snippets import Parser, go_declarations, snippets, with_embedding_text
from textquarry.session import spread
from textquarry.sources.vector_table import VectorTable
from textquarry.sources.workspace import read_workspace


def embedded_snippets(files: DataFrame, model=None, dim: int = 1536, parser: Parser = go_declarations, max_bytes: int = MAX_SNIPPET_BYTES,
                      max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """FILE rows to SNIPPET rows with vectors, 100 texts per model call. Long files go on in further snippets of up to ``max_bytes``."""
    cut = with_embedding_text(snippets(spread(files), parser, max_bytes, max_file_bytes=max_file_bytes))
    text = F.col("embedding_text")
    vector = embed_with(model, text) if model else hashed_unit(text, dim)
    return cut.withColumn("embedding", vector).drop("embedding_text")


def index_files(files: DataFrame, table: VectorTable, model=None, parser: Parser = go_declarations, max_bytes: int = MAX_SNIPPET_BYTES,
                max_file_bytes: int = MAX_FILE_BYTES) -> int:
    """Index FILE rows into the table; running it again writes the same ids. Returns the version."""
    return table.upsert(embedded_snippets(files, model, table.dim, parser, max_bytes, max_file_bytes))


def index_directory(spark: SparkSession, root: str, table: VectorTable, model=None,
                    parser: Parser = go_declarations, max_bytes: int = MAX_SNIPPET_BYTES, max_file_bytes: int = MAX_FILE_BYTES) -> int:
    """Index every file below a directory all workers can read; unusable files are left out. ``index_summary(read_workspace(...))`` names them."""
    return index_files(read_workspace(spark, root, max_file_bytes), table, model, parser, max_bytes, max_file_bytes)
