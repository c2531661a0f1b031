"""Helpers the operators share: stored intermediates, words, running sums, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.session import scratch_path

# A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast if counted below ``limit`` rows; otherwise the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= limit else df
