"""Insert-or-replace by id, read-side cleaning, and text upserts with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textquarry.functions.embedding import embed_or_reason, hashed_unit
from textquarry.functions.text import snippet_id
from textquarry.session import stored

METADATA_MARK = "\n\n--- Metadata ---\n"


def newest_by_id(rows: DataFrame, order: str = "version") -> DataFrame:
    """Per id, the row with the highest ``order``.

    The rank filter is applied before the shuffle too, so an id repeated in many
    rows sends one row per task.
    """
    newest = Window.partitionBy("id").orderBy(F.desc(order))
    return rows.withColumn("newest", F.row_number().over(newest)).filter("newest = 1").drop("newest")


def newest_row(snips: DataFrame) -> DataFrame:
    """Per id, the row of the highest ``seq``, of those the last by its values; combined in the tasks before the shuffle."""
    values = [c for c in snips.columns if c not in ("id", "seq", "metadata")]
    # Maps cannot be compared; their sorted entries can.
    entries = F.array_sort(F.map_entries("metadata"))
    best = F.max(F.struct("seq", *values, entries.alias("entries")))
    out = snips.groupBy("id").agg(best.alias("best"))
    return out.select("id", *[F.col(f"best.{c}").alias(c) for c in values], F.when(
        F.col("best.entries").isNotNull(), F.map_from_entries("best.entries")).alias("metadata"))


def one_row(snips: DataFrame) -> DataFrame:
    """``newest_row`` of stored rows; only rows whose id comes more than once are shuffled."""
    repeated = stored(snips.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    single = snips.join(repeated, "id", "left_anti").drop("seq")
    single = single.withColumn("metadata", F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    return single.unionByName(stored(newest_row(snips.join(repeated, "id", "left_semi")), "newest"))


def fingerprint(snips: DataFrame) -> list[Column]:
    """Two hashes of a row's values, its metadata by sorted entries."""
    others = [F.array_sort(F.map_entries(c)).alias(c) if c == "metadata" else F.col(c) for c in sorted(snips.columns) if c != "embedding"]
    # A list of values and names, so that absent and empty ones differ.
    return [F.xxhash64(F.lit(seed), F.to_json(F.struct(*others)), "embedding", F.size("embedding")).alias(f"h{seed}") for seed in (1, 2)]


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id`` of the rows that both have with the same values. Only ids and hashes are shuffled."""
    return old.select("id", *fingerprint(old)).join(new.select("id", *fingerprint(new)), ["id", "h1", "h2"], "left_semi").select("id")


def upsert_latest(old: DataFrame, new: DataFrame, order: str = "version") -> DataFrame:
    """``old`` with ``new`` inserted or replacing by id; new rows without embedding are skipped."""
    return newest_by_id(old.unionByName(new.filter(F.col("embedding").isNotNull())), order)


def with_id(snips: DataFrame) -> DataFrame:
    """Fill empty ids from path, line and content."""
    derived = snippet_id(F.col("file_path"), F.col("start_line"), F.col("content"))
    return snips.withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), derived))


def clean_on_read(snips: DataFrame) -> DataFrame:
    """Drop empty symbols and empty metadata values."""
    return (snips.withColumn("symbols", F.filter("symbols", lambda s: s != ""))
            .withColumn("metadata", F.map_filter("metadata", lambda k, v: v != "")))


def text_id(text: Column, metadata: Column) -> Column:
    """Id of a text stored without a file: equal texts with other metadata are other texts."""
    return snippet_id(F.lit(""), F.lit(0).cast("long"), fallback_text(text, metadata))


def fallback_name(text: Column, metadata: Column) -> Column:
    return F.concat(F.lit("vector_store_fallback_"), F.sha2(fallback_text(text, metadata), 256), F.lit(".txt"))


def embed_texts(texts: DataFrame, model=None, column: str = "text_content") -> DataFrame:
    """Add ``embedding`` by the user's model (null where it fails), or by the built-in embedder."""
    text = F.col(column)
    return texts.withColumn("embedding", embed_or_reason(model, text)["embedding"] if model else hashed_unit(text))


def text_snippets(texts: DataFrame) -> DataFrame:
    """``texts``: text_content, metadata, embedding -> SNIPPET rows without path, lines or symbols."""
    nowhere, line = F.lit(""), F.lit(0).cast("long")
    return texts.select(
        text_id(F.col("text_content"), F.col("metadata")).alias("id"), F.col("text_content").alias("content"),
        nowhere.alias("file_path"), line.alias("start_line"), line.alias("end_line"),
        F.array().cast("array<string>").alias("symbols"), "embedding", "metadata")


def fallback_text(text: Column, metadata: Column) -> Column:
    """The text, then its metadata as sorted ``key: value`` lines if there is any."""
    lines = F.transform(F.array_sort(F.map_entries(metadata)),
                        lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")))
    return F.when(F.size(metadata) > 0, F.concat(text, F.lit(METADATA_MARK), F.array_join(lines, ""))).otherwise(text)


def is_embedded(embedding: Column) -> Column:
    return F.coalesce(F.size(embedding) > 0, F.lit(False))


def fallback_files(texts: DataFrame) -> DataFrame:
    """Texts without a usable vector as fallback files: filename, content."""
    return texts.filter(~is_embedded(F.col("embedding"))).select(
        fallback_name(F.col("text_content"), F.col("metadata")).alias("filename"), fallback_text(F.col("text_content"), F.col("metadata")).alias("content"))


def fallback_docs(files: DataFrame) -> DataFrame:
    """Fallback files found in the root of a file table: filename, content."""
    return files.filter(F.col("path").rlike(r"^vector_store_fallback_[^/]*\.txt$")).select(
        F.col("path").alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
