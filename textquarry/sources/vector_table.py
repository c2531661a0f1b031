"""A snippet table on Parquet: upsert by id, cleaned reads, nearest-neighbour search.

Rows lie in folders by a hash bucket of their id. An upsert rewrites the buckets of the ids that it adds or changes, by dynamic partition
overwrite, and touches no other file. One writer at a time.

    <path>/properties            dim, metric, buckets
    <path>/rows/bucket=N         rows, unique by id
    <path>/versions/version=N    one mark per upsert
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textquarry.functions.embedding import DEFAULT_DIM, checked_dim
from textquarry.operators.upsert import clean_on_read, one_row, unchanged, with_id
from textquarry.operators.vector_search import DEFAULT_K, search
from textquarry.schemas import SNIPPET
from textquarry.session import stored

METRIC = "cosine"
# Buckets of a new table: a batch of fewer ids than there are leaves most of the table alone.
BUCKETS = 16
# Rows of one file of a bucket, about.
FILE_ROWS = 500_000
_STORED = T.StructType([*SNIPPET.fields, T.StructField("bucket", T.IntegerType())])


class VectorTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @classmethod
    def ensure(cls, spark: SparkSession, path: str, dim: int | None = None, buckets: int = BUCKETS) -> "VectorTable":
        """Open the table, creating it if there is none. A table of another dimension than the one asked for is an error. ``buckets``
        counts when the table is made; it should grow with the rows expected, to some 100,000 a bucket."""
        table = cls(spark, path)
        found = table._properties()
        if found is None:
            spark.createDataFrame([], _STORED).write.mode("append").partitionBy("bucket").parquet(f"{table.path}/rows")
            spark.createDataFrame([(dim or DEFAULT_DIM, METRIC, buckets)], "dim int, metric string, buckets int").coalesce(1).write.mode(
                "overwrite").parquet(f"{table.path}/properties")
        elif dim is not None and dim != found["dim"]:
            raise ValueError(f"{path} holds vectors of dimension {found['dim']}, not {dim}")
        return table

    def _properties(self):
        try:
            return self.spark.read.parquet(f"{self.path}/properties").first()
        except AnalysisException:
            return None

    @property
    def dim(self) -> int:
        return self._properties()["dim"]

    @property
    def version(self) -> int:
        """Upserts so far."""
        try:
            return self.spark.read.parquet(f"{self.path}/versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def register(self, name: str) -> None:
        """Make the table known to the session's catalog, with its properties; later upserts show there after another call."""
        p = self._properties()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _STORED)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (bucket) LOCATION '{self.path}/rows' "
                       f"TBLPROPERTIES ('dim' = '{p['dim']}', 'metric' = '{p['metric']}', 'buckets' = '{p['buckets']}')")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.catalog.refreshTable(name)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self._properties()["buckets"])).cast("int")

    def upsert(self, snips: DataFrame) -> int:
        """Insert or replace by id. Rows without embedding are skipped, empty ids are derived. Returns the table's version.

        Of equal ids within one batch the row of the highest ``seq`` stays, if the rows have that column; of the same seq, or without it, the
        row whose content, path and other values come last in order. So a repeated or retried upsert leaves the same table.
        """
        batch = with_id(snips.filter(F.col("embedding").isNotNull())).withColumn("embedding", checked_dim(F.col("embedding"), self.dim))
        seq = F.col("seq") if "seq" in snips.columns else F.lit(0)
        batch = stored(batch.select(*SNIPPET.fieldNames(), seq.alias("seq")), "batch")
        new = one_row(batch).select(*SNIPPET.fieldNames())
        # Rows that the table has already need no writing.
        buckets = new.select(self._bucket().alias("bucket")).distinct().collect()  # a row per bucket
        there = self._rows().filter(F.col("bucket").isin([r["bucket"] for r in buckets])).drop("bucket")
        same = stored(unchanged(there, new), "unchanged")
        new = new.join(same, "id", "left_anti").withColumn("bucket", self._bucket())
        sizes = new.groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row per bucket
        touched = [r["bucket"] for r in sizes]
        if touched:
            old = self._rows().filter(F.col("bucket").isin(touched))
            stays = old.join(new.select("id"), "id", "left_anti")
            parts = max(1, -(-(stays.count() + sum(r["n"] for r in sizes)) // (FILE_ROWS * len(touched))))
            # Buckets are replaced when all their new files are written, so they can be read until then.
            (stays.unionByName(new).repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows"))
        version = self.version + 1
        self.spark.createDataFrame([(version,)], "version int").select(F.col("version").alias("number")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/versions/version={version}")
        return version

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return clean_on_read(self._rows().drop("bucket"))

    def compact(self) -> None:
        """Nothing is left to fold: an upsert leaves one row per id in its buckets."""

    def search(self, queries: DataFrame, k: int = DEFAULT_K, where: Column | None = None) -> DataFrame:
        """``queries``: query_id, embedding[, k]. Hits with rank, score and the snippet, without its vector. ``where`` is a condition on the
        rows, their metadata among them; only rows that meet it are scored, so there are k hits if so many do."""
        payload = [c for c in SNIPPET.fieldNames() if c not in ("id", "embedding")]
        rows = self.read()
        return search(queries, rows if where is None else rows.filter(where), k, payload=payload)
