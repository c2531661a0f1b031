"""Streams of chat turns and of files: micro-batches through the batch plans, conversations with state across them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textquarry.operators.context import context_of, enrich
from textquarry.operators.postings import SparseIndex
from textquarry.operators.vector_search import CHAT_K
from textquarry.plans.chat import prompts, user_queries
from textquarry.plans.index import index_files
from textquarry.plans.search import PAYLOAD
from textquarry.sources.vector_table import VectorTable


def enrich_stream(turns: DataFrame, snippets: DataFrame | SparseIndex, out: str, checkpoint: str, model=None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Arriving turns leave as prompts under ``out``, one folder per batch.

    ``snippets``: SNIPPET rows, all of which every micro-batch is compared with, or an index of them (text: content), of which a micro-batch reads
    what its words and hits ask for. A batch run again after a failure overwrites its own folder.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if isinstance(snippets, SparseIndex):
            queries = user_queries(batch)
            hits = snippets.search(queries.select("query_id", "text"), CHAT_K, PAYLOAD)
            made = enrich(queries, context_of(hits)).drop("query_id")
        else:
            made = prompts(batch, snippets, model)
        made.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def index_stream(files: DataFrame, table: VectorTable, checkpoint: str, model=None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Arriving files are cut, embedded and upserted; ids come from content, so a repeat changes nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        index_files(batch, table, model)

    return (files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MESSAGE = "turn bigint, role string, text string"


class LastMessages(StatefulProcessor):
    """Per conversation the last ``n`` messages; every arriving message leaves with those before it."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))[["turn", "role", "text"]].astype(object)
        arrived = arrived.where(arrived.notna(), None)
        new = sorted(arrived.itertuples(index=False, name=None), key=_order)
        known = sorted((tuple(x) for x in self.kept.get()), key=_order)
        out, at = [], 0
        for message in new:
            # A late message is given those before it that are still kept.
            while at < len(known) and _order(known[at]) <= _order(message):
                at += 1
            before = known[max(0, at - self.n):at]
            out.append((key[0], *message, [dict(zip(("turn", "role", "text"), m)) for m in before]))
            known.insert(at, message)
        self.kept.put(known[-self.n:] if self.n else [])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history"])

    def close(self) -> None:
        pass


def _order(message: tuple) -> tuple:
    """By turn, role, text; nulls first, texts by code point."""
    return tuple((x is not None, x) if x is not None else (False, 0) for x in message)


@contextmanager
def _rocksdb(spark: SparkSession):
    """State in RocksDB for queries started inside; the setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def history_stream(turns: DataFrame, n: int, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Arriving turns (conv_id, turn, role, text) leave with ``history``, the ``n`` messages before them, oldest first, as Parquet under ``out``.

    The last ``n`` messages of every conversation are kept from micro-batch to micro-batch, so that turns arriving in order have the history that
    ``history_before_turn`` gives; nothing that left is changed by a turn that arrives late. A conversation's messages of one
    micro-batch meet in a task: bound the micro-batch at the source.
    """
    kind = dict(turns.dtypes)["conv_id"]
    with_history = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithStateInPandas(
        LastMessages(n), f"conv_id {kind}, turn bigint, role string, text string, history array<struct<{_MESSAGE.replace(' ', ':').replace(',:', ',')}>>",
        "Append", "None")
    with _rocksdb(turns.sparkSession):
        return (with_history.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
