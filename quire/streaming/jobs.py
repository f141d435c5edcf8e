"""Structured Streaming jobs.

* ``file_stream``: a table's Parquet file(s) as a streaming source.
* ``run_available``: run a query over everything available now
  (``availableNow`` trigger), checkpointed in the shared folder, so a
  restarted job resumes where it stopped.
* ``RollingFold``: the carry-forward fold as a stateful operator
  (``transformWithState``) keyed by document; chunks that arrive out of
  order wait in a map state until their number is next, chunks that arrive
  twice are ignored, and a state that is quiet for too long is dropped by a
  timer, an incomplete document being reported.
* ``write_batch`` / ``current_points``: a point collection as one append-only
  folder per micro-batch, read as the latest version of each id.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.session import scratch_path


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    """A table's Parquet file or part files as a stream."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, as a table may be a folder of part files or a single file
    # and a stream takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path[:-1] + "[t]")


def run_available(stream_df: DataFrame, name: str, sink_path: str | None = None,
                  foreach_batch: Callable | None = None, output_mode: str = "append") -> str:
    """Run until all available input is processed; return the sink path."""
    spark = stream_df.sparkSession
    ckpt = scratch_path(spark, f"{name}-checkpoint")
    w = stream_df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode(output_mode)
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        sink_path = sink_path or scratch_path(spark, f"{name}-sink")
        w = w.format("parquet").option("path", sink_path)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sink_path


# ------------------------------------------------------------- rolling state

ROLLING_OUTPUT = "doc_id long, step int, output string"
OUTPUT_COLUMNS = ["doc_id", "step", "output"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Stateful queries started inside keep their state in RocksDB, as state with
    several variables needs.  A micro-batch commits what it changed, not a
    snapshot of all state."""
    keys = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class RollingFold(StatefulProcessor):
    """The carry-forward fold of one document.

    Input rows: doc_id, chunk_no, n_chunks, chunk.  ``summarise(prev, chunk)``
    gives the next output.  Emits (doc_id, step, output) in chunk order.

    State: ``last`` (the last output), ``next`` (the number awaited, and the
    number of chunks), and ``waiting``, a map from chunk number to the text of
    a chunk that came too early.  A chunk is read and written on its own; what
    waits is never copied.  A chunk that comes again changes nothing.  Of a
    finished document only ``next`` stays, so that late repeats are known;
    with ``quiet_ms`` it goes after that time without a chunk, and so does an
    unfinished document's state, whose missing step is reported as (doc_id,
    step, null).
    """

    def __init__(self, summarise: Callable[[str | None, str], str], quiet_ms: int | None = None):
        self.summarise, self.quiet_ms = summarise, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "output string")
        self.next = handle.getValueState("next", "chunk_no int, total int")
        self.waiting = handle.getMapState("waiting", "chunk_no int", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = (c for pdf in rows for c in zip(pdf["chunk_no"], pdf["n_chunks"], pdf["chunk"]))
        yield pd.DataFrame(self._advance(key, chunks, timerValues), columns=OUTPUT_COLUMNS)

    def _advance(self, key, chunks: Iterator[tuple], timerValues) -> list[tuple]:
        """The outputs that chunks (number, number of all, text) make possible.  Each
        access to the state is a message, so a new document asks only for ``next``."""
        known = self.next.get()
        awaited, total = known or (0, None)
        last, out, fresh = None, [], {}
        for no, n, chunk in chunks:
            total = int(n)
            if int(no) >= awaited:
                fresh[int(no)] = chunk
        waits = bool(known and fresh and self.waiting.exists())
        if awaited and fresh:
            last = self.last.get()
            last = last and last[0]
        start = awaited
        while awaited in fresh or (out and waits and self.waiting.containsKey((awaited,))):
            there = waits and self.waiting.containsKey((awaited,))
            chunk = fresh.pop(awaited) if awaited in fresh else self.waiting.getValue((awaited,))[0]
            if there:
                self.waiting.removeKey((awaited,))
            last = self.summarise(last, chunk)
            out.append((key[0], awaited, last))
            awaited += 1
        for no, chunk in fresh.items():
            self.waiting.updateValue((no,), (chunk,))
        if total is not None and awaited >= total:
            if start:
                self.last.clear()
            if waits or fresh:
                self.waiting.clear()
        elif awaited > start:
            self.last.update((last,))
        if known != (awaited, total):
            self.next.update((awaited, total))
        self._wake(timerValues)
        return out

    def _wake(self, timerValues) -> None:
        """One timer a document: ``quiet_ms`` after its last chunk."""
        if self.quiet_ms is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._dropped(key), columns=OUTPUT_COLUMNS)

    def _dropped(self, key) -> list[tuple]:
        awaited, total = self.next.get() if self.next.exists() else (0, None)
        missing = total is None or awaited < total
        for state in (self.last, self.next, self.waiting):
            state.clear()
        return [(key[0], awaited, None)] if missing else []

    def close(self) -> None:
        pass


class RollingRows(RollingFold):
    """The fold on plain rows: most documents have few chunks, and a pandas frame for
    each costs more than their outputs."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chunks = ((r["chunk_no"], r["n_chunks"], r["chunk"]) for r in rows)
        return map(self._row, self._advance(key, chunks, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return map(self._row, self._dropped(key))

    @staticmethod
    def _row(values: tuple) -> Row:
        return Row(**dict(zip(OUTPUT_COLUMNS, values)))


def rolling_stream(chunk_rows: DataFrame, summarise: Callable[[str | None, str], str], quiet_ms: int | None = None) -> DataFrame:
    """The fold as a stream; start its query inside ``rocksdb_state``.

    ``quiet_ms`` is for queries that keep running.
    """
    mode = "none" if quiet_ms is None else "processingTime"
    return chunk_rows.groupBy("doc_id").transformWithState(RollingRows(summarise, quiet_ms), ROLLING_OUTPUT, "append", mode)


# -------------------------------------------------------- point collection


def write_batch(points: DataFrame, root: str, batch_id: int) -> None:
    """Write a micro-batch of points as a folder of its own.  A replayed batch
    overwrites only itself; nothing else is read or rewritten."""
    points.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")


def current_points(spark: SparkSession, root: str, schema: str, id_col: str = "id", version_col: str | None = None) -> DataFrame:
    """The collection as of now: one row per id, the highest version, then the
    latest batch."""
    from quire.operators.vector import latest_by_id

    points = spark.read.schema(f"{schema}, batch long").option("basePath", root).parquet(root)
    order = ([version_col] if version_col else []) + ["batch"]
    return latest_by_id(points, id_col, order).drop("batch")
