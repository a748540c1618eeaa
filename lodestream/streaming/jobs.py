"""Streaming twins of what the batch jobs keep between runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestream.operators.star import import_batch
from lodestream.sources.store import shared_path


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table as a stream. A path that is one file can't be a stream's folder, but a pattern that only it matches can."""
    stem, dot, end = path.rpartition(".")
    pattern = f"{stem[:-1]}[{stem[-1]}].{end}" if dot else path
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, then read what it wrote."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first of each key within the watermark; later rows than that are dropped. ``ts``: without zone, read as UTC."""
    return stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")


def window_counts(stream: DataFrame, ts: str, size: str, delay: str, by: str) -> DataFrame:
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


class BatchLog:
    """Which deliveries a table has taken, and where its present version stands.

    Each version is a folder of its own; a row of the log names the delivery and the
    version that holds all up to it. The row is the last thing written, in one file,
    so a delivery counts as a whole or not at all: what a broken one left behind is
    never read, and one that is in the log changes nothing when it comes again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> list:
        """(batch, version), a row for each delivery, in order."""
        try:
            return self.spark.read.schema("batch long, version string").json(f"{self.path}/log").orderBy("batch").collect()
        except AnalysisException:  # no log yet
            return []

    def take(self, batch: int, version: str) -> None:
        self.spark.createDataFrame([(batch, version)], "batch long, version string").coalesce(1).write.mode("append").json(f"{self.path}/log")


def import_stream(stream: DataFrame, path: str, star: dict[str, DataFrame], payload: Callable[[DataFrame], dict[str, DataFrame]], prefix: str = "COL", state: str | None = None) -> None:
    """Import each micro-batch as a delivery into the star kept under ``path``, as ``star.import_batch`` does.

    ``star``: what the tables hold before the first delivery; ``payload`` makes
    articles, analyses and insights of a micro-batch. A micro-batch that runs again,
    also after a failure half way or with a new ``state`` folder, finds itself in the
    log and changes nothing.
    """
    spark, log = stream.sparkSession, BatchLog(stream.sparkSession, path)

    def put(batch: DataFrame, number: int) -> None:
        taken = log.rows()
        if any(r["batch"] == number for r in taken):
            return
        now = read_star(spark, path, taken) or star
        version = f"v{number}-{uuid.uuid4().hex}"
        made = import_batch(now, payload(batch), f"{prefix}-{number}")
        for name, table in made.items():
            table.write.parquet(f"{path.rstrip('/')}/{version}/{name}")
        log.take(number, version)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", state or shared_path(spark, "import-state")).trigger(availableNow=True).start()
    q.awaitTermination()


def read_star(spark: SparkSession, path: str, taken: list | None = None) -> dict[str, DataFrame] | None:
    """The star's tables after the last delivery in the log; None before the first."""
    taken = BatchLog(spark, path).rows() if taken is None else taken
    if not taken:
        return None
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{taken[-1]['version']}/{name}") for name in TABLES}


TABLES = ("articles", "analyses", "insights", "links", "batches")
#: Failures that are moved from one list to the other at once.
CHUNK = 1000


class Health(StatefulProcessor):
    """Failures of a source since its last success, by time, however micro-batches cut or mix them.

    Their times stand in a list of the state store; when a later success comes, what
    is left is copied in pieces to a second list, which takes its place. A worker holds a frame or a piece.
    """

    def __init__(self, source: str, ts: str, status: str, tie: str):
        self.source, self.ts, self.status, self.tie = source, ts, status, tie

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at timestamp, tie long, failures long, side int")
        self.lists = [handle.getListState(f"failures{i}", "at timestamp, tie long") for i in (0, 1)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at, tie, failures, side = self.last.get() if self.last.exists() else (None, None, 0, 0)
        seen, newest = 0, (at, tie) if at is not None else None
        for f in rows:
            seen += len(f)
            good = f[f[self.status] == "success"]
            if len(good):
                top = good.sort_values([self.ts, self.tie]).iloc[-1]
                here = (top[self.ts].to_pydatetime(), int(top[self.tie]))
                newest = here if newest is None else max(newest, here)
            bad = f[f[self.status] != "success"]
            later = [x for x in zip((t.to_pydatetime() for t in bad[self.ts]), bad[self.tie].astype(int).tolist(), strict=True) if newest is None or x > newest]
            if later:
                self.lists[side].appendList(later)
                failures += len(later)
        if newest is not None and newest != ((at, tie) if at is not None else None) and failures:
            failures, piece, other = 0, [], 1 - side
            for x in self.lists[side].get():
                if (x[0], x[1]) > newest:
                    piece.append((x[0], x[1]))
                    failures += 1
                    if len(piece) == CHUNK:
                        self.lists[other].appendList(piece)
                        piece = []
            if piece:
                self.lists[other].appendList(piece)
            self.lists[side].clear()
            side = other
        self.last.update((*(newest or (None, None)), failures, side))
        yield pd.DataFrame({self.source: [key[0]], "failures": [failures], "rows": [seen]})

    def close(self) -> None:
        pass


def health_stream(stream: DataFrame, source: str, ts: str, status: str, tie: str) -> DataFrame:
    """Run length of failures of each source, kept as state in RocksDB; one row for each source and micro-batch. ``ts``: a time, ``tie``: a number that orders equal times."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    slim = stream.select(source, ts, status, tie)
    return slim.groupBy(source).transformWithStateInPandas(Health(source, ts, status, tie), f"{source} long, failures long, rows long", "Update", "None")
