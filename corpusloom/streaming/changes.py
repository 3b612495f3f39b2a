"""File changes as a stream: a source that sees rewrites and deletions, debouncing, and their application."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.ignore import IgnoreRules

SCHEMA = "path string, op string, modified_unix long, seen timestamp"
DEBOUNCE = "500 milliseconds"


class _ChangeReader(SimpleDataSourceStreamReader):
    """Offsets hold the state that was seen, so a restarted query finds what changed meanwhile."""

    def __init__(self, root: str, expression: str):
        self.root, self.rules = root, IgnoreRules(expression)

    def state(self) -> dict[str, list[int]]:
        out = {}
        for folder, names, files in os.walk(self.root):
            rel = os.path.relpath(folder, self.root).replace(os.sep, "/")
            rel = "" if rel == "." else rel + "/"
            names[:] = [n for n in names if not self.rules.ignores(rel + n)]
            for f in files:
                if not self.rules.ignores(rel + f):
                    try:
                        s = os.stat(os.path.join(folder, f))
                    except OSError:
                        continue
                    out[rel + f] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self) -> dict:
        return {"files": self.state()}

    def _rows(self, old: dict, new: dict) -> list[tuple]:
        import datetime

        now = datetime.datetime.now(datetime.UTC)
        rows = [(p, "create" if p not in old else "modify", v[0] // 10**9, now) for p, v in new.items() if old.get(p) != v]
        return rows + [(p, "remove", None, now) for p in old if p not in new]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self.state()
        return iter(self._rows(start["files"], new)), {"files": new}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["files"], end["files"]))


class ChangeSource(DataSource):
    """Options: ``path`` and ``ignore`` (an expression)."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ChangeReader(self.options["path"], self.options["ignore"])


def changes(spark: SparkSession, root: str, rules: IgnoreRules) -> DataFrame:
    """A stream of (path, op, modified_unix, seen); op is create, modify or remove."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("corpusloom_changes").option("path", root).option("ignore", rules.expression).load()


def relevant(stream: DataFrame) -> DataFrame:
    """Changes of text files, and all removals."""
    from corpusloom.functions import paths

    return stream.where(paths.is_text(F.col("path")) | (F.col("op") == "remove"))


def apply(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = DEBOUNCE) -> StreamingQuery:
    """Hand each micro-batch's distinct (path, op) to ``handle``; the trigger is the debounce interval."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("path").agg(F.max_by("op", "seen").alias("op"))
        if not last.isEmpty():
            handle(last, epoch)

    return relevant(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def debounced(events: DataFrame, at: str, item: str, gap: str, watermark: str | None = None, group: list[str] = ()) -> DataFrame:
    """Batches of events with no more than ``gap`` between neighbours: start, end, events and distinct items.

    Works on tables and, with a watermark, on streams.
    """
    e = events.withWatermark(at, watermark) if watermark else events
    g = e.groupBy(F.session_window(at, gap), *group)
    return g.agg(F.count("*").alias("events"), F.approx_count_distinct(item).alias("items") if watermark else F.countDistinct(item).alias("items")).select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *group, "events", "items")


def debounced_globally(events: DataFrame, at: str, gap_seconds: float, slices: str = "day") -> DataFrame:
    """(batch_start, batch_end, events) of one global sequence of events in a table.

    Gaps are found within time slices in parallel; one row per slice decides what continues over a border.
    """
    from pyspark.sql import Window

    s = events.select(F.col(at).alias("t"), F.date_trunc(slices, F.col(at)).alias("slice"))
    w = Window.partitionBy("slice").orderBy("t")
    seconds = lambda c: F.unix_micros(c) / 1e6
    s = s.withColumn("new", F.coalesce((seconds(F.col("t")) - seconds(F.lag("t").over(w)) > gap_seconds).cast("int"), F.lit(0)))
    s = s.withColumn("part", F.sum("new").over(w))
    parts = s.groupBy("slice", "part").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    every = Window.orderBy("a")
    parts = parts.withColumn("id", F.sum(F.coalesce((seconds(F.col("a")) - seconds(F.lag("b").over(every)) > gap_seconds).cast("int"), F.lit(1))).over(every))
    return parts.groupBy("id").agg(F.min("a").alias("batch_start"), F.max("b").alias("batch_end"), F.sum("n").alias("events")).drop("id")
