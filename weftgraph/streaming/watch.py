"""Freshness as a stream: file events in micro-batches, each applied once to the stored graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.artifacts import relevant

DEBOUNCE = "2 seconds"


def file_events(spark: SparkSession, landing: str, per_batch: int = 1000) -> DataFrame:
    """Events(path, modified) of files that appear below a folder."""
    got = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(landing)
    return got.select("path", F.col("modificationTime").alias("modified"))


def change_events(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Events from appended Parquet files, for feeds that write their own change log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def burst(batch: DataFrame, path: str = "path") -> DataFrame:
    """The distinct relevant paths of one burst, in order."""
    return batch.select(path).where(relevant(F.col(path))).distinct().orderBy(path)


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, path: str = "path", once: bool = False) -> StreamingQuery:
    """Apply each burst of paths; a batch number that was applied before a failure is skipped by an idempotent ``apply``.

    With ``once`` all that has arrived is processed and the query ends; otherwise bursts are gathered for DEBOUNCE.
    """

    def go(batch: DataFrame, number: int) -> None:
        apply(burst(batch, path), number)

    w = events.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=DEBOUNCE)).start()


class Revision:
    """A stored table that batches replace file by file, with the number of the last batch applied.

    Each batch writes the next version beside the current one and then adds a pointer file, of which the last counts, so readers see whole versions and a batch that
    is replayed after a failure finds its number and does nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> tuple[int, int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        whole = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(p)) if n.isdigit()) if fs.exists(p) else []
        if not whole:
            return -1, -1
        row = self.spark.read.text(f"{self.root}/pointers/{whole[-1]}").first()[0].split(" ")
        return int(row[0]), int(row[1])

    def _move(self, version: int, batch: int) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        # each move writes a pointer of its own, under its version, and only a whole one gets its final name: a crash leaves the last
        name = f"{self.root}/pointers/{version:012d}"
        new, at = jvm.org.apache.hadoop.fs.Path(f"{name}.new"), jvm.org.apache.hadoop.fs.Path(name)
        fs = at.getFileSystem(conf)
        out = fs.create(new, True)
        out.write(bytearray(f"{version} {batch}\n".encode()))
        out.close()
        fs.rename(new, at)
        for f in fs.listStatus(at.getParent()):
            old = f.getPath().getName()
            if old.isdigit() and int(old) < version - 1:
                fs.delete(f.getPath(), False)

    @property
    def number(self) -> int:
        """The monotone revision counter."""
        return self._pointer()[0]

    def read(self) -> DataFrame | None:
        v, _ = self._pointer()
        return None if v < 0 else self.spark.read.parquet(f"{self.root}/v{v}")

    def prune(self, keep: int = 8) -> int:
        """Remove all versions but the ``keep`` newest; how many were removed. The current one always stays."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = 0
        for v in range(max(0, self.number - keep + 1)):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{v}")
            fs = p.getFileSystem(conf)
            if fs.exists(p):
                fs.delete(p, True)
                gone += 1
        return gone

    def bootstrap(self, rows: DataFrame) -> None:
        """The full rebuild before a stream starts."""
        v, _ = self._pointer()
        rows.write.mode("overwrite").parquet(f"{self.root}/v{v + 1}")
        self._move(v + 1, -1)

    def replace(self, paths: DataFrame, rows: DataFrame, batch: int, key: str = "file_path") -> bool:
        """Rows of the given files give way to new ones; False if the batch was applied already."""
        v, last = self._pointer()
        if batch <= last:
            return False
        old = self.read()
        kept = rows if old is None else old.join(paths.select(F.col(paths.columns[0]).alias(key)), key, "left_anti").unionByName(rows, allowMissingColumns=True)
        kept.write.mode("overwrite").parquet(f"{self.root}/v{v + 1}")
        self._move(v + 1, batch)
        return True


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window, with a watermark when streaming."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
