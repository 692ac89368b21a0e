"""Live indexing: changes of a tree are read as a stream, and whatever changes the tree as a whole is built."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming.snapshot import NOTHING, LiveSnapshot


class Published:
    """The fingerprint of the snapshot that was published last, kept in a file beside the stream's checkpoint, so that a restart knows it."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.at = spark, f"{checkpoint.rstrip('/')}-published"
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        return self.spark.read.text(self.at, wholetext=True).first()[0] if self.fs.exists(self.path) else None

    def write(self, value: str) -> None:
        out = self.fs.create(self.path, True)
        out.write(bytearray(value.encode()))
        out.close()


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, build: Callable[[DataFrame, int], None], every: str | None = None, least: float = 0.0, current: Callable[[], DataFrame] | None = None, tries: int = 3, buckets: int = 64) -> StreamingQuery:
    """Keep the live state of a tree from parquet files of its changes in folder, and run build(files, batch) over all its files when they have changed.

    Changes (path, content, and if given modified_at, nth, deleted) are merged into a LiveSnapshot beside the checkpoint; files has path and content
    of every file that is there, so what was deleted is in no later build. A snapshot whose hash is that of the one published last isn't built, also after a restart. With `every`, batches are that far apart;
    without it, what is there is built and the stream ends. `least` seconds lie between the ends of builds at least. `current` lists the whole tree
    as it is now: the state is made what it says after a build, before that is published, and once more after it; if it differed the build is superseded, and
    what is there now is built in its place, up to `tries` times.
    """
    published, ended, live = Published(spark, checkpoint), [0.0], LiveSnapshot(spark, f"{checkpoint.rstrip('/')}-state", buckets)

    def each(batch: DataFrame, number: int) -> None:
        now = live.apply(batch, number)
        for _ in range(tries):
            if now.fingerprint == (published.read() or NOTHING):
                return
            time.sleep(max(0.0, ended[0] + least - time.monotonic()))
            build(live.files(now.revision).select("path", "content"), number)
            ended[0] = time.monotonic()
            later = live.reconcile(current()) if current else now
            if later.fingerprint == now.fingerprint:
                published.write(now.fingerprint)
                later = live.reconcile(current()) if current else now
                if later.fingerprint == now.fingerprint:
                    return
            now = later
        raise RuntimeError("the files change faster than they are built")

    stream = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def event_bursts(events: DataFrame, quiet: str, late: str) -> DataFrame:
    """Bursts of a stream of events (ts, user_id), ended by `quiet`; events later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("ends_at"), "n")
