"""Following a chain's head (S07): a streaming source of work ranges with offsets of its own.

The source's latest offset is min(head, head - buffer + window), so a height that is held back now belongs to a later batch, and
Spark's checkpoint knows how far a stream has got. Its rows are ranges of numbers; the blocks of a batch are then read by Spark's
own scan of that interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

LOCAL_CHAIN, WINDOW, LOCAL_WINDOW = 31337, 10, 100


def window_of(chain_id: int) -> int:
    """How far beyond the safe height a chain is followed."""
    return LOCAL_WINDOW if chain_id == LOCAL_CHAIN else WINDOW


def publish_head(spark: SparkSession, path: str, head: int) -> int:
    """Write the head's height to a file that the source reads; a head that falls leaves it as it is. The published height."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        stream = fs.open(p)
        try:
            head = max(head, int(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    out = fs.create(p, True)
    try:
        out.write(bytearray(str(head).encode()))
    finally:
        out.close()
    return head


def _source() -> type[DataSource]:
    """The source's class. It is made here so that it travels by value: the process that plans a batch need not have this package."""

    class Range(InputPartition):
        def __init__(self, low: int, high: int):
            self.low, self.high = low, high

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.head, self.start, self.step = options["head"], int(options.get("start", 0)), int(options.get("step", 50)) + 1
            self.buffer, self.window = int(options.get("buffer", 0)), int(options.get("window", 10))

        def initialOffset(self) -> dict:  # noqa: N802
            return {"next": self.start}

        def latestOffset(self) -> dict:  # noqa: N802
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.head) if ":" in self.head else (fs.LocalFileSystem(), self.head)
            with store.open_input_stream(path) as f:
                head = int(f.read())
            return {"next": max(self.start, min(head, head - self.buffer + self.window) + 1)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            many = 1000 * self.step  # ranges of a task
            return [Range(a, min(a + many, end["next"]) - 1) for a in range(start["next"], end["next"], many)]

        def read(self, partition):
            for a in range(partition.low, partition.high + 1, self.step):
                yield a, min(a + self.step - 1, partition.high)

        def commit(self, end: dict) -> None:
            pass

    class Tail(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ledger_tail"

        def schema(self) -> str:
            return "range_start long, range_end long"

        def streamReader(self, schema):  # noqa: N802
            return Reader(self.options)

    return Tail


def tail_ranges(spark: SparkSession, head: str, *, start: int = 0, buffer: int = 0, window: int = WINDOW, step: int = 50) -> DataFrame:
    """A stream of ranges (range_start, range_end, both included) up to min(head, head - buffer + window). head: the path of publish_head()."""
    spark.dataSource.register(_source())
    options = {"head": head, "start": start, "buffer": buffer, "window": window, "step": step}
    return spark.readStream.format("ledger_tail").options(**options).load()


def follow(ranges: DataFrame, blocks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, number: str = "number") -> StreamingQuery:
    """What has become due of a stream of ranges: the blocks of each batch's interval go to sink(rows, batch_id). A batch's ranges are one interval, so its bounds reach the scan."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ends = batch.agg(F.min("range_start").alias("low"), F.max("range_end").alias("high")).head()
        if ends.low is not None:
            sink(blocks.where(F.col(number).between(ends.low, ends.high)), batch_id)

    return ranges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
