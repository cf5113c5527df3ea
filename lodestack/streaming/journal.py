"""The change journal as a stream: micro-batches applied to a change table, gaps that force a rescan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack import schemas
from lodestack.operators.change_table import ChangeTable, journal_changes
from lodestack.session import Scratch

#: Fixed value: seconds between two snapshots.
DEBOUNCE = 5.0
#: Fixed value: a jump of more than this between two records of a volume is a gap.
GAP = 1_000_000


def read_journal(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The journal's files as they arrive."""
    return spark.readStream.schema(schemas.USN_RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def gaps(records: DataFrame, committed: DataFrame, threshold: int = GAP) -> DataFrame:
    """(volume, expected, actual) of volumes whose records of a batch begin more than `threshold` after what was
    committed (volume, next_usn); volumes not yet committed have none."""
    first = records.groupBy("volume").agg(F.min("usn").alias("actual"))
    both = first.join(committed.select("volume", F.col("next_usn").alias("expected")), "volume")
    return both.where(F.col("actual") - F.col("expected") > threshold).select("volume", "expected", "actual")


class JournalMonitor:
    """Applies a journal to a change table batch by batch. The table and where its journals end are kept in a folder, by
    default in that of the stream's checkpoint, and are committed with the number of the batch: a monitor made anew over the same
    checkpoint goes on where the last one stopped. A restarted batch is recognised by its number and a record that is
    delivered again changes nothing, so delivery at least once is enough."""

    def __init__(
        self, spark: SparkSession, rescan: Callable[[DataFrame], None] | None = None,
        sink: Callable[[DataFrame], None] | None = None, debounce: float = DEBOUNCE, folder: str | None = None,
    ):
        """rescan: called with the volumes of a gap. sink: called with the current files, at most every `debounce` seconds
        while changes arrive, and when the monitor stops."""
        self.spark, self.rescan = spark, rescan
        self._table = ChangeTable(spark, folder) if folder else None
        self.states: dict[str, str] = {}
        self.query: StreamingQuery | None = None
        self.sink, self.debounce, self.written, self.dirty = sink, debounce, 0.0, False

    @property
    def table(self) -> ChangeTable:
        if self._table is None:  # batches without a stream
            self._table = ChangeTable(self.spark, Scratch(self.spark, "journal").root)
        return self._table

    @property
    def next_usn(self) -> dict[str, int]:
        """By volume, where the next record is expected."""
        return self.table.notes.get("next_usn", {})

    @property
    def last_batch(self) -> int:
        return self.table.notes.get("last_batch", -1)

    @property
    def batch_size(self) -> int:
        """Records of the last batch."""
        return self.table.notes.get("batch_size", 0)

    def flush(self) -> None:
        """Hand the current files to the sink if anything changed since it last had them."""
        if self.sink is not None and self.dirty:
            self.sink(self.table.current())
            self.written, self.dirty = time.monotonic(), False

    def apply(self, records: DataFrame, batch: int) -> None:
        if batch <= self.last_batch:
            return
        spark = records.sparkSession
        # one row per volume: the volumes of a machine
        ends = records.groupBy("volume").agg(F.min("usn"), F.max("usn"), F.max("record_length"), F.count("*")).collect()
        size = sum(r[4] for r in ends)
        ends = [r[:4] for r in ends if r[0] is not None and r[1] is not None]
        known = self.next_usn
        lost = [v for v, low, _, _ in ends if v in known and low - known[v] > GAP]
        for volume in lost:
            self.states[volume] = "rescanning"
        if lost and self.rescan:
            self.rescan(spark.createDataFrame([(v,) for v in lost], "volume string"))
        following = known | {volume: max(known.get(volume, 0), high + (length or 0)) for volume, _, high, length in ends}
        self.table.apply(journal_changes(records), notes={"next_usn": following, "last_batch": batch, "batch_size": size})
        self.states.update({volume: "active" for volume, _, _, _ in ends})
        self.dirty = True
        if time.monotonic() - self.written >= self.debounce:
            self.flush()

    def start(self, stream: DataFrame, checkpoint: str, continuous: bool = False, every: str = "5 seconds") -> StreamingQuery:
        """Run over what is there and stop, or continuously with a batch `every` so often."""
        if self._table is None:
            self._table = ChangeTable(self.spark, f"{checkpoint.rstrip('/')}/change_table")
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if continuous else writer.trigger(availableNow=True)
        self.query = writer.start()
        return self.query

    def keep_running(
        self, stream: DataFrame, checkpoint: str, attempts: int = 5, wait: float = 1.0, most: float = 60.0, continuous: bool = True, every: str = "5 seconds",
    ) -> None:
        """Run until the stream is stopped; after a failure start again, after a wait that doubles up to `most` seconds. A batch that
        went through resets the count of failures; after `attempts` in a row the failure is raised."""
        failures = 0
        while True:
            before = self.last_batch
            try:
                self.start(stream, checkpoint, continuous, every).awaitTermination()
                return
            except StreamingQueryException:
                failures = 1 if self.last_batch > before else failures + 1
                self.states = {v: "restarting" for v in self.next_usn}
                if failures >= attempts:
                    raise
                time.sleep(min(most, wait * 2 ** (failures - 1)))

    def status(self) -> dict[str, str]:
        return dict(self.states) if self.query is not None and self.query.isActive else {v: "inactive" for v in self.next_usn}

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.flush()
