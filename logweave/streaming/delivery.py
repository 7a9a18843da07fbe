"""Delivery of a stream's matches exactly once, so many of them a batch; what is beyond waits for the next batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trace import match_events
from ..sources.commits import CommitLog

_ORDER = ("file_id", "offset", "line_no", "pattern_id", "line_text")


class Delivery:
    """A queue of records below a path, first in, first out.

    A batch is one commit, which holds its number, the records it adds and those it delivers: a batch that is torn before
    its commit leaves nothing, and is worked on again from the same records; one that is repeated after it does nothing. Records are numbered in the order
    of file, place and pattern as they come in, and a pair of batch and number tells how far delivery has got, so that what waits is never written again.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int, handler: Callable[[DataFrame, int], None] | None = None) -> None:
        self.log, self.cap, self.handler = CommitLog(spark, path), cap, handler

    def _schema(self, events: DataFrame | None = None) -> str:
        """Columns of the records; the first batch notes them in the manifest."""
        if events is not None:
            return ", ".join(f"`{c}` {t}" for c, t in events.dtypes)
        return self.log.folders["schema"][0]

    def deliver(self, events: DataFrame | None, batch: int) -> int:
        """Add the records of a batch, if any, and deliver the first cap of all that wait; how many were delivered."""
        self.log.refresh()
        known = self.log.folders
        if events is not None and batch <= int(known.get("batch", ["-1"])[0]):
            return 0
        if events is None and "schema" not in known:
            return 0
        schema = self._schema(events) if "schema" not in known else self._schema()
        folders, batches = list(known.get("waiting", [])), list(known.get("batches", []))
        if events is not None:
            numbered = events.orderBy(*_ORDER).withColumns({"__batch": F.lit(batch).cast("long"), "__seq": F.monotonically_increasing_id()})
            folders.append(self.log.stage(numbered))
            batches.append(str(batch))
        last_batch, last_seq = (int(x) for x in known.get("pointer", ["-1", "-1"]))
        first, n = [], 0
        if folders:
            spark = self.log.spark
            pool = spark.read.schema(f"{schema}, __batch long, __seq long").parquet(*[f"{self.log.path}/data/{f}" for f in folders])
            ahead = (F.col("__batch") > last_batch) | ((F.col("__batch") == last_batch) & (F.col("__seq") > last_seq))
            first = [self.log.stage(pool.where(ahead).orderBy("__batch", "__seq").limit(self.cap))]
            sent = spark.read.schema(f"{schema}, __batch long, __seq long").parquet(f"{self.log.path}/data/{first[0]}")
            n, end = sent.agg(F.count("*"), F.max(F.struct("__batch", "__seq"))).first()
            if end is not None:
                last_batch, last_seq = end
            if self.handler is not None and n:
                self.handler(sent.drop("__batch", "__seq"), batch)
        still = [i for i, b in enumerate(batches) if int(b) >= last_batch]
        self.log.commit_all({
            "schema": [schema], "batch": [str(batch)] if events is not None else known["batch"], "waiting": [folders[i] for i in still], "batches": [batches[i] for i in still],
            "pointer": [str(last_batch), str(last_seq)], "delivered": [*known.get("delivered", []), *(first if n else [])],
        })
        return n

    def drain(self) -> int:
        """Deliver all that waits, cap records at a time; how many."""
        total = 0
        while n := self.deliver(None, int(self.log.folders.get("batch", ["-1"])[0])):
            total += n
        return total

    def delivered(self) -> DataFrame:
        """All records whose delivery is committed."""
        self.log.refresh()
        return self.log.read("delivered", f"{self._schema()}, __batch long, __seq long").drop("__batch", "__seq")

    def waiting(self) -> int:
        """How many records wait."""
        self.log.refresh()
        last_batch, last_seq = (int(x) for x in self.log.folders.get("pointer", ["-1", "-1"]))
        rows = self.log.read("waiting", "__batch long, __seq long")
        return rows.where((F.col("__batch") > last_batch) | ((F.col("__batch") == last_batch) & (F.col("__seq") > last_seq))).count()


def stream_match_delivery(matches: DataFrame, path: str, max_per_batch: int, checkpoint: str, handler: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """The match_found records of a stream into the table of a ``Delivery``, max_per_batch a batch at most; none is lost or doubled.

    The table (``Delivery.delivered``) has each record once, however often the stream is restarted. A handler is called before a batch is committed, with its records and
    number; after a restart it may get the same batch again, so it should write by that number. A batch needs new data: call ``Delivery.drain`` at the end.
    """
    delivery = Delivery(matches.sparkSession, path, max_per_batch, handler)
    return matches.writeStream.foreachBatch(lambda batch, epoch: delivery.deliver(match_events(batch), epoch) and None).option("checkpointLocation", checkpoint).start()
