"""The answer cache over a stream of puts and gets, with time-to-live as event-time timers.

Each key holds one entry in the state store. A put starts an entry (and replaces a live one); a get hits it, unless it has
expired or is of an older version, which ends it. A timer ends what no event touches once the watermark passes its expiry. So
state never holds more than the live keys, and what comes out is the same however the stream is cut into batches, as long
as a key's events come in the order of time: those of one batch are put in order here.

The state survives the loss of executors: it lies in RocksDB with its changes in the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TTL_SECONDS = 3600
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What happened: hit and miss for each get; expired, stale and replaced for each entry that ended, with its hits.
OUTPUT = "key string, event_id long, kind string, answer long, hits long"


class Cache(StatefulProcessor):
    """version: the least version that is still served."""

    def __init__(self, ttl_seconds: int, version: int):
        self.ttl, self.version = ttl_seconds * 1_000_000, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "answer long, version long, expires long, hits long")

    def _end(self, key: str, event_id: int | None, kind: str, entry: tuple) -> Row:
        self.handle.deleteTimer(-(-entry[2] // 1000))
        return Row(key=key, event_id=event_id, kind=kind, answer=entry[0], hits=entry[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (name,) = key
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if entry is not None and entry[2] <= r.at:
                yield self._end(name, None, "expired", entry)
                entry = None
            if r.put:
                if entry is not None:
                    yield self._end(name, r.event_id, "replaced", entry)
                entry = (r.answer, r.version, r.at + self.ttl, 0)
                self.handle.registerTimer(-(-entry[2] // 1000))
                continue
            if entry is not None and entry[1] < self.version:
                yield self._end(name, r.event_id, "stale", entry)
                entry = None
            if entry is None:
                yield Row(key=name, event_id=r.event_id, kind="miss", answer=None, hits=None)
            else:
                entry = (*entry[:3], entry[3] + 1)
                yield Row(key=name, event_id=r.event_id, kind="hit", answer=entry[0], hits=entry[3])
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (name,) = key
        if self.entry.exists():
            entry = tuple(self.entry.get())
            if entry[2] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.entry.clear()
                yield Row(key=name, event_id=None, kind="expired", answer=entry[0], hits=entry[3])

    def close(self) -> None:
        pass


def served(stream: DataFrame, ttl_seconds: int = TTL_SECONDS, version: int = 0, late: str = "0 seconds") -> DataFrame:  # C01, C04
    """What happens to a stream (key, event_id, ts, put, answer, version): OUTPUT. Events without a key or a time go."""
    at = F.unix_micros("ts")
    known = stream.where("key is not null and ts is not null").withWatermark("ts", late)
    each = known.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), "ts", at.alias("at"), "put", F.col("answer").cast("long").alias("answer"), F.col("version").cast("long").alias("version"))
    return each.groupBy("key").transformWithState(Cache(ttl_seconds, version), OUTPUT, "append", "eventTime")


def run(served_: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what happens to a table; what is there is taken in one go, then the query ends."""
    return served_.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own whose queries keep their state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own
