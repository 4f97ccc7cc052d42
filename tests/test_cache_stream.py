"""The cache over a stream: batches cut anywhere, timers, versions, against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import cache_stream

SCHEMA = "key string, event_id long, ts timestamp, put boolean, answer long, version long"
TTL = 100


def replayed(events, least, until):
    """What the cache does, event by event; ``until``: what the watermark passes in the end."""
    entries, out = {}, []
    for e in sorted(events, key=lambda e: (e[2], e[1])):
        key, i, at, put, answer, version = e
        for k, x in list(entries.items()):
            if x[2] <= at:
                out.append((k, None, "expired", x[0], x[3]))
                del entries[k]
        if put:
            if key in entries:
                out.append((key, i, "replaced", entries[key][0], entries[key][3]))
            entries[key] = [answer, version, at + TTL, 0]
        elif key in entries and entries[key][1] < least:
            out += [(key, i, "stale", entries[key][0], entries[key][3]), (key, i, "miss", None, None)]
            del entries[key]
        elif key in entries:
            entries[key][3] += 1
            out.append((key, i, "hit", entries[key][0], entries[key][3]))
        else:
            out.append((key, i, "miss", None, None))
    out += [(k, None, "expired", x[0], x[3]) for k, x in entries.items() if x[2] <= until]
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_batches_give_what_a_replay_gives(spark, tmp_path, batches):
    r = random.Random(6)
    events = [(r.choice("abcdef"), i, 10_000 + 7 * i + r.choice([0, 0, 0, 300]) * (i > 60), r.random() < 0.4, 1000 + i, r.randint(0, 2)) for i in range(120)]
    events.sort(key=lambda e: e[2])
    events.append(("z", 500, 20_000, False, 0, 0))  # so late that all entries have expired before
    size = -(-len(events) // batches)
    for n in range(batches):  # one file after the other, so a batch each
        part = spark.createDataFrame([(k, i, float(at), p, a, v) for k, i, at, p, a, v in events[n * size : (n + 1) * size]], "key string, event_id long, at double, put boolean, answer long, version long")
        part.select("key", "event_id", F.col("at").cast("timestamp").alias("ts"), "put", "answer", "version").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = cache_stream.with_state_store(spark)
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cache_stream.run(cache_stream.served(stream, TTL, 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((tuple(r) for r in spark.read.schema(cache_stream.OUTPUT).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == replayed(events, 1, 20_000)
    assert {k for _, _, k, _, _ in got} == {"hit", "miss", "expired", "replaced", "stale"}
    # started again, the query goes on from its state and takes nothing twice
    cache_stream.run(cache_stream.served(stream, TTL, 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema(cache_stream.OUTPUT).parquet(str(tmp_path / "out")).count() == len(got)
