"""Registered queries over streams: a table is taken as a stream, and SQL replays it as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..sources.workspace import folder
from ..streaming import cache_stream
from .catalog import query

_TTL = 6 * 3600


@query(f"""WITH ev AS (SELECT md5(props) AS key, event_id, epoch_us(ts) AS us, event_type = 'view' AS put, user_id % 4 AS v FROM events), x AS (SELECT *, sum(put::INT) OVER (PARTITION BY key ORDER BY us, event_id) AS g FROM ev),
p AS (SELECT key, g, event_id AS pid, v, us + {_TTL}000000 AS ends, lead(us) OVER w AS next_us, lead(event_id) OVER w AS next_id FROM x WHERE put WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
gets AS (SELECT x.key, x.g, x.event_id, x.us, pid, coalesce(x.us < ends AND p.v >= 1, false) AS live, coalesce(x.us < ends, false) AS young, row_number() OVER (PARTITION BY x.key, x.g ORDER BY x.us, x.event_id) AS n FROM x LEFT JOIN p ON p.key = x.key AND p.g = x.g WHERE NOT put),
told AS (SELECT key, g, count(*) FILTER (live) AS hits, arg_min(event_id, n) FILTER (young) AS first FROM gets GROUP BY ALL),
e AS (SELECT p.*, coalesce(hits, 0) AS hits, first, CASE WHEN p.v < 1 AND first IS NOT NULL THEN 'stale' WHEN next_us < ends THEN 'replaced' WHEN (ends + 999) // 1000 <= (SELECT max(us) FROM ev) // 1000 THEN 'expired' END AS kind FROM p LEFT JOIN told USING (key, g))
SELECT key, event_id, CASE WHEN live THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN live THEN pid END AS answer, CASE WHEN live THEN n END AS hits FROM gets
UNION ALL SELECT key, CASE kind WHEN 'stale' THEN first WHEN 'replaced' THEN next_id END, kind, pid, hits FROM e WHERE kind IS NOT NULL""")
def cache_stream_events(spark, sf_dir):
    """Views are answers that are put into the cache, other events ask for them; what the cache does with each."""
    e = table(spark, sf_dir, "events")
    path = folder(spark, "cache-events")
    e.write.parquet(path)
    stream = cache_stream.with_state_store(spark).readStream.schema(e.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    events = stream.select(F.md5(F.col("props").cast("binary")).alias("key"), "event_id", "ts", (F.col("event_type") == "view").alias("put"), F.col("event_id").alias("answer"), (F.col("user_id") % 4).alias("version"))
    out = folder(spark, "cache-told")
    cache_stream.run(cache_stream.served(events, _TTL, 1), out, folder(spark, "cache-state")).awaitTermination()
    return spark.read.schema(cache_stream.OUTPUT).parquet(out)
