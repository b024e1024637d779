"""Queries over logs that lie in files: the driver's conversations are written as sixteen session logs, and read in ranges or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.walks import fresh_folder
from annalist.plans.surrogates import Tables, query
from annalist.sources import log_source

LOGS, RANGE = 16, 256 << 10
_ID = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))


def write_logs(t: Tables) -> str:
    """Sixteen logs in a new folder, each in a folder log=N: a header, then the conversations one after the other, a blank line behind every fifth."""
    c = t.conversations.withColumn("log", F.pmod("conv_id", F.lit(LOGS)).cast("int"))
    up = F.when(F.col("turn") == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), _ID(F.col("turn") - 1), F.lit('"')))
    line = F.concat(F.lit('{"type":"message","id":"'), _ID(F.col("turn")), F.lit('","parentId":'), up, F.lit(',"message":{"role":"'), F.col("role"), F.lit('","content":'), X.quoted(F.coalesce("text", F.lit(""))), F.lit("}}"))
    rows = c.select("log", "conv_id", "turn", line.alias("line"))
    header = F.concat(F.lit('{"type":"session","id":"log'), F.col("log").cast("string"), F.lit('"}'))
    first = c.select("log", F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), header.alias("line")).distinct()
    blank = c.where("conv_id % 5 = 0").select("log", "conv_id", F.lit(1 << 40).alias("turn"), F.lit("").alias("line")).distinct()
    folder = fresh_folder(t.spark, "logs")
    rows.unionByName(first).unionByName(blank).repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "line").write.partitionBy("log").text(folder)
    return folder


_WRITTEN = """l AS (
  SELECT conv_id % 16 AS log, conv_id, turn, '{"type":"message","id":"' || conv_id || '-' || turn || '","parentId":' || CASE WHEN turn = 0 THEN 'null' ELSE '"' || conv_id || '-' || (turn - 1) || '"' END
    || ',"message":{"role":"' || role || '","content":' || to_json(coalesce(text, '')) || '}}' AS line FROM conversations
  UNION ALL SELECT DISTINCT conv_id % 16, -1, -1, '{"type":"session","id":"log' || (conv_id % 16) || '"}' FROM conversations
  UNION ALL SELECT DISTINCT conv_id % 16, conv_id, 1099511627776, '' FROM conversations WHERE conv_id % 5 = 0)"""


def _log() -> Column:
    return F.regexp_extract("path", r"log=(\d+)", 1).cast("long").alias("log")


@query(f"""WITH {_WRITTEN},
s AS (SELECT *, CAST(count(*) FILTER (WHERE line <> '') OVER w AS BIGINT) - 2 AS ordinal, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) AS next_byte_offset, sha256(string_agg(line || chr(10), '') OVER w) AS prefix_hash
  FROM l WINDOW w AS (PARTITION BY log ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING))
SELECT log, 'log' || log AS session_id, ordinal, conv_id || '-' || turn AS entry_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id, next_byte_offset - strlen(line) - 1 AS byte_offset, next_byte_offset,
  sha256(line) AS payload_hash, prefix_hash FROM s WHERE turn >= 0 AND line <> ''""")
def split_log_scan(t: Tables) -> DataFrame:
    """Logs of which each is read by many tasks: ordinals from running sums over ranges, rules across records by joins, and prefix hashes from one ordered pass."""
    records = log_source.split_records(t.spark, write_logs(t), suffix=".txt", split_bytes=RANGE, types=False)
    entries, _ = log_source.split_sessions(records)
    hashes = log_source.with_prefix_hash(records).select("path", "byte_offset", "payload_hash", "prefix_hash")
    return entries.join(hashes, ["path", "byte_offset"]).select(_log(), "session_id", "ordinal", "entry_id", "parent_id", "byte_offset", "next_byte_offset", "payload_hash", "prefix_hash")


@query(f"""WITH RECURSIVE {_WRITTEN},
s AS (SELECT *, row_number() OVER w AS k, CAST(count(*) FILTER (WHERE line <> '') OVER w AS BIGINT) - 1 AS ordinal, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) AS next_byte_offset
  FROM l WINDOW w AS (PARTITION BY log ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)),
c(log, k, chain) AS (SELECT log, k, sha256(sha256('') || sha256(line)) FROM s WHERE k = 1 UNION ALL SELECT s.log, s.k, sha256(chain || sha256(line)) FROM c JOIN s ON s.log = c.log AND s.k = c.k + 1)
SELECT log, ordinal, next_byte_offset - strlen(line) - 1 AS byte_offset, next_byte_offset, json_extract_string(line, '$.type') AS type, sha256(line) AS payload_hash, chain AS chain_hash
FROM s JOIN c USING (log, k) WHERE line <> ''""")
def log_tail(t: Tables) -> DataFrame:
    """The same logs as a stream that is stopped after half of their bytes, in the middle of a record, and started again."""
    from annalist.streaming.logs import numbered_tail, tail
    from annalist.streaming.sidecar import PROVIDER

    folder, out, state = write_logs(t), fresh_folder(t.spark, "tail"), fresh_folder(t.spark, "tail-state")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, PROVIDER)  # read when the stream starts, and put back behind it
    half = sum(size for _, size in log_source.list_logs(folder, ".txt")) // 2
    try:
        for most in (half, 0):
            records = numbered_tail(tail(t.spark, folder, suffix=".txt", split_bytes=RANGE, max_bytes=most))
            stream = records.drop("raw").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            q = stream.trigger(**({"processingTime": "0 seconds"} if most else {"availableNow": True})).start()
            while most and q.isActive and not q.recentProgress:
                q.awaitTermination(1)
            if most:
                q.stop()
            else:
                q.awaitTermination()
            if q.exception() is not None:
                raise q.exception()
    finally:
        t.spark.conf.set(name, before)
    return t.spark.read.parquet(out).select(_log(), "ordinal", "byte_offset", "next_byte_offset", "type", "payload_hash", "chain_hash")
