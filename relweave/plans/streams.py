"""Streaming twins, each run over the whole table and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.plans import corpus as pc
from relweave.plans import writes as pw
from relweave.plans.registry import Data, query
from relweave.runtime import ntz, scratch_path
from relweave.streaming import jobs


def events(d: Data):
    # A one-file pattern: streams read folders or patterns, not plain files.
    return jobs.file_stream(d.spark, f"{d.folder}/events.parque[t]", d.events)


@query("stream_corpus", f"SELECT name, path AS file_path, line::INT AS line_number FROM {pc.ALL_FUNCTIONS}")
def stream_corpus(d: Data):
    """Two drops of source files; the second replaces every fourth file."""
    k = F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint")
    files = pc.source_files(d)
    first = files.withColumn("content", F.when(k % 4 == 0, F.lit("def old():\n    pass\n")).otherwise(F.col("content"))).withColumn("version", F.lit(1))
    second = files.where(k % 4 == 0).withColumn("version", F.lit(2))
    drop, out, mark = (scratch_path(d.spark, n) for n in ("drop", "parsed", "mark"))
    first.unionByName(second).write.parquet(drop)
    stream = jobs.file_stream(d.spark, drop, first.limit(0))
    jobs.append_to(jobs.parsed_functions(stream), out, mark)
    rows = d.spark.read.parquet(out)
    newest = rows.groupBy("file_path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file_path", "version"], "left_semi").select("name", "file_path", "line_number")


@query("stream_window_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(d: Data):
    out, mark = scratch_path(d.spark, "hours"), scratch_path(d.spark, "mark")
    stream = events(d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.keep_newest(jobs.window_counts(stream, "ts", ["event_type"], "1 hour", "40 days"), out, mark, ["start", "event_type"])
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_calendar_counts", "SELECT date_trunc('month', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_calendar_counts(d: Data):
    out, mark = scratch_path(d.spark, "months"), scratch_path(d.spark, "mark")
    counts = jobs.calendar_counts(events(d), "ts", ["event_type"], "month", "40 days")
    return jobs.keep_newest(counts, out, mark, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_ttl_store", f"{pw.TTL} SELECT key, value, expires FROM live")
def stream_ttl_store(d: Data):
    out, mark = scratch_path(d.spark, "store"), scratch_path(d.spark, "mark")
    stream = Data(d.spark, d.folder)
    stream._read["events"] = events(d)
    updates = jobs.ttl_updates(pw.operations(stream), "40 days")
    rows = jobs.keep_newest(updates, out, mark, ["key"]).withColumn("expires", F.col("expires").cast("timestamp_ntz"))
    return rows.where(F.col("live") & (F.col("expires").isNull() | (F.col("expires") > ntz("2024-01-29 00:00:00")))).select("key", "value", "expires")


@query("stream_upsert", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_upsert(d: Data):
    out, mark = scratch_path(d.spark, "table"), scratch_path(d.spark, "mark")
    newest = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]
    rows = jobs.keep_newest(events(d).select("user_id", "ts", "value", "event_id"), out, mark, ["user_id"], newest)
    return rows.select("user_id", "ts", "value")


@query("stream_enrichment", "SELECT event_id, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_enrichment(d: Data):
    out, mark = scratch_path(d.spark, "enriched"), scratch_path(d.spark, "mark")
    joined = jobs.enriched(events(d), d.customer, "user_id", "c_custkey").select("event_id", "c_name", "c_mktsegment")
    jobs.append_to(joined, out, mark)
    return d.spark.read.parquet(out)


@query("stream_validation", """
SELECT 'ok' AS rule, event_id::VARCHAR AS key FROM events WHERE value <= 100 AND event_type <> 'view'
UNION ALL SELECT 'value', event_id::VARCHAR FROM events WHERE value > 100 UNION ALL SELECT 'kind', event_id::VARCHAR FROM events WHERE event_type = 'view'""")
def stream_validation(d: Data):
    good, bad, mark = (scratch_path(d.spark, n) for n in ("good", "bad", "mark"))
    rules = {"value": (F.col("value") <= 100, F.col("value")), "kind": (F.col("event_type") != "view", F.col("event_type"))}
    jobs.each_batch(events(d), jobs.validation_sink(good, bad, "event_id", rules), mark, "append")
    ok = d.spark.read.parquet(good).select(F.lit("ok").alias("rule"), F.col("event_id").cast("string").alias("key"))
    return ok.unionByName(d.spark.read.parquet(bad).select("rule", "key"))
