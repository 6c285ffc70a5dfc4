"""Streaming twins of batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from relweave.operators import corpus as co
from relweave.operators import quality as qu
from relweave.operators import writes as wr


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run over what is there, appending to a Parquet folder (exactly once)."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    q.outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def parsed_functions(files: DataFrame) -> DataFrame:
    """Functions of new or changed source files, with the file's version."""
    named = files.withColumn("path", F.concat_ws("\u0001", F.col("version").cast("string"), F.col("path")))
    out = co.parse_functions(named.select("path", "length", "content"))
    parts = F.split("file_path", "\u0001")
    return out.withColumn("version", parts[0].cast("int")).withColumn("file_path", parts[1]).drop("parameter_types")


def window_counts(stream: DataFrame, ts: str, keys: list[str], every: str, late: str) -> DataFrame:
    """Counts per clock window; state is dropped behind the watermark."""
    w = F.window(F.col(ts), every)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def calendar_counts(stream: DataFrame, ts: str, keys: list[str], unit: str, late: str) -> DataFrame:
    """Counts per month, quarter or year. The watermark is on the start of the unit,
    so a unit's state is dropped once rows of units ``late`` behind can't come."""
    start = F.date_trunc(unit, ts).cast("timestamp")
    return stream.withColumn("start", start).withWatermark("start", late).groupBy("start", *keys).agg(F.count("*").alias("n"))


STORE_STATE = "w_at timestamp, w_seq bigint, op string, value double, timeout int, t_at timestamp, t_seq bigint, t_timeout int"
STORE_OUT = "key string, value double, expires timestamp, live boolean"


def _fold(key, batches, state: GroupState):
    """Latest write and latest touch of a key. Both are maxima, so neither the
    order nor the grouping of the input matters, and memory stays constant.

    State ends with the entry: once the watermark passes its expiry, or for deleted
    keys the deletion, nothing that still may come can change it.
    """
    if state.hasTimedOut:
        state.remove()
        return
    at = list(state.get) if state.exists else [None] * 8
    whole = lambda x: None if pd.isna(x) else int(x)  # no timeout: never expires
    passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    for b in batches:
        order = lambda df: df.sort_values(["ts", "seq"]).iloc[-1]
        b = b[b["ts"] >= passed]
        writes, touches = b[b["op"] != "touch"], b[b["op"] == "touch"]
        if len(writes):
            r = order(writes)
            if at[0] is None or (r["ts"], r["seq"]) > (at[0], at[1]):
                at[:5] = [r["ts"].to_pydatetime(), int(r["seq"]), r["op"], float(r["value"]), whole(r["timeout"])]
        if len(touches):
            r = order(touches)
            if at[5] is None or (r["ts"], r["seq"]) > (at[5], at[6]):
                at[5:] = [r["ts"].to_pydatetime(), int(r["seq"]), whole(r["timeout"])]
    if at[0] is None and at[5] is None:  # late rows only
        return
    live = at[2] == "set"
    expires = None
    if live:
        touched = at[5] is not None and (at[5], at[6]) > (at[0], at[1])
        since, lasts = (at[5], at[7]) if touched else (at[0], at[4])
        expires = None if lasts is None else since + pd.Timedelta(seconds=lasts)
    ends = expires if live else max(x for x in (at[0], at[5]) if x is not None)
    if ends is not None and pd.Timestamp(ends) <= passed:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(at))
        if ends is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(ends).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame({"key": [key[0]], "value": [at[3] if live else None], "expires": [pd.NaT if expires is None else pd.Timestamp(expires)], "live": [live]})


def ttl_updates(ops: DataFrame, late: str) -> DataFrame:
    """Current entry of each key touched in a micro-batch. ``ops`` as in the
    batch store: key, op, value, ts, timeout, seq.

    Rows more than ``late`` behind are dropped, and the state of an entry leaves when
    the watermark passes its end. Within ``late`` the result is the batch store's; a
    touch that comes after its entry has left starts nothing.
    """
    typed = ops.select("key", "op", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("timeout").cast("int").alias("timeout"), F.col("seq").cast("bigint").alias("seq"))
    return typed.withWatermark("ts", late).groupBy("key").applyInPandasWithState(_fold, STORE_OUT, STORE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


BUCKET = "bucket"


def bucketed_upsert(spark: SparkSession, path: str, keys: list[str], order: list[Column] | None = None, buckets: int = 64):
    """foreachBatch body: upserts micro-batches into a Parquet folder, of which each
    batch reads and rewrites the key buckets it touches and no others.

    A row replaces one that comes behind it by ``order``, so late rows do no harm;
    without ``order`` a later batch replaces earlier ones. A batch is first written
    aside, whole; then its buckets take the place of the old ones. A batch run again
    finds what it has written and only puts it in place once more. ``buckets`` stays
    as it is for the life of the table.
    """
    table, aside = f"{path}/table", f"{path}/aside"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))

    def write(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
        staged = f"{aside}/batch={number}"
        if not there(f"{staged}/_SUCCESS"):
            rows = batch.withColumn(BUCKET, bucket).withColumn("__new", F.lit(1))
            if there(table):
                batch.persist()  # read twice: a stream's state would be worked out again
                touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
                old = spark.read.schema(rows.drop("__new").schema).parquet(table).where(F.col(BUCKET).isin(touched))
                rows = rows.unionByName(old.withColumn("__new", F.lit(0)))
            newest = [*(order or []), -F.col("__new")]
            merged = wr.first_per_key(rows, keys, newest).drop("__new")
            merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(staged)
            batch.unpersist()
        done = spark.read.schema(batch.withColumn(BUCKET, bucket).schema).parquet(staged)
        writer = done.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(table)
        earlier = hadoop(f"{aside}/batch={number - 2}")  # Spark runs no batch again before the last one
        earlier.getFileSystem(spark._jsc.hadoopConfiguration()).delete(earlier, True)

    return write


def bucketed_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table").drop(BUCKET)


def keep_newest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Runs a stream of updates into a bucketed table and reads it."""
    each_batch(stream, bucketed_upsert(stream.sparkSession, path, keys, order), checkpoint)
    return bucketed_table(stream.sparkSession, path)


def enriched(stream: DataFrame, table: DataFrame, column: str, key: str, how: str = "left") -> DataFrame:
    """Stream joined to a table on its key."""
    return stream.join(table, F.col(column) == F.col(key), how)


def validation_sink(good: str, bad: str, key: str, rules: dict[str, tuple[Column, Column]]):
    """foreachBatch body: clean rows to one folder, violations to another."""
    def write(batch: DataFrame, number: int) -> None:
        ok = F.lit(True)
        for cond, _ in rules.values():
            ok = ok & F.coalesce(cond, F.lit(True))
        batch = batch.persist()
        batch.where(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        qu.violations(batch, key, rules).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return write
