"""The same rules over a stream: event-time windows, watermarks, keyed alert cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.sources.staging import shared_folder

#: The operational window, its step, the lateness that is waited for, and the pause between alerts of one key.
WINDOW, STEP, LATE, COOLDOWN_S = "5 minutes", "10 seconds", "10 minutes", 60


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a file stream, with a TIMESTAMP time as watermarks need it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")


def window_rates(events: DataFrame, key: str, size: str = WINDOW, step: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and mean values by key and (sliding) window; works on streams and on tables alike."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean")


def sessions(events: DataFrame, key: str, gap: str = WINDOW, late: str = LATE) -> DataFrame:
    """Sessions of a key that end after a gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that the stream can deliver now, as a table of the shared folder (append), or its last state (complete)."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "complete":

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(base + "/out")

        query = stream.writeStream.outputMode("complete").option("checkpointLocation", base + "/state").foreachBatch(put)
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", base + "/state").format("parquet").option("path", base + "/out")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


def cooled(times: list[float], last: float | None, pause: float = COOLDOWN_S) -> tuple[list[bool], float | None]:
    """Which alerts (seconds, in order) are emitted, given the time of the last emitted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= pause
        out.append(ok)
        last = t if ok else last
    return out, last


def alert_cooldown(alerts: DataFrame, pause: float = COOLDOWN_S) -> DataFrame:
    """Alerts (key, ts) of a stream without those within the pause after the last emitted one of their key.

    State per key is one number. Alerts of a key within one batch are put in order first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        last = state.get[0] if state.exists else None
        keep, last = cooled([t.timestamp() for t in rows["ts"]], last, pause)
        state.update((last,))
        yield rows[keep]

    return alerts.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp", "last double", "append", "NoTimeout")


def cooldown_batch(alerts: DataFrame, pause: float = COOLDOWN_S) -> DataFrame:
    """The same over a table (key, ts).

    A gap of at least the pause before an alert always restarts the key's clock, so alerts split there into runs that are decided
    apart; only a run without such a gap is walked in order, inside one aggregate expression.
    """
    from pyspark.sql import Window

    at = F.unix_micros("ts") / 1e6
    w = Window.partitionBy("key").orderBy("ts")
    t = alerts.select("key", "ts", at.alias("t"))
    marked = t.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(w) >= pause, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w))
    none = F.array().cast("array<double>")
    walk = lambda ts: F.aggregate(ts, F.struct(F.lit(None).cast("double").alias("last"), none.alias("out")), lambda s, x: F.when(s["last"].isNull() | (x - s["last"] >= pause), F.struct(x.alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s))["out"]
    kept = runs.groupBy("key", "run").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("key", F.explode(walk(F.col("ts"))).alias("t"))
    return kept.select("key", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint")).alias("ts"))


def detect_stream(requests: DataFrame, rules: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = STEP):
    """Start a stream that runs rules over each micro-batch's window state and hands alerts to a sink."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(rules(df), epoch)

    return requests.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def link_streams(dns: DataFrame, http: DataFrame, seconds: int = 300, late: str = LATE) -> DataFrame:
    """DNS queries and HTTP requests of one address prefix at most ``seconds`` apart: an interval join with watermarks on both sides.

    Time is cut into slices twice as long as that reach. A request lies in one slice and a query joins every slice that it reaches into (two),
    so rows meet only those near them in time, and each pair meets once.
    """
    pre = lambda c: F.substring_index(c, ".", 3)
    part = lambda t: F.floor(F.unix_micros(t) / max(int(seconds * 2_000_000), 1))
    d, h = dns.select(pre("src_ip").alias("dp"), F.col("ts").alias("dts"), "query_id"), http.select(pre("src_ip").alias("hp"), F.col("ts").alias("hts"), "request_id")
    if dns.isStreaming:
        d, h = d.withWatermark("dts", late), h.withWatermark("hts", late)
    reach = F.expr(f"interval {seconds} seconds")
    d = d.withColumn("dk", F.explode(F.sequence(part(F.col("dts") - reach), part(F.col("dts") + reach))))
    h = h.withColumn("hk", part(F.col("hts")))
    near = F.expr(f"dp = hp and dk = hk and hts >= dts - interval {seconds} seconds and hts <= dts + interval {seconds} seconds")
    return d.join(h, near).select(F.col("dp").alias("prefix"), "query_id", "request_id", "dts", "hts")
