"""Structured Streaming: windows with watermarks, duplicates, trailing metrics, alerts, log parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from textloom.operators.lineage import shared_folder

DELAY = "10 minutes"


def follow(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder (or file) as a stream, with the schema that it has now; times without a zone are taken in the session's, as event time must have one."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{path}*")  # as a pattern, or a path would have to be a folder
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run the stream over all that is there and return its table, kept in the shared folder.

    A batch overwrites its own folder, so one that is run again after a failure counts once. append gathers all batches;
    complete keeps the last; update keeps, of each key, the row of the last batch that has it.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/table")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row"))
        rows = newest.select("row.*")
    return rows.drop("batch").withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("began"), "event_type", "n", "total", "least", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def unique(events: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """Each key once; keys older than the watermark are forgotten, so the state stays bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def alerts(events: DataFrame, metric: str, test: Callable[[float], bool], cooldown: float, key: str = "event_type") -> DataFrame:
    """(key, ts, value, state): fired where the condition holds and the key's cooldown in seconds is over, resolved where an alert's condition no longer holds.

    One state a key: whether an alert is on, and when it fired last. Within a batch rows are taken in order of time.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on, last = state.get if state.exists else (False, -1e18)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value in zip(rows["ts"], rows[metric], strict=True):
            now = ts.timestamp()
            if pd.notna(value) and test(value):
                if now - last >= cooldown:
                    out.append((k[0], ts, value, "fired"))
                    on, last = True, now
            elif on:
                out.append((k[0], ts, value, "resolved"))
                on = False
        state.update((on, last))
        yield pd.DataFrame(out, columns=["key", "ts", "value", "state"])

    picked = events.select(F.col(key), "ts", F.col(metric))
    return picked.groupBy(key).applyInPandasWithState(step, "key string, ts timestamp, value double, state string", "on boolean, last double", "append", GroupStateTimeout.NoTimeout)


CONDITIONS: dict[str, Callable[[Column, float], Column]] = {"gt": lambda c, x: c > x, "gte": lambda c, x: c >= x, "lt": lambda c, x: c < x, "lte": lambda c, x: c <= x, "eq": lambda c, x: c == x}


def condition(value: Column, name: str, threshold: float) -> Column:
    """False for a name that isn't known."""
    return CONDITIONS[name](value, threshold) if name in CONDITIONS else F.lit(False)


def trailing(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(event_id, n, least, most, mean) of each event's kind over the minutes up to it."""
    from pyspark.sql import Window

    micros, width = F.unix_micros(F.col("ts").cast("timestamp")), minutes * 60_000_000
    # Each row is in its own stretch of time and, as what came before, in the next one, so that a kind's rows aren't in one task. A stretch is
    # as long as the window: a row's window is the end of the stretch before, from a place on, and the beginning of its own, so running sums do.
    stretch = F.floor(micros / width)
    both = F.when(micros.isNull(), F.array(stretch)).otherwise(F.array(stretch, stretch + 1))
    placed = events.select("event_id", "event_type", "value", micros.alias("_at"), F.explode(both).alias("_stretch"), stretch.alias("_own"))
    placed = placed.withColumn("_here", F.col("_stretch").eqNullSafe(F.col("_own"))).withColumn("_x", F.col("_at") + F.when(F.col("_here"), 0).otherwise(width))
    stretches = Window.partitionBy("event_type", "_stretch")
    running = lambda order: stretches.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for k, mine, w in (("a", F.col("_here"), running(F.asc("_x"))), ("b", ~F.col("_here"), running(F.desc("_x")))):
        value = F.when(mine, F.col("value"))
        sums = {"n": F.count_if(mine), "count": F.count(value), "sum": F.sum(value), "least": F.min(value), "most": F.max(value)}
        placed = placed.withColumns({f"_{name}_{k}": F.coalesce(x.over(w), F.lit(0.0)) if name == "sum" else x.over(w) for name, x in sums.items()})
    add = lambda name: F.col(f"_{name}_a") + F.col(f"_{name}_b")
    return placed.where("_here").select("event_id", add("n").alias("n"), F.least("_least_a", "_least_b").alias("least"), F.greatest("_most_a", "_most_b").alias("most"), F.round(F.try_divide(add("sum"), add("count")), 6).alias("mean"))


def progress(query) -> dict[str, float]:
    """Rows and batches of a running or ended stream so far, and the rows a second of its last batch that had any."""
    done = [p for p in query.recentProgress if p["numInputRows"]]
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done), "rows_per_second": done[-1]["processedRowsPerSecond"] if done else 0.0}


def merged(streams: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Named streams as one, with the column stream; each can be stopped only with the whole."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (s.select(*columns, F.lit(name).alias("stream")) for name, s in streams.items()))


def write_kafka(df: DataFrame, topic: str, servers: str, value: Column, key: Column | None = None, checkpoint: str | None = None):
    """Send rows as messages: a batch table at once, a stream as a query with the checkpoint folder. Needs Spark's Kafka package."""
    out = df.select(*([] if key is None else [key.cast("string").alias("key")]), value.cast("string").alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if df.isStreaming:
        return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint or f"{shared_folder(df.sparkSession)}/kafka-{uuid4().hex}").start()
    return out.write.format("kafka").options(**options).save()


# Logs

COMMON = r'^(\S+)(?: \S+){2} \[([^\]]+)\] "([^"]*)" (\d{3}) (-|\d+)(?: "(.*?)" "(.*?)"$)?'
NGINX = r"^([\d/]{10} [\d:]{8}) \[([a-z]+)\] (\d+)[#](\d+): (.*)"
APACHE = r"^\[(.+?)\] \[(.+?)\] (.*)"


def parse_log(line: Column, kind: str = "common") -> Column:
    """struct of a line's fields: common (or combined), nginx, apache or json; null where the line has another form."""
    if kind == "json":
        pick = lambda *names: F.coalesce(*(F.get_json_object(line, f"$['{n}']") for n in names))
        return F.struct(F.try_to_timestamp(pick("timestamp", "time", "@timestamp", "datetime")).alias("ts"), pick("level", "severity").alias("level"), F.coalesce(pick("message", "msg", "text", "content"), line).alias("message"))
    pattern, names = {"common": (COMMON, ("ip", "ts", "request", "status", "size", "referer", "agent")), "nginx": (NGINX, ("ts", "level", "pid", "tid", "message")), "apache": (APACHE, ("ts", "level", "message"))}[kind]
    form = {"common": "dd/MMM/yyyy:HH:mm:ss Z", "nginx": "yyyy/MM/dd HH:mm:ss", "apache": "EEE MMM dd HH:mm:ss yyyy"}[kind]
    fields = []
    for k, name in enumerate(names, 1):
        x = F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
        fields.append((F.try_to_timestamp(x, F.lit(form)) if name == "ts" and kind != "apache" else x.cast("int") if name == "status" else F.nullif(x, F.lit("-")).cast("long") if name == "size" else x).alias(name))
    return F.when(line.rlike(pattern), F.struct(*fields))


def follow_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they come; gz and bz2 by their names. Offsets are kept in the query's checkpoint."""
    return spark.readStream.text(path)


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """topic, partition, offset, key, value, headers and timestamp; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    return reader.options(**options).load().withColumns({c: F.col(c).cast("string") for c in ("key", "value")})
