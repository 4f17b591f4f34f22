"""Streams: event-time windows with watermarks, a bounded queue that drops the oldest, keyed replay state, and rate folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.scans import scan


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; the rate limit is the back pressure."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run to the end of what is there and read the result. Complete and update modes go through foreachBatch, each batch
    to its own folder, the last one standing."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet", outputMode="append").awaitTermination()
        return spark.read.parquet(out)
    last: list[int] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        last.append(batch)

    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{out}/batch={max(last)}")


def windowed(stream: DataFrame, time: str, value: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts and sums per tumbling window; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def bounded_queue(stream: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """Per key the last ``size`` items and the counts of what was taken and dropped, kept as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, taken, dropped = state.get if state.exists else ([], 0, 0)
        for f in frames:
            new = sorted(f[item].tolist())
            taken += len(new)
            items = sorted(list(items) + new)
            dropped += max(0, len(items) - size)
            items = items[-size:]
        state.update((items, taken, dropped))
        yield pd.DataFrame({key: [k[0]], "items": [items], "taken": [taken], "dropped": [dropped]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} bigint, items array<bigint>, taken bigint, dropped bigint", "items array<bigint>, taken bigint, dropped bigint", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last update of each key (several batches of an update stream)."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c != key]), order).alias("s")).select(key, "s.*")


def ready_groups(tags: DataFrame, group: str, key: str, status: str, order: str) -> DataFrame:
    """Replay sample: keyed upserts, then the successes of groups in which nothing is running any more."""
    now = tags.groupBy(group, key).agg(F.max_by(status, order).alias("status"))
    done = now.groupBy(group).agg(F.count_if(F.col("status") == "running").alias("open")).where("open = 0")
    return now.join(done.select(group), group).where("status = 'success'")


def token_bucket(df: DataFrame, key: str, time: str, tokens: str, order: list[str], rate: float, capacity: float) -> DataFrame:
    """Adds ``waited``: the bucket of each key refills at ``rate`` up to ``capacity``; a request larger than what is there runs a debt that
    it waits for."""

    def step(state: tuple, t: float, n: float) -> tuple[tuple, tuple]:
        last, level = state
        level = min(capacity, level + (0.0 if last is None else (t - last) * rate)) - n
        return (max(0.0, -level / rate),), (t, level)

    return scan(df, key, order, [time, tokens], {"waited": "double"}, (None, capacity), step)


def agent_states(df: DataFrame, key: str, order: list[str], calls: str, tokens: str, most_turns: int, most_tokens: int) -> DataFrame:
    """key, state, used, n: what an agent's loop over the ordered turns of each key ends in: terminated_length, terminated (a turn without
    calls), terminated_turns, or running; the tokens used and the turns taken by then."""

    def step(state: tuple, c: int, t: int) -> tuple[tuple, tuple]:
        name, used, n = state
        if name == "running":
            used, n = used + t, n + 1
            name = "terminated_length" if used > most_tokens else "terminated" if c == 0 else "terminated_turns" if n >= most_turns else "running"
        return (name, used, n), (name, used, n)

    turns = scan(df, key, order, [calls, tokens], {"state": "string", "used": "bigint", "n": "int"}, ("running", 0, 0), step)
    return turns.groupBy(key).agg(F.max_by(F.struct("state", "used", "n"), F.struct("n", "used")).alias("s")).select(key, "s.*")
