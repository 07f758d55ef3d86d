"""De-duplication, allowances and history over event streams: batch operators and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.ordering import greedy_starts
from ..operators.running import along


def cooldown_dedup(events: DataFrame, key: str, ts: str, tie: str, cooldown_ms: int = 3000) -> DataFrame:
    """Events that come at least the cooldown after the last accepted one of their key.

    Rejected events do not extend the cooldown, so accepted events are the stops of a greedy walk along a key's times.
    """
    ms = F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP))")
    rows = events.select(key, F.col(tie), F.struct(ms.alias("t"), F.col(tie).alias("tie")).alias("at"), F.struct((ms + cooldown_ms * 1000).alias("t"), F.lit(None).cast(dict(events.dtypes)[tie]).alias("tie")).alias("reach"))
    return events.join(greedy_starts(rows, [key], "at", "reach", tie).select(tie), tie, "left_semi")


class Keyed(StatefulProcessor):
    """What the streaming forms share: rows of a key in order of time, and state that goes with the watermark. Each item of
    state is a value or a map of its own in Spark's state store; a timer `keep_ms` behind the key's last event clears it."""

    def __init__(self, ts: str, columns: list[str], keep_ms: int):
        self.ts, self.columns, self.keep_ms = ts, columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long")
        self.items = [self.last]

    def value(self, name: str, schema: str):
        self.items.append(self.handle.getValueState(name, schema))
        return self.items[-1]

    def decide(self, f: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(self.ts, kind="stable")  # one key's rows of one trigger
        out = self.decide(f)
        before = self.last.get()[0] if self.last.exists() else None
        last = max(int(f[self.ts].max().value // 1_000_000), before or 0)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
            self.last.update((last,))
        yield out[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for item in self.items:
            item.clear()
        return iter(())


class Cooldown(Keyed):
    """The last accepted time of a key, in microseconds."""

    def __init__(self, ts: str, columns: list[str], cooldown_ms: int):
        super().__init__(ts, columns, cooldown_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = self.value("accepted", "micros long")

    def decide(self, f: pd.DataFrame) -> pd.DataFrame:
        last, keep = self.accepted.get()[0] if self.accepted.exists() else None, []
        for t in f[self.ts]:
            now = t.value // 1000
            keep.append(last is None or now - last >= self.keep_ms * 1000)
            last = now if keep[-1] else last
        self.accepted.update((last,))
        return f[keep]


class Session(Keyed):
    """Whether the key's item is in."""

    def __init__(self, ts: str, columns: list[str], keep_ms: int, removed: str):
        super().__init__(ts, columns, keep_ms)
        self.removed = removed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.there = self.value("there", "there boolean")

    def decide(self, f: pd.DataFrame) -> pd.DataFrame:
        there, keep = bool(self.there.get()[0]) if self.there.exists() else False, []
        for gone in f[self.removed].fillna(False):
            keep.append(not gone and not there)
            there = not gone
        self.there.update((there,))
        return f[keep]


class Allowance(Keyed):
    """A user's operations of a day, each an entry of a map, and how many of them were granted."""

    def __init__(self, ts: str, columns: list[str], operation: str, limit: int):
        super().__init__(ts, columns, 86_400_000)
        self.operation, self.limit = operation, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.granted, self.known = self.value("granted", "n int"), handle.getMapState("known", "operation string", "granted boolean")
        self.items.append(self.known)

    def decide(self, f: pd.DataFrame) -> pd.DataFrame:
        n, granted = self.granted.get()[0] if self.granted.exists() else 0, []
        for x in f[self.operation].astype(str):
            if not self.known.containsKey((x,)):
                self.known.updateValue((x,), (n < self.limit,))
                n += n < self.limit
            granted.append(bool(self.known.getValue((x,))[0]))
        self.granted.update((n,))
        return f.assign(granted=granted)


class Quota(Keyed):
    """A group's successes so far."""

    def __init__(self, ts: str, columns: list[str], success: str, allowance: int, idle_ms: int):
        super().__init__(ts, columns, idle_ms)
        self.success, self.allowance = success, allowance

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.done = self.value("done", "n long")

    def decide(self, f: pd.DataFrame) -> pd.DataFrame:
        done, status = self.done.get()[0] if self.done.exists() else 0, []
        for ok in f[self.success]:
            status.append("skipped_quota" if done >= self.allowance else "completed" if ok else "failed")
            done += bool(ok)
        self.done.update((done,))
        return f.assign(status=status)


def _stateful(events: DataFrame, key: list[str], processor: Keyed, added: str = "") -> DataFrame:
    """The stream through a processor. Its state lives in RocksDB, which the session is told where it still has the store
    that Spark starts with."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state."
    if events.sparkSession.conf.get(name, "").rsplit(".", 1)[-1] in ("", "HDFSBackedStateStoreProvider"):
        events.sparkSession.conf.set(name, own + "RocksDBStateStoreProvider")
    schema = StructType(list(events.schema.fields))
    if added:
        schema = schema.add(*added.split())
    return events.groupBy(*key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def cooldown_stream(events: DataFrame, key: str, ts: str, cooldown_ms: int = 3000, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of cooldown_dedup: the last accepted time of each key is the state, and goes with the watermark."""
    return _stateful(events.withWatermark(ts, delay), [key], Cooldown(ts, events.columns, cooldown_ms))


def session_dedup(events: DataFrame, key: list[str], ts: str, tie: str, removed: Column | None = None) -> DataFrame:
    """The first event of each key; where `removed` says that an event takes the key's item away, the next one is
    admitted again. Removing events themselves are not put out."""
    gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
    df = along(events.withColumn("_gone", gone), key, [ts, tie], before={"_life": F.col("_gone").cast("long")}).filter("not _gone").drop("_gone")
    first = df.groupBy(*key, "_life").agg(F.min(F.struct(ts, tie)).alias("_f")).select(*key, "_life", F.col(f"_f.{ts}").alias(ts), F.col(f"_f.{tie}").alias(tie))
    return df.join(first, [*key, "_life", ts, tie], "left_semi").drop("_life")


def session_stream(events: DataFrame, key: list[str], ts: str, removed: str | None = None, session: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streaming form of session_dedup: whether a key is in is the state; it goes a session after its last event.
    `removed` names a boolean column. Without one, Spark's own de-duplication within a watermark serves."""
    if not removed:
        return events.withWatermark(ts, session).dropDuplicatesWithinWatermark(key)

    return _stateful(events.withWatermark(ts, delay), key, Session(ts, events.columns, int(pd.Timedelta(session).total_seconds() * 1000), removed))


def daily_allowance(events: DataFrame, user: str, operation: str, ts: str, tie: str, limit: int = 5) -> DataFrame:
    """Adds day and granted: an operation counts once a user and day, and the first `limit` of them are granted."""
    df = events.withColumn("day", F.to_date(ts))
    first = df.groupBy(user, "day", operation).agg(F.min(F.struct(ts, tie)).alias("_f"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(user, "day").orderBy("_f"))).select(user, "day", operation, (F.col("_n") <= limit).alias("granted"))
    return df.join(ranked, [user, "day", operation])


def allowance_stream(events: DataFrame, user: str, operation: str, ts: str, limit: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of daily_allowance: a user's operations of the day are the state, an entry each, and go a day after
    the last one."""
    df = events.withWatermark(ts, delay).withColumn("day", F.to_date(ts))
    return _stateful(df, [user, "day"], Allowance(ts, [*df.columns, "granted"], operation, limit), "granted boolean")


def quota_gate(items: DataFrame, group: str, order: str, success: str, allowance: int) -> DataFrame:
    """Status of each item in order: completed, failed or skipped_quota. Only successes use the allowance, so an item
    is skipped once the successes before it reach the allowance."""
    done, before = along(items, [group], [order], before={"_before": F.coalesce(F.col(success), F.lit(False)).cast("long")}), F.col("_before")
    status = F.when(before >= allowance, "skipped_quota").when(F.col(success), "completed").otherwise("failed")
    return done.withColumn("status", status).drop("_before")


def quota_stream(items: DataFrame, group: str, ts: str, success: str, allowance: int, idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Streaming form of quota_gate in order of time: a group's successes so far are the state; it goes when the group
    has been idle for so long."""
    quota = Quota(ts, [*items.columns, "status"], success, allowance, int(pd.Timedelta(idle).total_seconds() * 1000))
    return _stateful(items.withWatermark(ts, delay), [group], quota, "status string")


def history_last_n(events: DataFrame, user: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    """The newest n events of each user."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie)))).filter(F.col("_n") <= n).drop("_n")


def recent_distinct(events: DataFrame, user: str, item: str, ts: str, n: int = 6) -> DataFrame:
    """The last n distinct items of each user, most recent first: user, item, last_ts, rank."""
    last = events.groupBy(user, item).agg(F.max(ts).alias("last_ts"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last_ts"), item)).cast("long")).filter(F.col("rank") <= n)
