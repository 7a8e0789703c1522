"""The event journal: cursors, bounded retention, paging and subscription, as batch and as stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

RETAINED, PAGE = 512, 50


def with_cursors(events: DataFrame) -> DataFrame:
    """Adds ``cursor``, from 1 in each session, in order of arrival (ts, event_id); events without a time come first.

    Events are numbered within the hours of a session, and the hours' counts are summed up, so that a long session isn't sorted in one task.
    """
    hour = F.date_trunc("hour", F.col("ts"))
    counts = events.groupBy("session_id", hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("session_id").orderBy(F.asc_nulls_first("_hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("session_id").alias("_session"), "_hour", before.alias("_before"))
    rows = events.withColumn("_own", hour)
    numbered = rows.withColumn("_k", F.row_number().over(W.partitionBy("session_id", "_own").orderBy("ts", "event_id")))
    joined = numbered.join(offsets, F.col("session_id").eqNullSafe(F.col("_session")) & F.col("_own").eqNullSafe(F.col("_hour")))
    return joined.select(*events.columns, (F.col("_before") + F.col("_k")).cast("long").alias("cursor"))


def retained(journal: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The last ``keep`` events of each session."""
    last = journal.groupBy("session_id").agg(F.max("cursor").alias("_last"))
    return journal.join(last, "session_id").filter(F.col("cursor") > F.col("_last") - keep).drop("_last")


def poll(journal: DataFrame, requests: DataFrame, limit: int = PAGE) -> DataFrame:
    """session_id, since, events, next_cursor, truncated of each request (session_id, since) against a retained journal.

    next_cursor stays at since where nothing is new; truncated: events after since have been evicted.
    """
    oldest = journal.groupBy("session_id").agg(F.min("cursor").alias("oldest"))
    asked = requests.select("session_id", "since")
    new = asked.join(journal.select("session_id", "cursor"), "session_id").filter(F.col("cursor") > F.col("since"))
    page = new.withColumn("_k", F.row_number().over(W.partitionBy("session_id", "since").orderBy("cursor"))).filter(F.col("_k") <= limit)
    got = page.groupBy("session_id", "since").agg(F.count(F.lit(1)).alias("events"), F.max("cursor").alias("last"))
    rows = asked.join(got, ["session_id", "since"], "left").join(oldest, "session_id", "left")
    return rows.select("session_id", "since", F.coalesce("events", F.lit(0)).cast("long").alias("events"), F.coalesce("last", "since").alias("next_cursor"), F.coalesce(F.col("since") < F.col("oldest") - 1, F.lit(False)).alias("truncated"))


def subscribed(events: DataFrame, types: list[str]) -> DataFrame:
    """Events of the given types only; apply it before cursors are given."""
    return events.filter(F.col("event_type").isin(types))


def stream_cursors(events: DataFrame) -> DataFrame:
    """``with_cursors`` for a stream: each session keeps its last cursor as state, so that restarts don't repeat any.

    Within a micro-batch the order is (ts, event_id).
    """

    def number(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else 0
        rows["cursor"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["session_id", "event_id", "event_type", "ts", "cursor"]]

    schema = "session_id long, event_id long, event_type string, ts timestamp, cursor long"
    return events.groupBy("session_id").applyInPandasWithState(number, schema, "last long", "append", "NoTimeout")


#: The state store that keyed maps and timers need; set it in the session under the first name.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A block whose streams start with ``STATE_STORE``; the session's own setting follows again."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_CHANGES = "session_id long, cursor long, event_id long, event_type string, ts timestamp, change string"


class _Retention(StatefulProcessor):
    """The last ``keep`` events of a session in a map by cursor; what goes beyond leaves the map and is told."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "cursor long")
        self.held = handle.getMapState("held", "cursor long", "event_id long, event_type string, ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = self.last.get()[0] if self.last.exists() else 0
        end = before + len(new)
        new["cursor"] = range(before + 1, end + 1)
        gone = []
        for cursor in range(max(1, before - self.keep + 1), min(before, end - self.keep) + 1):
            gone.append((cursor, *self.held.getValue((cursor,))))
            self.held.removeKey((cursor,))
        kept = new[new["cursor"] > end - self.keep]
        for row in kept.itertuples():
            self.held.updateValue((row.cursor,), (row.event_id, row.event_type, row.ts))
        self.last.update((end,))
        out = pd.concat([pd.DataFrame(gone, columns=["cursor", "event_id", "event_type", "ts"]).assign(change="evicted"), kept[["cursor", "event_id", "event_type", "ts"]].assign(change="appended")]) if gone else kept[["cursor", "event_id", "event_type", "ts"]].assign(change="appended")
        out.insert(0, "session_id", key[0])
        yield out

    def close(self) -> None:
        pass


def stream_retained(events: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The changes of the retained journal of a stream: session_id, cursor, event_id, event_type, ts, change (appended or evicted).

    Each session holds its last ``keep`` events as a map in the state store and evicts the oldest as new ones arrive, so that state is
    bounded by sessions times ``keep``. What has been appended and not evicted is ``retained(with_cursors(events), keep)``; an event that
    its own micro-batch pushes out is neither. Needs ``STATE_STORE``.
    """
    return events.groupBy("session_id").transformWithStateInPandas(_Retention(keep), _CHANGES, "append", "none")


class _Quiet(StatefulProcessor):
    """Emits a source once when nothing has changed in it for ``quiet`` milliseconds."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "changes long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes, due = self.burst.get() if self.burst.exists() else (0, None)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.burst.update((changes + sum(len(r) for r in rows), due))
        self.handle.registerTimer(due)
        yield pd.DataFrame({"source": pd.Series(dtype="str"), "changes": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes, _ = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({"source": [key[0]], "changes": [changes]})

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, quiet_ms: int) -> DataFrame:
    """source, changes: one row for each burst of changes (a stream with ``source``), once the source has been quiet for ``quiet_ms``.

    Every change puts the source's timer off, as a watcher does that waits for an editor or a checkout to finish; the row tells how many
    changes the burst had. Needs ``STATE_STORE``; timers run at the trigger's pace.
    """
    return changes.groupBy("source").transformWithStateInPandas(_Quiet(quiet_ms), "source string, changes long", "append", "processingTime")


def refresh_on_change(files: DataFrame, known: DataFrame, sink, checkpoint: str, every: str | None = None, failed=None):
    """Runs the snapshot diff on each micro-batch of a file stream and hands what changed to ``sink``.

    ``every``: the time between micro-batches, say "5 seconds"; None: what is there now, then it ends. Where ``failed`` is given it is told of a
    batch that fails (epoch, error), and the stream goes on.
    """
    from graphlens.operators.maintain import snapshot_diff

    def batch(rows: DataFrame, epoch: int) -> None:
        try:
            changed = snapshot_diff(known.join(rows.select("path").distinct(), "path", "left_semi"), rows).filter("change <> 'unchanged'")
            if not changed.isEmpty():
                sink(changed, epoch)
        except Exception as e:
            if failed is None:
                raise
            failed(epoch, e)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
