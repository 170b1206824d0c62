"""Run logs: JSON lines to a status per node, in batch or over a growing folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tablewright.plans.scratch import delete_path

EVENT = """info struct<name:string,msg:string,ts:string>, data struct<name:string,status:string,failures:int,num_failures:int,execution_time:double,
elapsed_time:double,node_info:struct<unique_id:string,node_status:string,execution_time:double>,run_result:struct<status:string,execution_time:double>>, seq long"""
#: Status names as they are reported.
RUN_STATUS = {"success": "success", "error": "error", "fail": "error", "skipped": "skipped", "warn": "warn"}
TEST_STATUS = {"pass": "pass", "warn": "warn", "fail": "fail", "error": "error", "skipped": "skip"}


def parsed(lines: DataFrame) -> DataFrame:
    """Events of text lines (value). Lines that are no JSON and marker lines are left out."""
    is_marker = F.ltrim("value").startswith('{"success":')
    events = lines.filter(F.ltrim("value").startswith("{") & ~is_marker).select(F.from_json("value", EVENT).alias("e"))
    return events.select("e.*").filter("info.name IS NOT NULL")


def _mapped(status: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in names.items():
        out = F.when(F.lower(status) == name, value).otherwise(out)
    return out


def run_events(lines: DataFrame) -> DataFrame:
    """(unique_id, status, seconds, seq) of finished nodes; unknown statuses are errors."""
    done = parsed(lines).filter("info.name = 'NodeFinished' AND data.node_info.unique_id IS NOT NULL")
    status = F.coalesce("data.node_info.node_status", "data.run_result.status")
    return done.select(F.col("data.node_info.unique_id").alias("unique_id"), _mapped(status, RUN_STATUS, "error").alias("status"), F.coalesce("data.run_result.execution_time", "data.node_info.execution_time").alias("seconds"), "seq")


def last_by_id(events: DataFrame) -> DataFrame:
    """The event with the highest seq of each node."""
    return events.groupBy("unique_id").agg(F.max_by(F.struct("status", "seconds"), "seq").alias("last")).select("unique_id", "last.*")


def run_results(lines: DataFrame) -> DataFrame:
    return last_by_id(run_events(lines))


def test_results(lines: DataFrame) -> DataFrame:
    """(unique_id, status, failures, seconds): the last result of each test; without an id its name is used."""
    done = parsed(lines).filter("info.name = 'LogTestResult'")
    rows = done.select(F.coalesce("data.node_info.unique_id", "data.name").alias("unique_id"), _mapped(F.col("data.status"), TEST_STATUS, "error").alias("status"), F.coalesce("data.failures", "data.num_failures", F.lit(0)).alias("failures"), F.coalesce("data.execution_time", "data.elapsed_time").alias("seconds"), "seq")
    last = rows.filter("unique_id IS NOT NULL").groupBy("unique_id").agg(F.max_by(F.struct("status", "failures", "seconds"), "seq").alias("last"))
    return last.select("unique_id", "last.*")


test_results.__test__ = False  # no test of pytest's


def roll_up(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("nodes"), F.round(F.sum("seconds"), 4).alias("seconds"), F.max("seconds").alias("slowest"))


CHANGES = "unique_id string, status string, seconds double, seq long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def node_events(lines: DataFrame) -> DataFrame:
    """(unique_id, status, seconds, seq, at) of nodes that began (``running``, no seconds) or finished.

    ``at`` is the event's time; an event without one takes the time at which it is read.
    """
    seen = parsed(lines).filter("info.name IN ('NodeStart', 'NodeFinished') AND data.node_info.unique_id IS NOT NULL")
    began = F.col("info.name") == "NodeStart"
    ended = _mapped(F.coalesce("data.node_info.node_status", "data.run_result.status"), RUN_STATUS, "error")
    seconds = F.when(~began, F.coalesce("data.run_result.execution_time", "data.node_info.execution_time"))
    at = F.coalesce(F.to_timestamp("info.ts"), F.current_timestamp())
    return seen.select(F.col("data.node_info.unique_id").alias("unique_id"), F.when(began, "running").otherwise(ended).alias("status"), seconds.alias("seconds"), "seq", at.alias("at"))


class NodeWatch(StatefulProcessor):
    """The last event of a node, and one timer: until a running node is ``stuck``, or until a settled one leaves the state."""

    def __init__(self, stuck_ms: int, forget_ms: int):
        self.stuck_ms, self.forget_ms = stuck_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "status string, seconds double, seq long, at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = max(rows, key=lambda r: r.seq)
        if self.node.exists() and self.node.get()[2] >= last.seq:
            return
        at_ms = int(last.at.timestamp() * 1000)
        self.node.update((last.status, last.seconds, last.seq, at_ms))
        self._set_timer(at_ms + (self.stuck_ms if last.status == "running" else self.forget_ms))
        yield Row(unique_id=key[0], status=last.status, seconds=last.seconds, seq=last.seq)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.node.exists():
            return
        status, seconds, seq, at_ms = self.node.get()
        if status != "running":
            self.node.clear()
            return
        self.node.update(("stuck", seconds, seq, at_ms))
        self._set_timer(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)
        yield Row(unique_id=key[0], status="stuck", seconds=seconds, seq=seq)

    def close(self) -> None:
        pass

    def _set_timer(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)


def live_status(spark: SparkSession, folder: str, changes: str, checkpoint: str, late: str = "1 minute", stuck_after: float = 3600, forget_after: float = 86400, compact_every: int = 10) -> StreamingQuery:
    """Keeps the last event of each node over a growing folder of log files; each batch writes the nodes it changed.

    A node that began and has not finished ``stuck_after`` seconds of event time later turns ``stuck``; if it finishes after
    all, it takes that status. ``forget_after`` seconds after it finished or got stuck, a node leaves the state (by an event-time
    timer, as time to live counts by the clock), so the state holds the nodes of that time and not all there ever were.
    Events older than the watermark, which follows the newest event by ``late``, are left out. An event carries its own order, so files out of order change nothing that is newer.

    A batch goes to a folder of its own number under ``changes``, so a batch that runs again replaces itself. Every
    ``compact_every`` batches all that is written becomes one folder with a row per node.
    """
    lines = spark.readStream.schema("value string").text(folder)
    events = node_events(lines).filter("seq IS NOT NULL").withWatermark("at", late)
    watch = NodeWatch(int(stuck_after * 1000), int(forget_after * 1000))
    told = events.groupBy("unique_id").transformWithState(watch, CHANGES, "Update", "eventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")
        if compact_every and number % compact_every == compact_every - 1:
            compact(batch.sparkSession, changes, number)

    stream = told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        return stream.start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _written(spark: SparkSession, changes: str) -> tuple[list[str], list[str]]:
    """(current, outdated) folders under ``changes``: the newest compacted one and the batches after it, and all others."""
    top = spark._jvm.org.apache.hadoop.fs.Path(changes)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{changes}/{n}/_SUCCESS"))]
    number = {n: int(n.partition("=")[2]) for n in done if n.partition("=")[0] in ("batch", "compact")}
    upto = max((i for n, i in number.items() if n.startswith("compact=")), default=-1)
    current = [n for n, i in number.items() if (i == upto if n.startswith("compact=") else i > upto)]
    return [f"{changes}/{n}" for n in sorted(current)], [f"{changes}/{n}" for n in sorted(number.keys() - set(current))]


def _last_written(spark: SparkSession, folders: list[str]) -> DataFrame:
    # A node that got stuck keeps the event that it got stuck on.
    order = F.struct("seq", (F.col("status") == "stuck").alias("is_stuck"))
    rows = spark.read.schema(CHANGES).parquet(*folders) if folders else spark.createDataFrame([], CHANGES)
    return rows.groupBy("unique_id").agg(F.max_by(F.struct("status", "seconds", "seq"), order).alias("last")).select("unique_id", "last.*")


def compact(spark: SparkSession, changes: str, upto: int) -> None:
    """Writes the last row of each node of the batches to ``upto`` as one folder, then deletes those batches.

    A reader sees the batches until the folder is whole. Compacting again after a failure gives the same folder.
    """
    current, _ = _written(spark, changes)
    inside = [f for f in current if int(f.rpartition("=")[2]) <= upto]
    if f"{changes}/compact={upto}" not in inside:
        _last_written(spark, inside).write.mode("overwrite").parquet(f"{changes}/compact={upto}")
    for folder in _written(spark, changes)[1]:
        delete_path(spark, folder)


def latest_status(spark: SparkSession, changes: str) -> DataFrame:
    """(unique_id, status, seconds) of all nodes as last written: the newest compacted folder and the batches after it."""
    return _last_written(spark, _written(spark, changes)[0]).drop("seq")
