"""Pipelines of named steps, and what running them tells: rows, time, fan-out, empty steps, what-if joins."""

from __future__ import annotations

import csv
import functools
import io
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tablewright.plans.scratch import Scratch

Step = Callable[[dict[str, DataFrame]], DataFrame]


class Pipeline:
    """An ordered list of named steps; each builds a DataFrame from the sources and the steps before it."""

    def __init__(self, sources: dict[str, DataFrame]):
        self.sources, self.steps = dict(sources), {}

    def step(self, name: str, build: Step) -> Pipeline:
        self.steps[name] = build
        return self

    def build(self, replaced: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All steps by name, in order. ``replaced`` stands in for sources or steps of that name."""
        replaced = replaced or {}
        known = self.sources | replaced
        out = {}
        for name, build in self.steps.items():
            known[name] = out[name] = replaced[name] if name in replaced else build(known)
        return out


def _counted(name: str, order: int, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select(F.lit(order).alias("step_order"), F.lit(name).alias("step"), "rows")


def profile_steps(steps: dict[str, DataFrame]) -> DataFrame:
    """(step_order, step, rows) of every step, in one job."""
    return functools.reduce(DataFrame.unionByName, [_counted(n, i, df) for i, (n, df) in enumerate(steps.items(), 1)])


class _Recording(dict):
    """Frames by name that note which of them are asked for."""

    def __init__(self, frames: dict[str, DataFrame]):
        super().__init__(frames)
        self.asked: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        self.asked.append(name)
        return super().__getitem__(name)


def step_inputs(pipeline: Pipeline) -> dict[str, list[str]]:
    """The sources and steps that each step reads, as often as it asks for them."""
    known, inputs = dict(pipeline.sources), {}
    for name, build in pipeline.steps.items():
        seen = _Recording(known)
        known[name] = build(seen)
        inputs[name] = seen.asked
    return inputs


def observed_steps(pipeline: Pipeline, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """(frames, observations): every step of a pipeline made ready to be counted while the pipeline runs once.

    A step that several others read, or one twice, is written once and read from there; any other is part of the one plan that
    reads it. ``frames`` holds the steps that nothing reads, still to be run; observations fill as their plans run.
    """
    inputs = step_inputs(pipeline)
    uses = Counter(name for asked in inputs.values() for name in asked)
    known, names, seen = dict(pipeline.sources), {}, {}
    for name, build in pipeline.steps.items():
        df = build(known)
        # A frame asked for once may still be used twice, as in a join with itself.
        plan = df._jdf.queryExecution().analyzed().toString()
        twice = [x for x in set(inputs[name]) & set(seen) if plan.count(f"CollectMetrics {names[x]},") > 1]
        for x in twice:
            known[x] = scratch.table(known[x], x)
        df = build(known) if twice else df
        names[name] = f"{len(names)}-{uuid.uuid4().hex}"
        seen[name] = Observation(names[name])
        known[name] = df.observe(seen[name], F.count(F.lit(1)).alias("rows"))
        if uses[name] > 1:
            known[name] = scratch.table(known[name], name)
    return {name: known[name] for name in pipeline.steps if not uses[name]}, seen


def _seen_rows(seen: Observation) -> int | None:
    """The rows that an observation counted, or nothing if its step was planned away while it ran."""
    try:
        return seen.get.get("rows")
    except Py4JJavaError:
        return None


def profile_pipeline(pipeline: Pipeline, scratch: Scratch) -> DataFrame:
    """(step_order, step, rows) of every step of a branching pipeline that runs once, where ``profile_steps`` runs each from its sources.

    A step whose rows nothing needed to see, because a join's other side was empty, is counted by itself. Counts are kept by
    accumulators: if lost executors make Spark run a finished stage again, its rows count again.
    """
    frames, seen = observed_steps(pipeline, scratch)
    for df in frames.values():
        df.write.format("noop").mode("overwrite").save()
    counts = {name: _seen_rows(o) for name, o in seen.items()}
    if None in counts.values():
        whole = pipeline.build()
        counts = {name: whole[name].count() if n is None else n for name, n in counts.items()}
    rows = [(i, name, counts[name]) for i, name in enumerate(pipeline.steps, 1)]
    return scratch.spark.createDataFrame(rows, "step_order int, step string, rows long")


def observed_rows(chain: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], first: DataFrame) -> dict[str, int]:
    """Rows after each link of a chain of steps, counted while the chain runs once."""
    seen, df = {}, first
    for name, build in chain:
        seen[name] = Observation()
        df = build(df).observe(seen[name], F.count(F.lit(1)).alias("rows"))
    df.write.format("noop").mode("overwrite").save()
    # A link that is planned away because its input is empty reports nothing.
    return {name: o.get.get("rows", 0) for name, o in seen.items()}


def profile_chain(chain: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], first: DataFrame) -> DataFrame:
    """(step_order, step, rows) of a chain of steps that runs once, where ``profile_steps`` runs each step from its sources."""
    rows = [(i, name, n) for i, (name, n) in enumerate(observed_rows(chain, first).items(), 1)]
    return first.sparkSession.createDataFrame(rows, "step_order int, step string, rows long")


def time_steps(spark: SparkSession, steps: dict[str, DataFrame]) -> DataFrame:
    """(step_order, step, rows, seconds, marginal_seconds, fraction): each step is run once after a warm-up run.

    A step that fails is left out. A marginal time is what a step adds to the one before; fractions are of the slowest
    run's time.
    """
    rows, before = [], 0.0
    for i, (name, df) in enumerate(steps.items(), 1):
        try:
            df.write.format("noop").mode("overwrite").save()
            seen, began = Observation(), time.monotonic()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            took = time.monotonic() - began
        except Exception:  # a step that fails leaves a partial result, as asked
            continue
        rows.append((i, name, int(seen.get["rows"]), took, max(0.0, took - before)))
        before = took
    total = max((r[3] for r in rows), default=0.0)
    return spark.createDataFrame([(*r, r[3] / total if total else 0.0) for r in rows], "step_order int, step string, rows long, seconds double, marginal_seconds double, fraction double")


def heat_tier(df: DataFrame, value: str) -> DataFrame:
    """hot from half of the largest value, warm from a fifth, else cool. ``df`` has a row per step."""
    share = F.col(value) / F.max(value).over(Window.partitionBy())
    return df.withColumn("tier", F.when(share >= 0.5, "hot").when(share >= 0.2, "warm").otherwise("cool"))


def fan_out(profile: DataFrame, threshold: float = 1.0, only: Column | None = None) -> DataFrame:
    """``profile`` with prev_rows and fan_out: rows above ``threshold`` times those of the step before."""
    prev = F.lag("rows").over(Window.orderBy("step_order"))
    flag = F.coalesce(F.col("rows") > F.col("prev_rows") * threshold, F.lit(False))
    return profile.withColumn("prev_rows", prev).withColumn("fan_out", flag if only is None else flag & only)


def empty_steps(profile: DataFrame) -> DataFrame:
    return profile.withColumn("is_empty", F.col("rows") == 0)


def leg_counts(legs: dict[str, DataFrame]) -> DataFrame:
    """Rows of each leg of a union."""
    return functools.reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("leg"), "rows") for n, df in legs.items()])


def key_multiplicity(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, left_rows, right_rows, joined_rows) of the keys that a join multiplies."""
    lefts = left.groupBy(F.col(left_key).alias("key")).agg(F.count("*").alias("left_rows"))
    rights = right.groupBy(F.col(right_key).alias("key")).agg(F.count("*").alias("right_rows")).filter("right_rows > 1")
    return lefts.join(rights, "key").withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))


def neutralize_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """What-if: the joined schema with a right side that matches nothing, so that only the left rows remain."""
    return left.join(right.limit(0), on, "left")


def with_total(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """A sample of ``limit`` rows by ``order`` beside the number of all rows, which is counted apart."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def fixture(spark: SparkSession, given: Sequence[dict] | str, schema: StructType | None = None) -> DataFrame:
    """A small frame from dicts or CSV text.

    Columns are the schema's or the sorted union of all keys; missing values are null. Without a schema, text that looks
    like a number is one. An empty fixture keeps its columns (or the header of its CSV).
    """
    if isinstance(given, str):
        reader = csv.DictReader(io.StringIO(given.strip()))
        rows, header = [{k: v or None for k, v in r.items()} for r in reader], list(reader.fieldnames or [])
    else:
        rows, header = [dict(r) for r in given], []
    if schema is not None:
        raw = spark.createDataFrame([tuple(None if r.get(f.name) is None else str(r[f.name]) for f in schema) for r in rows], StructType().add("_", "string") if not schema.fields else ", ".join(f"`{f.name}` string" for f in schema))
        return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    columns = header or sorted({k for r in rows for k in r})
    texts = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    looks = lambda c: all(re.fullmatch(r"-?\d+(\.\d+)?", str(r[c])) for r in rows if r.get(c) is not None) and any(r.get(c) is not None for r in rows)
    whole = lambda c: all("." not in str(r[c]) for r in rows if r.get(c) is not None)
    return texts.select(*[F.col(f"`{c}`").cast("long" if whole(c) else "double") if looks(c) else F.col(f"`{c}`") for c in columns])


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Multiset difference both ways, with side ``missing`` (expected only) or ``unexpected`` (actual only)."""
    wanted = expected.select(*actual.columns)
    return wanted.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(wanted).withColumn("side", F.lit("unexpected")))


def test_step(pipeline: Pipeline, step: str, given: dict[str, DataFrame], expect: DataFrame) -> DataFrame:
    """Runs one step with its inputs replaced by ``given``; inputs not given are empty. Returns the differences."""
    empty = {n: df.limit(0) for n, df in (pipeline.sources | pipeline.build()).items() if n not in given and n != step}
    actual = pipeline.build(empty | given)[step]
    return compare(actual.select(*expect.columns), expect)


test_step.__test__ = False  # no test of pytest's
