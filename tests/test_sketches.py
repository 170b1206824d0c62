"""Profiles from merged states against exact ones, with the bounds stated."""

from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import sketches as K


def values(spark, n=40_000, periods=84):
    x = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000).alias("x")
    word = F.concat(F.lit("w"), F.floor(F.pow(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0, 3) * 3000).cast("string"))
    return spark.range(n).select((F.col("id") % periods).alias("period"), F.when(F.col("id") % 50 > 0, x).alias("x"), F.when(F.col("id") % 20 > 0, word).otherwise("").alias("w"), F.lit(None).cast("string").alias("nothing"), F.lit(3.5).alias("same"))


def test_merged_states_keep_their_bounds(spark):
    df = values(spark).cache()
    states = K.number_states(df, ["period"], ["x", "same"])
    assert states.count() == 2 * 84
    got = {r.column: r for r in K.number_profile(states, at=(0.01, 0.25, 0.5, 0.99)).collect()}
    exact = df.agg(F.count("x"), F.min("x"), F.max("x"), F.avg("x")).first()
    assert (got["x"].n, got["x"].nulls, got["x"].least, got["x"].greatest) == (exact[0], 800, exact[1], exact[2]) and abs(got["x"].mean - exact[3]) < 1e-9
    for q, v in zip((0.01, 0.25, 0.5, 0.99), got["x"].quantiles):
        rank = df.filter(F.col("x") <= v).count() / exact[0]
        assert abs(rank - q) <= 2 * K.rank_error()
    assert got["same"].quantiles == [3.5] * 4
    bars = K.histogram_from_states(states).collect()
    assert [r.n for r in sorted((r for r in bars if r.column == "same"), key=lambda r: r.bucket)] == [40_000] + [0] * 9
    wanted = dict(df.filter("x IS NOT NULL").groupBy(F.least(F.lit(9), F.floor((F.col("x") - exact[1]) / (exact[2] - exact[1]) * 10)).alias("b")).count().collect())
    assert all(abs(r.n - wanted[r.bucket]) <= (4 * K.rank_error() + 2 / K.GRID) * exact[0] for r in bars if r.column == "x")


def test_texts_from_states(spark):
    df = values(spark).cache()
    states = K.text_states(df, ["period"], ["w", "nothing"])
    got = rows(K.text_profile_from_states(states, top=3))
    exact = df.filter("w <> ''").groupBy("w").count().collect()
    assert {r[0] for r in got} == {"w"} and got[0][1:3] == (38_000, 2_000)
    assert abs(got[0][3] - len(exact)) <= 4 * K.distinct_error() * len(exact)
    best = sorted(exact, key=lambda r: (-r["count"], r.w))[:3]
    assert len(got) == 3 and all(abs(r[5] - {x.w: x["count"] for x in exact}[r[4]]) <= K.count_error(38_000) for r in got) and best[0].w in {r[4] for r in got}
    # With no more values than are tracked, counts and ties are exact.
    few = df.withColumn("w", F.concat(F.lit("v"), (F.col("period") % 7).cast("string")))
    assert rows(K.text_profile_from_states(K.text_states(few, ["period"], ["w"]), top=7).select("value", "value_n")) == rows(few.groupBy("w").count())


def test_one_period_is_replaced_alone(spark, tmp_path):
    df = values(spark, 2_000, 6).cache()
    K.store_states(K.number_states(df, ["period"], ["x"]), f"file://{tmp_path}/s", "period")
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    changed = df.filter("period = 4").withColumn("x", F.col("x") + 10_000)
    K.store_states(K.number_states(changed, ["period"], ["x"]), f"file://{tmp_path}/s", "period")
    kept = [p for p in tmp_path.rglob("*.parquet") if files.get(p) == p.stat().st_mtime_ns]
    assert len(kept) == len(files) - 1 and not [p for p in kept if "period=4" in str(p)]
    stored = spark.read.parquet(f"file://{tmp_path}/s")
    now = df.filter("period <> 4").unionByName(changed)
    some = stored.filter("period IN (3, 4)")
    for states, rows_ in ((stored, now), (some, now.filter("period IN (3, 4)"))):
        r = K.number_profile(states).first()
        assert (r.n, r.least, r.greatest) == tuple(rows_.agg(F.count("x"), F.min("x"), F.max("x")).first())
    assert K.number_profile(stored.limit(0)).collect() == [] and K.text_profile_from_states(K.text_states(df.limit(0), ["period"], ["w"])).collect() == []


def test_group_without_values(spark):
    df = spark.createDataFrame([(1, None, ""), (1, None, None), (2, 5.0, "a")], "period int, x double, w string")
    assert rows(K.number_profile(K.number_states(df, ["period"], ["x"]), ["period"], (0.5,)).select("period", "n", "nulls", "mean", "quantiles")) == [(1, 0, 2, None, None), (2, 1, 0, 5.0, [5.0])]
    assert rows(K.text_profile_from_states(K.text_states(df, ["period"], ["w"]))) == [("w", 1, 2, 1, "a", 1)]
