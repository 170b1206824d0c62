"""Edge cases on small frames."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions import exprs as E
from tablewright.operators import aggregates as A
from tablewright.operators import datatests as T
from tablewright.operators import graph as G
from tablewright.operators import profile as C
from tablewright.operators import ratings as R
from tablewright.operators import windows as W
from tablewright.plans import steps as P
from tablewright.plans.scratch import Scratch
from tablewright.sources import io as IO
from tablewright.streaming import runlog as L


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", "1,200"), (2, "BOB", "90"), (3, None, None), (4, "=5", "")], "id int, name string, amount string")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("amount: >100", [1]), ("amount: <= 90", [2]), ("amount: >=1,200", [1]), ("name: = ann", [1]), ("name: == bob", [2]), ("name: != ann", [2, 3, 4]), ("name: <> bob", [1, 3, 4]), ("name: != null", [1, 2, 4]),
        ("amount: = null", [3, 4]), ("name: contains o", [2]), ("name: =5", [4]), ("bob", [2]), ("NAME: nn", [1]), ("unknown: x", []),
    ],
)
def test_filter_dsl(people, text, ids):
    assert [r.id for r in people.filter(E.filter_dsl(people, text)).orderBy("id").collect()] == ids


def test_casts_and_dates(spark):
    df = spark.createDataFrame([(2.5, "Tue Oct 24 2023"), (3.5, "nonsense"), (-0.5, None)], "x double, d string")
    assert [r[0] for r in df.select(E.int_round(F.col("x"))).collect()] == [2, 4, 0]
    assert [str(r[0]) for r in df.select(E.parse_us_date(F.col("d"))).collect()] == ["2023-10-24", "None", "None"]


def test_clean_string_and_sorting(people, spark):
    df = spark.createDataFrame([(" a ",), ("",), ("null",), (None,)], "s string")
    assert [r[0] for r in df.select(E.clean_string(F.col("s"))).collect()] == ["a", None, None, None]
    assert [r.id for r in E.sort_nulls_last(people, "amount", True, "id").collect()] == [2, 1, 4, 3]
    assert [r.id for r in E.sort_nulls_last(people, "amount", False, "id").collect()] == [1, 2, 4, 3]


def test_stop_condition(people):
    assert E.stops_at(people.orderBy("id"), "id = 1") and not E.stops_at(people.limit(0), "id = 1")


def test_histogram_and_nulls(spark):
    constant = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert rows(C.histogram(constant, "x")) == [(0, 2)]
    ten = spark.range(11).withColumnRenamed("id", "x")
    assert dict(map(tuple, C.histogram(ten, "x").collect())) == {i: 1 for i in range(9)} | {9: 2}
    texts = spark.createDataFrame([("",), (None,), ("a",), ("b",)], "t string")
    assert rows(C.null_profile(texts)) == [("t", 4, 2, 50.0)]
    assert rows(C.null_profile(texts.limit(0))) == [("t", 0, 0, 0.0)]
    assert rows(C.text_profile(texts, ["t"])) == [("t", 2, "a", 1), ("t", 2, "b", 1)]


def test_data_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "k int, v string")
    assert T.unique(df, "m", ["k"]).first()["failures"] == 1
    assert T.not_null(df, "m", "k", "warn").first()["status"] == "warn"
    assert T.accepted_values(df, "m", "v", ["a", "b"]).first()["failures"] == 1
    assert T.relationships(df, "m", "k", df.filter("k = 2"), "k").first()["failures"] == 2
    assert T.not_empty(df.limit(0), "m").first()["status"] == "fail"
    suite = T.run_suite(df, "m", [T.Check("not_null", "k"), T.Check("accepted_values", "v", ("a", "b", "c"))], [["k"]])
    assert sorted((r.test, r.status, r.failures) for r in suite.collect()) == [("accepted_values", "pass", 0), ("not_null", "fail", 2), ("unique", "fail", 1)]


def test_pipeline_profile_and_fixtures(spark):
    orders = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id int, customer int")
    p = P.Pipeline({"orders": orders}).step("per_customer", lambda t: t["orders"].groupBy("customer").agg(F.count("*").alias("n"))).step("big", lambda t: t["per_customer"].filter("n > 1"))
    assert [tuple(r) for r in P.profile_steps(p.build()).orderBy("step_order").collect()] == [(1, "per_customer", 2), (2, "big", 1)]
    given = P.fixture(spark, [{"customer": 1, "n": 5}, {"customer": 2, "n": 1}], p.build()["per_customer"].schema)
    assert P.test_step(p, "big", {"per_customer": given}, P.fixture(spark, "customer,n\n1,5\n")).count() == 0
    wrong = P.test_step(p, "big", {"per_customer": given}, P.fixture(spark, "customer,n\n2,1\n"))
    assert sorted(r.side for r in wrong.collect()) == ["missing", "unexpected"]
    empty = P.fixture(spark, "customer,n\n")
    assert empty.columns == ["customer", "n"] and empty.count() == 0
    assert P.fixture(spark, [{"b": "1"}, {"a": "x"}]).columns == ["a", "b"]


def test_times_leave_out_failures(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    out = P.time_steps(spark, {"ok": spark.range(5).toDF("x"), "bad": bad})
    assert [(r.step, r.rows) for r in out.collect()] == [("ok", 5)]


def test_observed_chain(spark):
    chain = [("filter", lambda df: df.filter("id % 2 = 0")), ("double", lambda df: df.union(df))]
    assert P.observed_rows(chain[:1], spark.range(10).toDF("id")) == {"filter": 5}
    assert rows(P.profile_chain([("all", lambda df: df), *chain[:1]], spark.range(10).toDF("id"))) == [(1, "all", 10), (2, "filter", 5)]


def test_neutralized_join_keeps_left_rows(spark):
    left, right = spark.range(4).toDF("a"), spark.range(9).toDF("b")
    out = P.neutralize_join(left, right, F.col("a") == F.col("b"))
    assert out.columns == ["a", "b"] and rows(out) == [(i, None) for i in range(4)]


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d")], "parent string, child string")
    assert rows(G.lineage(e, "a")) == [("b", 1), ("c", 2), ("d", 1)]
    assert rows(G.lineage(e, "d", "upstream", 1)) == [("a", 1), ("c", 1)]
    one, two = set(rows(G.lineage(e, "a", depth=1))), set(rows(G.lineage(e, "a", depth=2)))
    assert one < two
    assert rows(G.lineage(e, "zzz")) == []
    # c is two steps up of a by b, one step up by the cycle: the nearest wins.
    assert dict(rows(G.signed_levels(e, "a"))) == {"a": 0, "b": -1, "c": 1, "d": -1}


def test_layers(spark):
    n = spark.createDataFrame([("stg_a", "models/staging", ["raw"], "view"), ("b", "models/staging2", [], "table"), ("c", "models/marts/x", ["gold"], "table")], "name string, path string, tags array<string>, materialized string")
    rules = [("staging", {"folder": "models/staging"}), ("gold", {"any": [{"tag": "gold"}], "folder": "nowhere"}), ("never", {})]
    assert rows(G.classify_layers(n, rules).select("name", "layer")) == [("b", None), ("c", "gold"), ("stg_a", "staging")]


def test_version_diff_tells_null_from_empty(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, ""), (2, "x"), (4, "z")], "k int, v string")
    assert rows(G.version_diff(a, b, "k")) == [(1, "changed"), (3, "removed"), (4, "added")]


def test_scd2_and_upsert(spark):
    h = spark.createDataFrame([(1, "a", "d1", None), (2, "b", "d1", None), (3, None, "d1", None), (1, "old", "d0", "d1")], "k int, v string, valid_from string, valid_to string")
    now = spark.createDataFrame([(1, "A"), (3, None), (4, "n")], "k int, v string")
    out = IO.snapshot_scd2(h, now, "k", ["v"], F.lit("d2"))
    assert set(map(tuple, out.collect())) == {(1, "old", "d0", "d1"), (1, "a", "d1", "d2"), (1, "A", "d2", None), (2, "b", "d1", "d2"), (3, None, "d1", None), (4, "n", "d2", None)}
    assert set(map(tuple, IO.upsert(now, spark.createDataFrame([(4, "m"), (5, "p")], "k int, v string"), ["k"]).collect())) == {(1, "A"), (3, None), (4, "m"), (5, "p")}


def test_exports(spark):
    df = spark.createDataFrame([('a,"b"', None, "t\tx|y")], "p string, q string, r string")
    lines = lambda out: [r.line for r in out.collect()]
    assert lines(IO.export_delimited(df)) == ["p,q,r", '"a,""b""",,t\tx|y']
    assert lines(IO.export_delimited(df, "tsv")) == ["p\tq\tr", 'a,"b"\t\tt x|y']
    assert lines(IO.export_markdown(df)) == ["| p | q | r |", "| --- | --- | --- |", '| a,"b" |  | t\tx\\|y |']
    assert lines(IO.export_delimited(df.toDF("p,1", 'q"', "r"), header=True))[0] == '"p,1","q""",r'
    assert lines(IO.export_markdown(df.limit(0), header=False)) == [] and len(lines(IO.export_delimited(df, header=False))) == 1


def test_tables_replace_themselves(spark, tmp_path):
    for n in (3, 2):
        assert IO.materialize(spark.range(n).toDF("x"), "replaced", "table", f"file://{tmp_path}/t").count() == n
    spark.sql("DROP TABLE replaced")


def test_seed_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "seed.csv"
    p.write_bytes(b"\xef\xbb\xbfid,name\n1,a\n2,\n")
    assert rows(IO.read_seed(spark, f"file://{p}", "id int, name string")) == [(1, "a"), (2, None)]


def test_ranks_and_decisions(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 5, 2), (4, 3, 0)], "team int, wins int, x int")
    out = {r.team: r.decided_by for r in W.deciding_criterion(df, ["wins"], ["x", "team"]).collect()}
    assert out == {1: "x", 2: "x", 3: "x", 4: "record"}


def test_ranks_by_ranges(spark):
    from tablewright.operators import aggregates as A

    data = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0), (None, 2.0), (None, 3.0), ("c", None), ("a", None)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id long, k string, v double").repartition(5)
    scratch = Scratch(spark, "ranks")
    got = {r.id: r.place for r in W.ranked_values(df, "k", "v", scratch).collect()}
    # Nulls come last, as in a descending sort.
    height = lambda v: float("-inf") if v is None else v
    assert got == {i: 1 + sum(height(w) > height(v) for q, w in data if q == k) for i, (k, v) in enumerate(data)}
    seeds = {r.id: r.label for r in W.reseed(df, "k", [F.desc("v"), F.asc("id")], F.lit("s"), scratch).collect()}
    for k in {k for k, _ in data}:
        order = sorted((i for i, (q, _) in enumerate(data) if q == k), key=lambda i: (-height(data[i][1]), i))
        assert [seeds[i] for i in order] == [f"s-{n}" for n in range(1, len(order) + 1)]
    out = {r.k: r for r in A.interval_summary(df, ["k"], "v", scratch).collect()}
    values = sorted(v for k, v in data if k == "a" and v is not None)
    at = lambda q: values[int(q * 49)] + (values[min(49, int(q * 49) + 1)] - values[int(q * 49)]) * (q * 49 % 1)
    assert abs(out["a"].low - at(0.05)) < 1e-9 and abs(out["a"].high - at(0.95)) < 1e-9 and out["b"].low == 1.0
    assert out[None].low == 2.05 and out["c"].low is None and A.interval_summary(df.limit(0), ["k"], "v", scratch).count() == 0


def test_search_without_a_depth(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "parent string, child string")
    start = spark.createDataFrame([("0",)], "id string")
    assert G.reach(e, start, depth=3).count() == 3 and G.reach(e, start, depth=None).count() == 12
    assert dict(rows(G.invalidated(e, start)))["12"] == 12


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from tablewright.plans import scratch

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(Cluster)


@pytest.fixture
def one_state(spark):
    """A single partition of state: small streams spend their time on opening these."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_live_status_over_growing_logs(spark, tmp_path, one_state):
    event = lambda node, status, seq: '{"info":{"name":"NodeFinished"},"data":{"node_info":{"unique_id":"%s","node_status":"%s"},"run_result":{"execution_time":1.5}},"seq":%d}' % (node, status, seq)
    for i, lines in enumerate([[event("a", "success", 5), event("b", "warn", 1)], [event("a", "error", 3), event("b", "success", 2), "no event"], [event("c", "skipped", 9)]]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"file://{tmp_path}/logs")
        L.live_status(spark, f"file://{tmp_path}/logs", f"file://{tmp_path}/changes", f"file://{tmp_path}/checkpoint").awaitTermination()
        if i == 0:
            assert rows(L.latest_status(spark, f"file://{tmp_path}/changes")) == [("a", "success", 1.5), ("b", "warn", 1.5)]
    assert rows(L.latest_status(spark, f"file://{tmp_path}/changes")) == [("a", "success", 1.5), ("b", "success", 1.5), ("c", "skipped", 1.5)]


def test_stuck_late_and_forgotten_nodes(spark, tmp_path, one_state):
    def line(node, minute, seq, status=None):
        info = {"name": "NodeFinished" if status else "NodeStart", "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}
        node_info = {"unique_id": node, "node_status": status or "started"} | ({"execution_time": 2.0} if status else {})
        return json.dumps({"info": info, "data": {"node_info": node_info}, "seq": seq})

    folder, changes, checkpoint = (f"file://{tmp_path}/{x}" for x in ("logs", "changes", "checkpoint"))

    def after(*lines, **options):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)
        query = L.live_status(spark, folder, changes, checkpoint, late="10 minutes", stuck_after=3600, forget_after=7200, **options)
        query.awaitTermination()
        states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        return {r.unique_id: r.status for r in L.latest_status(spark, changes).collect()}, states[-1]

    # Each call is a stream of its own that goes on from the checkpoint.
    seen, _ = after(line("a", 0, 1), line("b", 5, 2), line("b", 6, 3, "success"), line("c", 40, 4))
    assert seen == {"a": "running", "b": "success", "c": "running"}
    seen, _ = after(line("d", 75, 5, "skipped"))
    assert seen == {"a": "stuck", "b": "success", "c": "running", "d": "skipped"}
    # An event older than the watermark (minute 65) is too late; c's is younger, and a comes back.
    seen, _ = after(line("e", 20, 6), line("c", 70, 7, "fail"), line("a", 76, 8, "warn"), compact_every=1)
    assert seen == {"a": "warn", "b": "success", "c": "error", "d": "skipped"}
    # Long after, only the newest node is in the state; what was written stays.
    seen, held = after(line("f", 600, 9), compact_every=1)
    assert seen == {"a": "warn", "b": "success", "c": "error", "d": "skipped", "f": "running"} and held == 1
    assert len([p for p in (tmp_path / "changes").iterdir()]) == 1


def test_margins_and_neutral_games(spark):
    g = spark.createDataFrame([(1, 1, 1, 2, 90, 100, False), (2, 1, 1, 2, 100, 90, True)], "game_id long, season long, visiting_team int, home_team int, visiting_score int, home_score int, neutral boolean")
    first = {1: 1500.0, 2: 1600.0}
    out = {r.game_id: r for r in R.rolled_ratings(g, first, margins=R.power_margin).collect()}
    expected = 1 / (10 ** (-200 / 400) + 1)
    assert abs(out[1].home_after - (1600 + 20 * 13**0.8 / (7.5 - 0.006 * 200) * (1 - expected))) < 1e-9
    ahead = out[1].home_after - out[1].visiting_after  # the second game has no home bonus
    expected = 1 / (10 ** (-ahead / 400) + 1)
    assert abs(out[2].home_after - (out[1].home_after + 20 * 13**0.8 / (7.5 + 0.006 * ahead) * (0 - expected))) < 1e-9


def test_rating_roll_forward_conserves_points(spark):
    g = spark.createDataFrame([(2, 1, 1, 2, 90, 100), (1, 1, 2, 1, 80, 80), (3, 2, 1, 2, 70, 60)], "game_id long, season int, visiting_team int, home_team int, visiting_score int, home_score int")
    out = {r.game_id: r for r in R.rolled_ratings(g, {1: 1500.0, 2: 1600.0}).collect()}
    assert all(abs(r.visiting_before + r.home_before - r.visiting_after - r.home_after) < 1e-9 for r in out.values())
    assert out[2].visiting_before == out[1].home_after and out[1].home_after == out[1].home_before  # no margin, no change
    assert out[3].visiting_before == 1500.0  # a season starts from the first ratings


def test_rating_roll_forward_holds_a_batch_at_a_time(spark):
    games = [(i, i % 3 or None, i % 5, 5 + i % 4, 90 + i % 7, 95) for i in range(60)]
    g = spark.createDataFrame(games[::-1], "game_id long, season int, visiting_team int, home_team int, visiting_score int, home_score int")
    df = R.rolled_ratings(g, {1: 1600.0})
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()  # which holds a season at once
    whole = rows(df)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert rows(R.rolled_ratings(g, {1: 1600.0})) == whole and len(whole) == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    last = {}
    for r in sorted(whole, key=lambda r: r[1]):
        for team, before, after in ((r[2], r[4], r[6]), (r[3], r[5], r[7])):
            assert before == last.get((r[0], team), 1600.0 if team == 1 else 1500.0)
            last[r[0], team] = after


def test_multi_way_ties(spark):
    """Two seasons of eight teams against a plain statement of the rules."""
    import random

    r = random.Random(3)
    teams = {t: (t % 2, r.randint(0, 1), r.randint(0, 2), r.randint(0, 2), r.choice([-5, 0, 5])) for t in range(16)}  # conf, division wins, conf wins, ...
    records = [(s, teams[t][0], 0, 5 + (t % 8 == 7), t, teams[t][1] * (s == 1), teams[t][2], teams[t][4]) for s in (1, 2) for t in range(16)]
    games = [(s, a, b, w) for s in (1, 2) for a in range(16) for b in range(a + 1, 16) if (a + b * s) % 3 for w in [r.randint(0, 1)]]
    games += [(s, b, a, 1 - w) for s, a, b, w in games]
    table = spark.createDataFrame(records, "season long, conf int, division int, wins long, team int, division_wins long, conf_wins long, point_diff long")
    got = {(x.season, x.team): (x.place, x.rule) for x in R.multi_way_ties(spark.createDataFrame(games, "season long, team int, opponent int, won int"), table).collect()}

    def rate(season, team, group):
        won = [w for s, a, b, w in games if s == season and a == team and b in group]
        return sum(won) / len(won) if won else 0.0

    want = {}
    for season in (1, 2):
        for conf in (0, 1):
            for wins in (5, 6):
                todo = [([x[4] for x in records if (x[0], x[1], x[3]) == (season, conf, wins)], None)]
                if len(todo[0][0]) < 3:
                    continue
                own = {x[4]: x for x in records if x[0] == season}
                place = 0
                while todo:
                    group, by = todo.pop(0)
                    rules = [("head_to_head", lambda t: rate(season, t, group)), ("division", lambda t: own[t][5]), ("conference", lambda t: own[t][6]), ("point_diff", lambda t: own[t][7])]
                    rule = next(((n, f) for n, f in rules if len({f(t) for t in group}) > 1), None)
                    if len(group) == 1 or rule is None:
                        for t in sorted(group):
                            place += 1
                            want[season, t] = place, by if len(group) == 1 else "team"
                        continue
                    values = {t: rule[1](t) for t in group}
                    todo = [([t for t in group if values[t] == v], rule[0]) for v in sorted(set(values.values()), reverse=True)] + todo
    assert got == want and len({rule for _, rule in want.values()}) > 2


def test_run_logs(spark):
    event = lambda node, status, seq, name="NodeFinished": '{"info":{"name":"%s"},"data":{"node_info":{"unique_id":"%s","node_status":"%s"},"run_result":{"status":"success","execution_time":1.5}},"seq":%d}' % (name, node, status, seq)
    lines = [event("a", "success", 1), event("a", "strange", 2), event("b", "skipped", 1), event("c", "success", 1, "Other"), "not json", "{broken", '{"success": true}', ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(L.run_results(df)) == [("a", "error", 1.5), ("b", "skipped", 1.5)]
    test = '{"info":{"name":"LogTestResult"},"data":{"name":"t1","status":"fail","num_failures":3,"elapsed_time":0.5},"seq":1}'
    assert rows(L.test_results(spark.createDataFrame([(test,)], "value string"))) == [("t1", "fail", 3, 0.5)]


def test_unique_keys_share_one_shuffle(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", None), (None, "a", 2.0), (None, "a", 2.0), (3, "c", 5.0), (3, "c", 6.0)], "k int, s string, of double")
    keys = [["k"], ["s"], ["k", "s"], ["of"], ["s", "of"], ["k", "s", "of"]]
    plan = T.unique_keys(df, "m", keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and plan.count("Scan ") == 1
    assert rows(T.unique_keys(df, "m", keys)) == sorted((r for k in keys for r in rows(T.unique(df, "m", k))), key=repr)
    assert rows(T.unique_keys(df.limit(0), "m", keys[:2])) == [("unique", "m", "k", "pass", 0), ("unique", "m", "s", "pass", 0)]


def test_interval_summary_is_the_same_by_ranges(spark, tmp_path):
    df = spark.range(500).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 490, "b").otherwise(None).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    df = df.unionByName(spark.createDataFrame([("c", None)], "k string, v double"))
    near = lambda r: [(x[0], *[None if v is None else round(v, 9) for v in x[1:]]) for x in r]
    small, large = (near(rows(A.interval_summary(df, ["k"], "v", Scratch(spark, "test"), group_rows=n))) for n in (1000, 100))
    assert small == large and len(small) == 4


def test_user_functions_of_both_kinds(spark):
    from tablewright.functions import user as U

    twice = U.UserFunction("twice_it", [("a", "int")], "bigint", "a * 2", tags=("demo",))
    twice.create(spark)
    df = spark.createDataFrame([("a", "2", 1.0), ("a", "8", 3.0), ("b", "-1", None), ("b", None, 2.0)], "k string, x string, w double")
    assert rows(df.filter("x > 0").select(twice("x").alias("y"))) == [(16,), (4,)]
    out = df.groupBy("k").agg(U.GEOMETRIC_MEAN("x").alias("g"), U.WEIGHTED_MEAN("x", F.col("w")).alias("m"))
    assert [(r[0], None if r[1] is None else round(r[1], 9), r[2]) for r in rows(out)] == [("a", 4.0, 6.5), ("b", None, None)]
    with pytest.raises(TypeError, match="takes 2"):
        U.WEIGHTED_MEAN("x")
    found = U.function_inventory(spark, [twice, U.WEIGHTED_MEAN])
    assert rows(found.select("name", "kind", "arguments", "returns")) == [("twice_it", "scalar", "a int", "bigint"), ("weighted_mean", "aggregate", "x double, weight double", "double")]
