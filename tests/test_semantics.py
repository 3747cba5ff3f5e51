"""Fixed cases: percentiles, rates, durations, cursors, predicates, state machines, graphs, cron, codecs."""

import pytest
from pyspark.sql import functions as F

from opsloom.functions import exprs as X
from opsloom.functions import predicates as P
from opsloom.functions import udfs as U
from opsloom.operators import dispatch as D
from opsloom.operators import graph as G
from opsloom.operators import joins as J
from opsloom.operators import lifecycle as K
from opsloom.operators import listing as L
from opsloom.operators import stateful as S
from opsloom.operators import stats as A
from opsloom.plans import registry
from opsloom.sources import shared
from opsloom.sources.catalog import Catalog


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_index_percentiles(spark):
    df = spark.range(1, 11).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    r = X.index_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (r["p50"], r["p95"], r["p99"]) == (6, 10, 10)
    assert X.index_percentiles(df.where("false"), ["k"], "v", {"p50": 0.5}).count() == 0
    same = spark.range(1000).select(F.lit("k").alias("k"), F.lit(7).alias("v"))
    assert X.index_percentiles(same, ["k"], "v", {"p50": 0.5}).first()["p50"] == 7


@pytest.mark.parametrize("text,want", [("100/m", (100.0, 100 / 60)), ("50/s", (50.0, 50.0)), ("3600/h", (3600.0, 1.0)), ("x", None), ("5/d", None), (None, None), ("60/min", (60.0, 1.0)), (" 7 / hour ", (7.0, 7 / 3600)), ("1/2/s", None), ("invalid", None)])
def test_rates(spark, text, want):
    r = one(spark, X.rate("t"), t=text)
    assert r == want if want is None else (r["max_tokens"], r["refill_rate"]) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("500ms", 500), ("2.5s", 2500), ("5m", 300_000), ("1h", 3_600_000), ("1d", 86_400_000), ("2H", 7_200_000), ("10MS", 10), ("0s", None), ("5", None), ("x", None), (None, None)])
def test_durations(spark, text, want):
    assert one(spark, X.duration_ms("t"), t=text) == want


def test_cursors(spark):
    assert one(spark, X.encode_cursor("k", "i"), k=5, i="a:b") == "5:a:b"
    assert tuple(one(spark, X.decode_cursor("c"), c="5:a:b")) == (5, "a:b")
    assert one(spark, X.decode_cursor("c"), c="-5:a") is None and one(spark, X.decode_cursor("c"), c="5:") is None


def test_pages_of_nothing(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("id"), F.col("id").alias("t"))
    assert L.page(df, "t", 0).count() == 0 == L.page(df, "t", -3).count()
    assert [r["id"] for r in L.page_after(df, "t", 2, (3, "3")).collect()] == ["2", "1"]
    assert L.next_cursor(L.page(df, "t", 3), "t", 3).first()[0] == "2:2"
    assert L.next_cursor(L.page(df, "t", 9), "t", 9).first()[0] is None


@pytest.mark.parametrize("ms,want", [(None, "\u2014"), (-1, "\u2014"), (0, "0ms"), (999, "999ms"), (1005, "1.00s"), (1125, "1.13s"), (9994, "9.99s"), (10_250, "10.3s"), (59_940, "59.9s"), (61_600, "1m 2s"), (3_600_000, "1h 0m"), (5_400_000, "1h 30m")])
def test_durations_as_text(spark, ms, want):
    assert one(spark, X.format_duration(F.col("m").cast("long")), m=ms) == want


@pytest.mark.parametrize("ms,want", [(None, "Kept forever"), (0, "Purged immediately"), (-5, "Purged immediately"), (86_400_000, "1 day"), (7_200_000, "2 hours"), (60_000, "1 minute"), (1, "1 second"), (1500, "2 seconds"), (90_500, "91 seconds")])
def test_windows_as_text(spark, ms, want):
    assert one(spark, X.format_window(F.col("m").cast("long")), m=ms) == want


@pytest.mark.parametrize(
    "error,name,reason",
    [
        ("Traceback\n  File\nValueError: permanent failure", "ValueError", "permanent failure"), ("app.errors.PaymentError: declined", "app.errors.PaymentError", "declined"), ("KeyError", "KeyError", "KeyError"),
        ('{"errtype":"A","message":"m","traceback":[]}', "A", "m"), ('{"message":""}', "Error", "(no error captured)"), (None, "Error", "(no error captured)"), ("  ", "Error", "(no error captured)"), ("oops", "Error", "oops"),
    ],
)
def test_errors(spark, error, name, reason):
    assert (one(spark, X.exception_class(F.col("e").cast("string")), e=error), one(spark, X.error_reason(F.col("e").cast("string")), e=error)) == (name, reason)


def test_structured_errors_come_back(spark):
    text = X.encode_error("t", "m", F.array(F.lit("l1"), F.lit("l2")))
    assert one(spark, X.structured_error(text), t="E", m='say "x":') == ("E", 'say "x":', ["l1", "l2"])
    assert one(spark, X.structured_error("e"), e='{"message": 5}') is None


def desired(spark, pending, running, workers, **config):
    df = spark.createDataFrame([(pending, running, workers)], "pending long, running long, current_workers long")
    return A.desired_workers(df, **({"target": 10, "target_utilization": 0.8, "least": 1, "most": 10} | config)).first()["desired"]


def test_desired_workers(spark):
    assert desired(spark, 45, 0, 1) == 5 and desired(spark, 1000, 0, 1) == 10 and desired(spark, 0, 0, 5) == 1
    assert desired(spark, 0, 8, 2, threads=4) == 3  # full threads
    assert desired(spark, 0, 9, 2, threads=4, target_utilization=10.0) == 3  # more running than threads
    assert desired(spark, 109, 0, 10, most=20, tolerance=0.2) == 10 and desired(spark, 109, 0, 10, most=20) == 11  # the band is open above


def test_compaction_within_a_budget(spark):
    messages = spark.createDataFrame([("t", f"{i}", 0, 5 if i == 7 else None) for i in range(10)], "topic string, id string, created_at long, expires_at long")
    floors = spark.createDataFrame([("t", "3")], "topic string, floor string")
    acked = spark.createDataFrame([("t", "5"), ("t", "0")], "topic string, id string")
    left = lambda n: sorted(r["id"] for r in J.compacted(messages, floors, acked, 10, n).collect())
    assert left(100) == ["4", "6", "8", "9"] and left(0) == [str(i) for i in range(10)]
    assert left(2) == ["1", "2", "3", "4", "5", "6", "8", "9"]  # the expired one, then the first behind the cursors


def test_transitions():
    assert ("completed", "compensating") in G.TRANSITIONS and ("failed", "running") not in G.TRANSITIONS and len(G.TRANSITIONS) == 14


def test_flags_and_quoted_marks(spark, monkeypatch):
    act = lambda c, **v: one(spark, c["action"], **v)
    monkeypatch.setenv("FF_NEW", "true")
    assert act(P.parse('feature_flag("new")')) == "run" and act(P.parse('feature_flag("old")')) == "skip" and act(P.parse('!feature_flag("old")')) == "run"
    with pytest.raises(ValueError):
        P.parse('feature_flag("x", provider="nobody")')
    assert act(P.parse('payload_matches("a", equals="x!y")'), payload='{"a":"x!y"}') == "run"
    assert act(P.parse('!payload_matches("a", equals="!")'), payload='{"a":"!"}') == "skip"


def test_overwriting_a_table_by_its_survivors(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.overwrite(spark.range(5), "t")
    c.overwrite(c.t.where("id > 2"), "t")
    assert sorted(r["id"] for r in c.t.collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]
    with pytest.raises(Exception, match="half way"):
        c.overwrite(c.t.withColumn("x", F.when(F.col("id") == 4, F.raise_error(F.lit("half way"))).cast("string")), "t")
    assert sorted(r["id"] for r in c.t.collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_older_files_lack_columns(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.append(spark.range(2), "t")
    c.append(spark.range(2, 4).select("id", F.lit("n").alias("note"), F.lit(1).alias("gone")), "t")
    assert sorted(map(tuple, c.read("t", "id bigint, note string").collect())) == [(0, None), (1, None), (2, "n"), (3, "n")]


def test_log_lag_at_the_edges(spark):
    messages = spark.createDataFrame([("t", f"{i}", 100 + i) for i in range(6)], "topic string, id string, created_at long")
    subs = [("t", "none", None, "log"), ("t", "mid", "2", "log"), ("t", "between", "25", "log"), ("t", "last", "5", "log"), ("t", "early", "", "log"), ("u", "empty", None, "log"), ("t", "fan", None, "fanout")]
    got = {r["subscription_name"]: (r["lag"], r["oldest_age_ms"]) for r in A.log_lag(messages, spark.createDataFrame(subs, "topic string, subscription_name string, cursor string, mode string"), 200).collect()}
    assert got == {"none": (6, 100), "mid": (3, 97), "between": (3, 97), "last": (0, None), "early": (6, 100), "empty": (0, None)}


def test_one_queue_holds_nine_in_ten(spark):
    """Ranks, percentiles and levels of skewed keys equal the plain ones."""
    from pyspark.sql import Window

    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 7).cast("string"))).alias("queue"), F.col("id").cast("string").alias("id"), (F.col("id") * 7919 % 5).alias("priority"), (F.col("id") * 31 % 997).alias("scheduled_at"))
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("queue").orderBy(*D.order_of("fifo"))).cast("long"))
    assert sorted(map(tuple, D.full_rank(rows).collect())) == sorted(map(tuple, plain.collect()))
    values = {}
    for r in rows.collect():
        values.setdefault(r["queue"], []).append(r["scheduled_at"])
    got = X.index_percentiles(rows, ["queue"], "scheduled_at", {"a": 0.0, "b": 0.333, "c": 0.99, "d": 1.0}, splits=8).collect()
    for r in got:
        own = sorted(values[r["queue"]])
        assert [r[c] for c in "abcd"] == [own[min(int(len(own) * q), len(own) - 1)] for q in (0.0, 0.333, 0.99, 1.0)]
    assert len(got) == len(values)


def test_levels_together_and_by_rounds(spark):
    import random

    rng = random.Random(4)
    edges = [(f"r{r}", str(rng.randrange(9)), str(rng.randrange(12))) for r in range(40) for _ in range(8)]
    nodes = spark.createDataFrame([(f"r{r}", str(i)) for r in range(40) for i in range(10)], "run_id string, node string")
    edges = spark.createDataFrame(edges, "run_id string, src string, dst string")
    rows = lambda df: sorted(map(tuple, df.select("run_id", "node", "level").collect()))
    together, mixed = rows(G.levels(nodes, edges)), rows(G.levels(nodes, edges, large=16))
    assert together == mixed == rows(G.levels_by_rounds(nodes.distinct(), edges.distinct())) and len({x[2] for x in together}) > 1


def at(spark, predicate, iso):
    row = spark.sql(f"select unix_millis(timestamp '{iso} UTC') as at_ms").select(predicate.alias("p")).first()["p"]
    return row["action"], row["seconds"]


def test_business_hours(spark):
    p = P.business_hours()
    assert at(spark, p, "2024-01-05 10:00:00") == ("run", None)
    assert at(spark, p, "2024-01-05 08:00:00") == ("defer", 3600.0)
    # On Friday evening the next opening is Saturday's, which then defers to Monday's.
    assert at(spark, p, "2024-01-05 18:00:00") == ("defer", 15 * 3600.0)
    assert at(spark, p, "2024-01-06 09:00:00") == ("defer", 48 * 3600.0)


def test_outcomes(spark):
    run, skip, defer, cancel = P.result("run"), P.result("skip"), P.result("defer", 5), P.result("cancel")
    act = lambda c: one(spark, c["action"])
    assert act(P.all_of(run, defer, cancel)) == "defer" and act(P.all_of(run, run)) == "run" and act(P.all_of(skip, cancel)) == "skip"
    assert act(P.any_of(skip, defer, cancel)) == "cancel" and act(P.any_of(defer, run)) == "run" and act(P.any_of(skip, defer)) == "defer"
    assert act(P.negate(run)) == "skip" and act(P.negate(skip)) == "run" and act(P.negate(defer)) == "defer"
    for bad in ("__import__('os')", "weekend().x", "1 + 1", "nothing()", "weekend() and weekend()"):
        with pytest.raises((ValueError, SyntaxError)):
            P.parse(bad)


def submissions(spark, rows):
    return spark.createDataFrame([(i, "k", t, f, s) for i, (t, f, s) in enumerate(rows)], "seq bigint, key string, at_ms bigint, failed boolean, sojourn_ms bigint")


def test_token_bucket(spark):
    df = submissions(spark, [(0, False, 0)] * 4 + [(1000, False, 0)])
    assert [r["allowed"] for r in S.token_bucket(df, 3, 1.0).orderBy("seq").collect()] == [True, True, True, False, True]


def test_breaker(spark):
    rows = [(0, True, 0), (10, True, 0), (20, True, 0), (30, False, 0), (1100, False, 0), (1110, True, 0)]
    got = S.breaker(submissions(spark, rows), threshold=3, window_ms=100, cooldown_ms=1000, probes=1).orderBy("seq").collect()
    assert [r["mode"] for r in got] == ["closed", "closed", "open", "open", "closed", "closed"]
    assert [r["allowed"] for r in got] == [True, True, True, False, True, True]
    gaps = [(0, True, 0), (200, True, 0), (400, True, 0)]
    assert {r["mode"] for r in S.breaker(submissions(spark, gaps), threshold=2, window_ms=100, cooldown_ms=1000).collect()} == {"closed"}


def test_breaker_success_clears_the_failures(spark):
    rows = [(t, t % 20 == 0, 0) for t in range(0, 100, 10)]  # fail, success, fail, success, ...
    assert {r["mode"] for r in S.breaker(submissions(spark, rows), threshold=3, window_ms=1000, cooldown_ms=1000).collect()} == {"closed"}


def test_breaker_half_open(spark):
    """Of five probes four have to succeed: one failure is borne, the second opens the breaker at once."""
    trip = [(0, True, 0), (1, True, 0)]
    probes = lambda *failed: [r["mode"] for r in S.breaker(submissions(spark, trip + [(1000 + i, f, 0) for i, f in enumerate(failed)]), threshold=2, window_ms=100, cooldown_ms=900).orderBy("seq").collect()][2:]
    assert probes(False, True, False, False, False) == ["half_open"] * 4 + ["closed"]
    assert probes(False, True, True) == ["half_open", "half_open", "open"]


def test_codel(spark):
    shed = lambda rows: [r["shed"] for r in S.codel(submissions(spark, [(t, False, s) for t, s in rows]), 100, 1000).orderBy("seq").collect()]
    assert not any(shed([(i * 50, 10) for i in range(100)]))
    assert not any(shed([(1, 500), (500, 500), (800, 10), (900, 500)]))
    assert shed([(1, 500), (1000, 500), (1001, 500)]) == [False, False, True]
    assert shed([(1, 500), (1001, 500), (1100, 10), (1200, 500), (2100, 500), (2200, 500)]) == [False, True, False, False, False, True]


def test_codel_goes_on_near_its_rate(spark):
    """The spacing shrinks with the root of the count from the present time, and a quick relapse resumes at two less."""
    step, state, shed = S.CoDel(100, 1000), None, []
    for t in [*range(1, 6000, 100), 6100, *range(6200, 9000, 100)]:
        state, out = step(state, {"seq": t, "key": "k", "at_ms": t, "sojourn_ms": 10 if t == 6100 else 500})
        if out[0]["shed"]:
            shed.append((t, state["count"], state["next"]))
    assert all(at + max(1, int(1000 / n**0.5)) == after for at, n, after in shed)
    counts = [n for _, n, _ in shed]
    relapse = next(i for i, (t, _, _) in enumerate(shed) if t > 6100)
    assert counts[:relapse] == list(range(1, relapse + 1)) and counts[relapse] == relapse - 2


def test_debounce_and_batches(spark):
    df = submissions(spark, [(t, False, 0) for t in (0, 50, 100, 150, 1000)])
    got = [(r["first_seen"], r["fires_at"], r["n"]) for r in S.debounce(df, 100, 180).orderBy("first_seen").collect()]
    assert got == [(0, 180, 4), (1000, 1100, 1)]
    assert [(r["first_seen"], r["n"]) for r in S.debounce(df, 100).orderBy("first_seen").collect()] == [(0, 4), (1000, 1)]
    got = [(r["first_seq"], r["n"], r["flushed_at"]) for r in S.accumulate(df, 2, 500).orderBy("first_seq").collect()]
    assert got == [(0, 2, 50), (2, 2, 150), (4, 1, 1500)]


def dag(spark, edges, statuses=()):
    names = sorted({n for e in edges for n in e})
    state = dict(statuses)
    nodes = spark.createDataFrame([("r", n, state.get(n, "pending"), 1.0 + i, None) for i, n in enumerate(names)], "run_id string, node string, status string, cost double, result_hash string")
    return nodes, spark.createDataFrame([("r", a, b) for a, b in edges], "run_id string, src string, dst string")


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]


def test_diamond(spark):
    nodes, edges = dag(spark, DIAMOND)
    assert {r["node"]: r["level"] for r in G.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    path = G.critical_path(nodes, edges).first()
    assert path["path"] == ["a", "c", "d"] and path["cost"] == 8.0
    top = G.bottleneck(G.critical_path(nodes, edges), nodes).first()
    assert (top["node"], top["cost"], top["pct"]) == ("d", 4.0, 50.0)
    stats = G.dag_stats(nodes, edges).first()
    assert (stats["nodes"], stats["edges"], stats["depth"], stats["width"], stats["density"]) == (4, 4, 3, 2, 0.6667)


def test_cycle_is_dropped(spark):
    nodes, edges = dag(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])
    assert [r["node"] for r in G.levels(nodes, edges).collect()] == ["a"]
    start = spark.createDataFrame([("r", "b")], "run_id string, node string")
    assert {r["node"] for r in G.closure(edges, start).collect()} == {"b", "c", "d"}


def test_ready_nodes_need_completed_predecessors(spark):
    nodes, edges = dag(spark, DIAMOND, {"a": "completed", "b": "cache_hit", "c": "completed"}.items())
    ready = J.ready_nodes(nodes.withColumnRenamed("node", "node_name"), edges)
    assert ready.count() == 0
    assert [r["node"] for r in G.skipped(*dag(spark, DIAMOND, {"b": "failed"}.items())).collect()] == ["d"]


def test_ring_owner_is_the_next_point(spark):
    workers = spark.range(20).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("worker_id"))
    keys = spark.range(500).select(F.col("id").cast("string").alias("id"))
    points = J.ring_points(workers, 8)
    owners = {r["id"]: r["worker_id"] for r in J.ring_owner(keys, points, "id").collect()}
    ring = sorted((r["point"], r["worker_id"]) for r in points.collect())
    for r in keys.select("id", F.xxhash64("id").alias("h")).collect():
        assert owners[r["id"]] == next((w for p, w in ring if p >= r["h"]), ring[0][1])


def test_ring_owner_goes_through_a_range_once(spark):
    owned = J.ring_owner(spark.range(50).select(F.col("id").cast("string").alias("k")), J.ring_points(spark.range(3).selectExpr("concat('w', id) as worker_id"), 4), "k")
    assert "unboundedfollowing$())" not in owned._jdf.queryExecution().optimizedPlan().toString().replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")


def test_percentiles_choose_their_cuts_once(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    plan = X.index_percentiles(df, ["k"], "v", {"p50": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan  # approximate cuts that two branches compute can differ


def test_steps_with_one_sequence_number_go_by_attempt(spark):
    rows = [("j", s, k, 1, n) for n, s, k in ((5, 4, "e"), (4, 4, "d"), (1, 0, "a"), (2, 1, "b"), (3, 2, "c"))]
    df = spark.createDataFrame(rows, "job_id string, seq int, step_key string, result_len int, attempt int").repartition(1)
    got = {r["attempt"]: r["verdict"] for r in K.checked_steps(df, 40, 100, 9, "attempt").collect()}
    assert got == {1: "committed", 2: "committed", 3: "committed", 4: "diverged", 5: "committed"}


def test_orphans_need_a_live_worker(spark):
    claims = spark.createDataFrame([("j1", "w1"), ("j2", "w2")], "job_id string, worker_id string")
    jobs = spark.createDataFrame([("j1", 1), ("j2", 1)], "id string, status int")
    live = spark.createDataFrame([("w1",)], "worker_id string")
    assert [r["job_id"] for r in J.orphaned(claims, live, jobs).collect()] == ["j2"]
    assert J.orphaned(claims, live.where("false"), jobs).count() == 0


def test_cron():
    day = 86_400_000
    assert U.next_cron("0 0 0 * * *", 0) == day
    assert U.next_cron("*/15 * * * * *", 1000) == 15_000
    assert U.next_cron("0 30 9 * * MON-FRI", 1704474000000) == 1704706200000  # Friday evening to Monday morning
    assert U.next_cron("0 0 0 1 1 * 2000", 1704474000000) is None
    # A local time that the clock change skips moves on to the next day.
    assert U.next_cron("0 30 2 * * *", 1711839600000, "Europe/Berlin") == 1711931400000
    with pytest.raises(ValueError):
        U.next_cron("* * * * *", 0)


def test_notes_and_fingerprints():
    assert U.check_notes('{"b": 1, "a": "x"}') == '{"a":"x","b":1}'
    assert U.check_notes("[1]") is None and U.check_notes('{"a":{"b":{"c":{"d":1}}}}') is None and U.check_notes(None) is None
    assert U.fingerprint([]) is None and U.fingerprint(["b", "a", "a"]) == U.fingerprint(["a", "b"]) != U.fingerprint(["ab"])


def test_compare_and_set_of_null(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "key string, value string")
    assert {r["key"]: r["value"] for r in K.compare_and_set(df, "value", None, "new").collect()} == {"a": "new", "b": "x"}


def chains(spark):
    """Runs of 1 to 6 nodes, each leading to the next two, in either form; every third node failed, the others pend."""
    nodes = spark.range(1, 7).selectExpr("cast(id as string) as run_id", "explode(sequence(1, id)) as k")
    nodes = nodes.selectExpr("run_id", "concat('n', k) as node", "if(k % 3 = 2, 'failed', 'pending') as status", "cast(k * 7 % 5 as double) as cost", "array(concat('n', k + 1), concat('n', k + 2)) as next").cache()
    return nodes, G.edges_of(nodes, None).cache()


def test_graph_steps_shuffle_nodes_once_and_large_runs_go_by_rounds(spark):
    nodes, edges = chains(spark)
    plain, start = nodes.drop("next"), nodes.where("node = 'n3'").select("run_id", "node")
    base = plain.where("node <> 'n4'").selectExpr("run_id", "node", "'completed' as status", "'h' as result_hash")
    got = lambda df: sorted(map(repr, df.collect()))
    for f in (
        lambda n, e, large: G.skipped(n, e, large=large), lambda n, e, large: G.dirty_nodes(n, e, base, large=large),
        lambda n, e, large: G.critical_path(n, e, large=large), lambda n, e, large: G.levels(n, e, large=large, keep=("status",)), lambda n, e, large: G.dag_stats(n, e, large=large),
        lambda n, e, large: G.closure(e, start, nodes=n if e is None else None, large=large), lambda n, e, large: G.closure(e, start, up=True, nodes=n if e is None else None, large=large),
    ):
        linked, mixed, by_edges = got(f(nodes, None, 1 << 20)), got(f(nodes, None, 12)), got(f(plain, edges, 1 << 20))
        assert linked == mixed == by_edges and linked
    assert got(G.conditions(nodes)) == got(G.conditions(nodes, large=12)) == got(G.conditions(plain, edges))
    assert got(G.mermaid(plain, edges)) == got(G.mermaid(nodes.withColumn("next", F.expr("filter(next, n -> cast(substr(n, 2) as int) <= cast(run_id as int))"))))


def test_closure_and_paths_leave_no_join_in_small_runs(spark, monkeypatch):
    nodes, edges = chains(spark)
    monkeypatch.setattr(G, "cut", lambda df: df)  # the plans before they are cut
    for df in (G.skipped(nodes), G.critical_path(nodes), G.closure(None, nodes.where("node = 'n3'"), nodes=nodes)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_tasks_of_graphs_dont_grow_with_the_table(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    got = lambda df: sorted(map(repr, df.collect()))
    partitions = lambda df: df.rdd.getNumPartitions()
    names = ("g6_levels", "g7_topological_order", "g11_layers", "g12_conditions", "g16_saga_waves", "g18_chunks", "g20_depth", "d9_compensations")
    registry.load()
    few = {n: got(registry.QUERIES[n](spark, sf)) for n in names}
    c = Catalog(spark, sf)
    rows = c.lineitem.count()
    assert partitions(c.workflow_nodes) <= 4
    monkeypatch.setattr(shared, "PART", rows // 10)
    c = Catalog(spark, sf)
    assert partitions(c.workflow_nodes) == partitions(c.job_errors) == 1 + rows // (rows // 10) > 4
    for n in ("g7_topological_order", "g11_layers", "g16_saga_waves", "g18_chunks", "g20_depth", "d9_compensations"):
        assert partitions(registry.QUERIES[n](spark, sf)) > 4, n
    assert few == {n: got(registry.QUERIES[n](spark, sf)) for n in names}


def test_cron_over_arrays(monkeypatch):
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    import numpy as np

    after = np.array([0, 999, 1704474000000, 1711846800000, 1729990799999, 1729990800000, 1729992600000, -1, 4102444799000, 4133980799000])
    found, ok = U.next_crons("0 */30 1-3 * * SUN-SAT", after, "Europe/Berlin")
    zone = ZoneInfo("Europe/Berlin")
    for a, f, some in zip(after.tolist(), found.tolist(), ok.tolist(), strict=True):
        at = datetime.fromtimestamp(f // 1000, UTC).astimezone(zone)
        assert not some or (f > a and at.minute in (0, 30) and at.second == 0 and 1 <= at.hour <= 3)
    assert ok[:9].all() and found[4] == 1729990800000  # the second 02:00 of the night that clocks go back
    parsed = []
    monkeypatch.setattr(U, "cron_field", lambda *a, f=U.cron_field: parsed.append(a) or f(*a))
    U.schedule.cache_clear()
    found, ok = U.next_crons("0 30 9 * * MON-FRI", np.arange(1704474000000, 1704474000000 + 1000 * 5000, 5000))
    assert ok.all() and set(found) == {1704706200000} and len(parsed) == 7  # read once for all times
    assert not U.next_crons("0 0 0 31 2 *", np.array([0]))[1][0]


def test_gunzip_whole_without_a_file_reader(monkeypatch):
    import gzip

    one = gzip.compress(b"ab")
    assert U.gunzip(one, 2) == b"ab" and U.gunzip(one, 1) is None and U.gunzip(one + one, 4) == b"abab" and U.gunzip(one + one, 3) is None and U.gunzip(one + b"\0\0", 2) == b"ab"
    with pytest.raises(EOFError):
        U.gunzip(one[:-3], 2)
    monkeypatch.setattr(U.gzip, "GzipFile", None)
    assert U.gunzip(one, 2) == b"ab"  # one member needs no file reader
