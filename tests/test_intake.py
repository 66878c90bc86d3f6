"""Daily feeds, descents, dirty nodes, ghosts, forecasts: what raises, and hand cases beside the queries' SQL."""

import random
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stockweave.operators import descent, feeds, forecast, ghosts, mrp, pegging


def dated(df, *names, kind="date"):
    return df.withColumns({n: F.col(n).cast(kind) for n in names})


def test_files_of_a_day_are_one_feed(spark, tmp_path):
    names = ["items_20240105.tsv", "on_hand.part02_20240105.tsv", "on_hand.part01_20240105.tsv", "bom.part01_20240105.tsv", "bom.part03_20240105.tsv", "orders_20240105.tsv", "orders.part01_20240105.tsv", "lots.part01_20240105.tsv", "lots.part001_20240105.tsv", "items_20240106.tsv", "items.tsv", "notes.txt", "void_20240105.tsv", "_20240105.tsv.gz"]
    for n in names:
        (tmp_path / n).write_text("" if n.startswith("void") else f"k\n{n}\n")
    found = {(r.feed, r.day): ([x.rpartition("/")[2] for x in r.paths], r.issue) for r in feeds.inbox(spark, str(tmp_path)).collect()}
    assert found["items", "20240105"] == (["items_20240105.tsv"], None) and found["items", None] == (["items.tsv"], None) and found["items", "20240106"][1] is None
    assert found["on_hand", "20240105"] == (["on_hand.part01_20240105.tsv", "on_hand.part02_20240105.tsv"], None)
    issues = {k[0]: v[1] for k, v in found.items() if v[1]}
    assert issues == {"bom": "parts are missing", "orders": "several files for one day", "lots": "a part twice"}
    assert len(found) == 7


def test_runs_are_compared_with_the_run_before(spark):
    rows = [("a", "2024-01-01", i, 9) for i in range(10)] + [("a", "2024-01-04", i, 23) for i in range(3, 12)] + [("a", "2024-01-05", i, 8) for i in (3, 3, None)] + [("b", "2024-01-04", 1, 8)]
    df = spark.createDataFrame([(f, d, i, f"{d} {h:02d}:00:00") for f, d, i, h in rows], "feed string, run_date string, id long, at string")
    days = feeds.feed_days(dated(dated(df, "run_date"), "at", kind="timestamp_ntz"))
    got = {(r.feed, r.run_date.day): (r.rows, r.active, r.deleted, r.previous_rows, r.previous_active) for r in days.collect()}
    assert got == {("a", 1): (10, 10, None, None, None), ("a", 4): (9, 9, 3, 10, 10), ("a", 5): (3, 1, 8, 9, 9), ("b", 4): (1, 1, None, None, None)}

    contracts = spark.createDataFrame([("a", "blocking", 5, 0.5), ("b", "advisory", None, None), ("c", "advisory", 1, 0.1)], "feed string, criticality string, min_rows long, max_delta double")
    absent = spark.createDataFrame([("c", date(2024, 1, 5))], "feed string, run_date date")
    days = days.unionByName(absent, allowMissingColumns=True)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    judged = feeds.guards(days, contracts, feeds.deadline("0 10 * * *", 30, F.col("run_date")), at("2024-01-05 10:00:00"))
    got = {(r.feed, r.run_date.day): (*(r[g] for g in feeds.GUARDS), r.overall) for r in judged.collect()}
    none = "NOT_EVALUATED"
    assert got[("a", 1)] == ("OK", "OK", none, none, "OK") and got[("a", 4)] == ("FAILED", "OK", "OK", "FAILED", "FAILED")
    assert got[("a", 5)] == ("OK", "FAILED", "FAILED", "FAILED", "FAILED") and got[("b", 4)] == ("OK", none, none, none, "OK") and got[("c", 5)] == (none, none, none, none, "OK")
    late = feeds.guards(absent.unionByName(days.limit(0), allowMissingColumns=True), contracts, feeds.deadline("0 10 * * *", 30, F.col("run_date")), at("2024-01-05 10:30:00"))
    assert late.first().arrival_window == "FAILED"

    checks = spark.createDataFrame([("a", date(2024, 1, 1), "passed"), ("b", date(2024, 1, 4), "failed")], "feed string, run_date date, dq_status string")
    decided = {r.run_date.day: (r.status, r.feeds, r.red, r.open) for r in feeds.daily_decision(judged, checks).collect()}
    assert decided == {1: ("AUTO_APPROVED", 1, 0, 0), 4: ("ESCALATED", 2, 2, 0), 5: ("ESCALATED", 2, 1, 1)}
    only = feeds.daily_decision(judged.where("feed = 'b'"), checks).first()
    assert only.status == "DEGRADED"
    with pytest.raises(Exception, match="unknown criticality of feed a"):
        feeds.daily_decision(judged.withColumn("criticality", F.lit("high")).where("feed = 'a'"), checks).collect()
    for cadence in ("0 10 * * 1", "0 10 * *", "x 10 * * *", "0 24 * * *", "60 1 * * *"):
        with pytest.raises(ValueError, match="cadence"):
            feeds.deadline(cadence, 0, F.lit("2024-01-01"))


def test_descents_add_up_and_can_be_undone(spark):
    rng = random.Random(8)
    table = spark.createDataFrame
    past = [(i, s, float(rng.randrange(1, 40))) for i in range(12) for s in range(6) if rng.random() < 0.7]
    routes = table([(s, s % 3) for s in range(5)], "state long, place long")  # state 5 has none
    eligible = table([(i, c, (i + c) % 5 != 0) for i in range(14) for c in range(3)], "item_id long, place long, eligible boolean")
    observed = table(past, "item_id long, state long, qty double")
    shared = descent.shares(table([(i,) for i in range(15)], "item_id long"), observed, routes, eligible, least=20, enough=80)
    found = {}
    for r in shared.collect():
        found.setdefault(r.item_id, {})[r.place] = r
    for i in range(15):
        ways = [c for c in range(3) if i < 14 and (i + c) % 5 != 0]
        weights = {c: sum(q for j, s, q in past if j == i and s < 5 and s % 3 == c) for c in ways}
        basis = sum(weights.values())
        weights, method = ({c: w for c, w in weights.items() if w}, "history") if basis >= 20 else (dict.fromkeys(ways, 1), "equal_split")
        got = found.get(i, {})
        assert set(got) == set(weights) and sum(r.share for r in got.values()) == (descent.SHARE if ways else 0)
        for c, r in got.items():
            assert r.method == method and abs(Fraction(r.share, descent.SHARE) - Fraction(weights[c]) / Fraction(sum(weights.values()))) < Fraction(2, descent.SHARE)
            assert r.confidence == (min(1.0, basis / 80) if method == "history" else None)
    assert {(r.item_id, r.state) for r in descent.unrouted(observed, routes).collect()} == {(i, s) for i, s, _ in past if s == 5}

    demand = table([(f"n{k}", k % 15, None, rng.randrange(1, 10**7) / 10**6, k % 7 != 0, None) for k in range(60)], "node_id string, item_id long, location_id long, qty double, active boolean, source_id string")
    ledger = descent.descend(demand, shared, eligible.withColumn("eligible", F.col("eligible") & (F.col("place") != 2)))
    sums = {}
    for r in ledger.collect():
        assert r.place != 2
        sums[r.node_id] = sums.get(r.node_id, 0) + r.qty
    before = {r.node_id: r for r in demand.collect()}
    usable = {i for i in found if set(found[i]) - {2}}
    assert sums == {k: round(r.qty * descent.QTY) for k, r in before.items() if r.active and r.item_id in usable}
    once = descent.applied(demand, ledger)
    after = once.collect()
    assert sorted(map(str, descent.applied(once, ledger).collect())) == sorted(map(str, after))
    assert descent.descend(once.where("source_id is null"), shared, eligible).count() == 0
    assert sum(r.qty for r in after if r.active) == pytest.approx(sum(r.qty for r in before.values() if r.active))
    assert sorted(map(str, descent.undone(once, ledger).collect())) == sorted(map(str, before.values()))


def test_descents_refuse_what_contradicts(spark):
    table = spark.createDataFrame
    items, observed = table([(1,)], "item_id long"), table([(1, 1, 5.0)], "item_id long, state long, qty double")
    routes, eligible = table([(1, 1)], "state long, place long"), table([(1, 1, True)], "item_id long, place long, eligible boolean")
    with pytest.raises(ValueError, match="two routes"):
        descent.shares(items, observed, routes.union(table([(1, 2)], "state long, place long")), eligible)
    with pytest.raises(ValueError, match="eligible and not"):
        descent.shares(items, observed, routes, eligible.union(table([(1, 1, False)], "item_id long, place long, eligible boolean")))
    with pytest.raises(ValueError, match="negative"):
        descent.shares(items, observed.withColumn("qty", -F.col("qty")), routes, eligible)


def test_dirty_nodes_stop_at_the_window(spark):
    starts = {"p1": "2024-01-01", "p2": "2024-01-08", "p3": "2024-01-15", "p4": "2024-03-01", "q1": "2024-01-08"}
    nodes = [(n, s, 1 if n[0] == "p" else 2, 1) for n, s in starts.items()] + [("d", None, 1, 1), ("w", None, 2, 1)]
    nodes = dated(spark.createDataFrame(nodes, "node_id string, start string, item_id long, location_id long"), "start")
    edges = spark.createDataFrame([("d", "p2"), ("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("p3", "w"), ("w", "q1"), ("q1", "p1")], "from_id string, to_id string")
    events = dated(spark.createDataFrame([("all", "d", None, None), ("some", "d", "2024-01-10", "2024-01-05"), ("gone", "x", None, "2024-01-05"), ("out", "p4", "2024-01-05", None)], "event_id string, trigger_id string, old_date string, new_date string"), "old_date", "new_date")
    got = {}
    for r in pegging.dirty(events, edges, nodes, ahead=30).collect():
        got.setdefault(r.event_id, set()).add(r.node_id)
    assert got == {"all": {"d", "p1", "p2", "p3", "p4", "w", "q1"}, "some": {"d", "p2", "p3", "w", "q1"}, "out": {"p2", "p3"}}


def test_dirty_nodes_along_series_are_those_of_a_walk(spark):
    """Chains of buckets give what their edges do: from the middle, with and without dates, into other series, and where starts don't ascend."""
    table, day = spark.createDataFrame, date(2024, 1, 1)
    starts = [0, 7, 14, 3, 28]  # the fourth bucket is earlier than the third
    series = [(item, place) for item in (1, 2) for place in (1, 2)]
    name = lambda item, place, i: f"{item}-{place}-{i}"
    nodes = [("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("far", 9, 9)]
    feeds = [("a", 1, 1, 1), ("a", 1, 2, 0), ("b", 2, 1, 4), ("b", 2, 2, 2), ("c", 1, 1, 0), ("c", 1, 1, 3), ("far", 2, 2, 1), ("b", 3, 3, 0)]
    days = [(None, None), (0, 3), (5, None), (None, 8), (14, 2), (30, 29), (100, 200)]
    at = lambda n: None if n is None else day + timedelta(n)
    events = table([(f"{t}{k}", t, at(a), at(b)) for t in ("a", "b", "c", "far", "gone") for k, (a, b) in enumerate(days)], "event_id string, trigger_id string, old_date date, new_date date")
    plain = table(nodes, "node_id string, item_id long, location_id long").select("node_id", F.lit(None).cast("date").alias("start"), "item_id", "location_id")
    buckets = table([(name(*s, i), at(n), *s) for s in series for i, n in enumerate(starts)], "node_id string, start date, item_id long, location_id long")
    led = [(f, name(i, p, b), i, p) for f, i, p, b in feeds]
    between = table([("a", "b"), ("c", "far")], "from_id string, to_id string")
    edges = table([(f, t) for f, t, *_ in led] + [(name(*s, i), name(*s, i + 1)) for s in series for i in range(4)], "from_id string, to_id string").unionByName(between)
    ids = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(at(n)).alias("start")) for i, n in enumerate(starts))), lambda b: F.struct(F.concat_ws("-", "item_id", "location_id", b["i"]).alias("node_id"), b["start"].alias("start")))
    chains = pegging.Chains(table(series + series[:2], "item_id long, location_id long"), ids, table(led, "from_id string, to_id string, item_id long, location_id long"), 3)
    want = sorted(map(tuple, pegging.dirty(events, edges, plain.unionByName(buckets), ahead=4).collect()))
    assert sorted(map(tuple, pegging.dirty(events, between, plain, ahead=4, chains=chains).collect())) == want and len(want) > 60


def test_hand_overs_and_shared_capacity(spark):
    pair = dated(spark.createDataFrame([(7, 1, 2, "2024-01-02", "2024-01-04", "linear", 1.0, 0.0)], "ghost_id long, outgoing long, incoming long, start string, end string, curve string, weight_at_start double, weight_at_end double"), "start", "end")
    stock = dated(spark.createDataFrame([(1, "2024-01-01", 10.0), (1, "2024-01-03", 4.0), (2, "2024-01-02", 5.0)], "item_id long, day string, closing double"), "day")
    days = ghosts.hand_over(pair, stock, F.lit("2024-01-01").cast("date"), F.lit("2024-01-04").cast("date"))
    got = {r.day.day: (r.weight_outgoing, r.stock_incoming, r.baseline, r.delta) for r in days.collect()}
    assert got == {1: (1.0, None, None, None), 2: (1.0, 5.0, 10.0, 5.0), 3: (0.5, 5.0, 8.0, 1.0), 4: (0.0, 5.0, 5.0, 4.0)}
    assert [r.day.day for r in ghosts.inconsistent(days, 0.2).orderBy("day").collect()] == [2, 4]
    members = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("h", 3)], "ghost_id string, item_id long")
    load = dated(spark.createDataFrame([(2, "2024-01-01", 3.0), (1, "2024-01-01", 2.0), (2, "2024-01-01", 1.0), (9, "2024-01-02", 9.0)], "item_id long, day string, qty double"), "day")
    per = ghosts.shared_capacity(members, load, spark.createDataFrame([("g", 5.0)], "ghost_id string, per_day double"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))
    got = {(r.ghost_id, r.day.day): (r.load, r.slack, r.overloaded, [tuple(m) for m in r.members]) for r in per.collect()}
    assert got == {("g", 1): (6.0, -1.0, True, [(1, 2.0), (2, 4.0)]), ("g", 2): (0.0, 5.0, False, []), ("h", 1): (0.0, 0.0, False, []), ("h", 2): (0.0, 0.0, False, [])}


def test_candidates_of_short_and_empty_series(spark):
    data = spark.createDataFrame([(1, [4.0, 4.0]), (2, [0.0] * 5), (3, [3.0, 5.0, 4.0, 6.0])], "item_id long, values array<double>")
    rows = {}
    for r in forecast.evaluated(data, 2).collect():
        rows.setdefault(r.item_id, {})[r.label] = (r.wape, r.value)
    assert set(rows[1]) == {"EXP_SMOOTHING(alpha=0.20)", "EXP_SMOOTHING(alpha=0.50)", "EXP_SMOOTHING(alpha=0.80)"} and all(v == (None, 4.0) for v in rows[1].values())
    assert "CROSTON" in rows[2] and "CROSTON" not in rows[3] and all(w is None for w, _ in rows[2].values())
    assert rows[3]["MA(window=3)"] == (round(2 / 6, 9), 5.0)  # one origin, one step: 4 for 6
    best = {r.item_id: r for r in forecast.selected(forecast.evaluated(data, 2)).collect()}
    assert best[1].label == "EXP_SMOOTHING(alpha=0.20)" and best[1].ensemble == 4.0 and best[2].value == 0.0
    w = {k: 1 / max(v[0], 1e-4) for k, v in rows[3].items()}
    assert best[3].ensemble == pytest.approx(sum(w[k] * v[1] for k, v in rows[3].items()) / sum(w.values()))


def test_confidence_of_what_is_not_known(spark):
    df = spark.createDataFrame([(None, None, None), (0.25, 730, 3), (1.0, 73, 14)], "wape double, depth int, age int")
    got = [tuple(r.c) for r in df.select(forecast.confidence(F.col("wape"), F.col("depth"), F.col("age")).alias("c")).collect()]
    assert got == [(0.25, 0.25, 0.25, 0.25, False), (0.9, 0.8, 1.0, 1.0, False), (0.425, 0.5, 0.2, 0.5, True)]


def test_lots_of_the_second_model(spark):
    none = None
    rows = [  # rule, net, stock, moq, most, eoq, multiple, periods, reorder, ahead, lot
        ("LOTFORLOT", 0.0, 0.0, 5.0, none, none, none, none, none, [], 0.0),
        ("LOTFORLOT", 3.0, 0.0, 5.0, none, none, none, none, none, [], 5.0),
        ("FIXED_QTY", 250.0, 0.0, 100.0, none, none, none, none, none, [], 300.0),
        ("FIXED_QTY", 7.0, 0.0, none, none, none, none, none, none, [], 7.0),
        ("EOQ", 150.0, 0.0, 30.0, none, 100.0, none, none, none, [], 200.0),
        ("EOQ", 20.0, 0.0, 130.0, none, 100.0, none, none, none, [], 130.0),
        ("POQ", 50.0, 0.0, none, none, none, none, 3, none, [0.0, 20.0, 9.0], 70.0),
        ("POQ", 50.0, 0.0, none, 60.0, none, none, 3, none, [-5.0, 20.0], 60.0),
        ("POQ", 50.0, 0.0, none, none, none, none, none, none, [8.0], 50.0),
        ("MIN_MAX", 50.0, 100.0, none, 500.0, none, none, none, 120.0, [], 400.0),
        ("MIN_MAX", 50.0, 600.0, none, 500.0, none, none, none, 120.0, [], 50.0),
        ("MIN_MAX", 50.0, 10.0, none, 0.0, none, none, none, 120.0, [], 50.0),
        ("MULTIPLE", 30.0, 0.0, 100.0, none, none, 25.0, none, none, [], 100.0),
        ("MULTIPLE", 75.0, 0.0, none, none, none, 25.0, none, none, [], 75.0),
        ("MULTIPLE", 3.0, 0.0, 4.0, none, none, 0.0, none, none, [], 4.0),
        ("OTHER", 3.0, 0.0, 4.0, none, none, none, none, none, [], 4.0),
    ]
    names = ("moq", "most", "eoq", "multiple", "periods", "reorder", "ahead")
    df = spark.createDataFrame(rows, "rule string, net double, stock double, moq double, most double, eoq double, multiple double, periods int, reorder double, ahead array<double>, want double")
    lot = mrp.lot_size(F.col("rule"), F.col("net"), F.col("stock"), **{n: F.col(n) for n in names})
    assert [(r.rule, r.lot) for r in df.withColumn("lot", lot).collect()] == [(r[0], r[-1]) for r in rows]
