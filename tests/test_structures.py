"""Hierarchies, pegging, capacity: what raises, and hand cases beside the queries' SQL."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockweave.operators import capacity, hierarchy, pegging, scenarios

LEVELS = ["root", "family", "kind"]
NODES = [("R", None, "root"), ("A", "R", "family"), ("B", "R", "family"), ("a1", "A", "kind"), ("b1", "B", "kind"), ("Q", None, "root"), ("empty", "Q", "family")]
MEMBERS = [(1, "a1"), (2, "a1"), (3, "b1"), (4, "B")]


def tables(spark, nodes, members):
    return spark.createDataFrame(nodes, "code string, parent_code string, level string"), spark.createDataFrame(members, "item_id long, code string")


def test_summing_structure(spark):
    got = hierarchy.summing(LEVELS, *tables(spark, NODES, MEMBERS)).collect()
    rows = {}
    for r in got:
        rows.setdefault((r.block, r.code, r.level), set()).add(r.item_id)
    assert rows == {
        ("R", "R", "root"): {1, 2, 3, 4}, ("R", "A", "family"): {1, 2}, ("R", "B", "family"): {3, 4}, ("R", "a1", "kind"): {1, 2}, ("R", "b1", "kind"): {3},
        ("Q", "Q", "root"): {None}, ("Q", "empty", "family"): {None},
    }
    families = hierarchy.summing(LEVELS, *tables(spark, NODES, MEMBERS), block_level="family").select("block").distinct().collect()
    assert sorted(r.block for r in families) == ["A", "B", "empty"]


@pytest.mark.parametrize(
    ("nodes", "members", "levels", "says"),
    [
        (NODES + [("x", "y", "kind"), ("y", "x", "kind")], MEMBERS, LEVELS, "cycle"),
        (NODES + [("x", "gone", "kind")], MEMBERS, LEVELS, "unknown parents"),
        (NODES + [("A", None, "kind")], MEMBERS, LEVELS, "repeated"),
        (NODES + [("x", "A", "shelf")], MEMBERS, LEVELS, "no declared level"),
        (NODES, MEMBERS + [(9, "gone")], LEVELS, "unknown nodes"),
        (NODES, MEMBERS + [(1, "b1")], LEVELS, "twice"),
        (NODES, MEMBERS, [], "levels"),
    ],
)
def test_broken_hierarchies_raise(spark, nodes, members, levels, says):
    with pytest.raises(ValueError, match=says):
        hierarchy.summing(levels, *tables(spark, nodes, members))


def test_one_default_hierarchy(spark):
    registry = spark.createDataFrame([("a", "item", True), ("b", "item", False), ("c", "place", True), ("d", "place", True)], "hierarchy_id string, domain string, is_default boolean")
    assert hierarchy.default_hierarchy(registry, "item") == "a"
    for domain in ("place", "none"):
        with pytest.raises(ValueError, match="default"):
            hierarchy.default_hierarchy(registry, domain)


def test_shares_take_twins_and_lost_forecasts_raise(spark):
    leaves = spark.createDataFrame([("R", "A", "a1", 1, 6.0), ("R", "A", "a1", 2, 2.0), ("R", "A", "a1", 3, None), ("R", "A", "a2", 4, 0.0), ("R", "B", "b", 5, 0.0)], "block string, node string, held string, item_id long, weight double")
    shared = hierarchy.shares(leaves)
    assert {r.item_id: (r.share, r.cold) for r in shared.collect()} == {1: (0.5, False), 2: (2 / 12, False), 3: (4 / 12, True), 4: (0.0, False), 5: (0.0, False)}
    curves = lambda b: spark.createDataFrame([("R", "A", [12.0, 0.0]), ("R", "B", [b, 0.0])], "block string, node string, curve array<double>")
    assert {r.item_id: r.curve for r in hierarchy.split(curves(0.0), shared).collect()} == {1: [6.0, 0.0], 2: [2.0, 0.0], 3: [4.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0]}
    with pytest.raises(Exception, match="no leaf to take the forecast of node B"):
        hierarchy.split(curves(1.0), shared).collect()
    with pytest.raises(Exception, match="negative history of item"):
        hierarchy.shares(leaves.withColumn("weight", -F.col("weight"))).collect()


def test_bench_wants_items_below_its_level(spark):
    nodes, members = tables(spark, NODES, MEMBERS)
    past = spark.createDataFrame([(1, -1, 4.0), (2, 0, 2.0)], "item_id long, period int, qty double")
    sums = hierarchy.summing(LEVELS, nodes, members)
    with pytest.raises(ValueError, match="no single kind node"):
        hierarchy.bench(sums, members, past, "kind", lambda v: F.element_at(v, -1), 2, 4)
    got = {(r.level, r.method): (r.wape, r.bias, r.n_series, r.n_obs) for r in hierarchy.bench(sums, members, past, "family", lambda v: F.element_at(v, -1), 2, 4).collect()}
    # Family A forecasts 4, 4 against 2, 0. Item 2 has no history, so it takes its twin's: both get 2, 2. B is quiet.
    assert got["leaf", "middleout"] == (3.0, 0.75, 4, 8) and got["family", "middleout"] == (3.0, 1.5, 2, 4) and got["root", "base"] == (3.0, 3.0, 1, 2)


def test_peg_serves_in_order_over_several_buckets(spark):
    stock = spark.createDataFrame([(1, 0, 5.0), (1, 1, 3.0), (1, 2, -4.0), (2, 0, 1.0)], "item long, bucket int, closing double")
    rows = [(1, "late", 2, "2024-01-09", 9.0, [0, 1, 2]), (1, "first", 1, "2024-01-09", 2.0, [1]), (1, "zero", 0, "2024-01-01", 0.0, [0]), (1, "last", 2, "2024-01-10", 1.0, [0, 1]), (3, "nowhere", 0, "2024-01-01", 1.0, [0])]
    demands = spark.createDataFrame(rows, "item long, node_id string, rank int, due string, qty double, buckets array<int>").withColumn("due", F.col("due").cast("date"))
    got = sorted((r.node_id, r.bucket, r.priority, r.allocated) for r in pegging.peg(demands, stock, ["item"]).collect())
    assert got == [("first", 1, 0, 2.0), ("late", 0, 0, 5.0), ("late", 1, 1, 1.0)]


def test_walks_stop_at_what_they_have_seen(spark):
    edges = spark.createDataFrame([("x", "a", "b"), ("y", "a", "c"), ("x", "b", "d"), ("w", "c", "d"), ("x", "d", "a"), ("x", "d", "e"), ("x", "d", "e"), ("x", "e", "f")], "edge_type string, from_id string, to_id string")
    roots = spark.createDataFrame([("a",), ("e",), ("z",), ("a",)], "node_id string")
    got = {(r.root_id, r.node_id): (r.depth, r.edge_type, "".join(r.path)) for r in pegging.walk(edges, roots, 3).collect()}
    assert got == {
        ("a", "a"): (0, "root", "a"), ("a", "b"): (1, "x", "ab"), ("a", "c"): (1, "y", "ac"), ("a", "d"): (2, "w", "acd"), ("a", "e"): (3, "x", "acde"),
        ("e", "e"): (0, "root", "e"), ("e", "f"): (1, "x", "ef"), ("z", "z"): (0, "root", "z"),
    }


def test_causes_of_shortages(spark):
    nodes = [("D1", "Order", 9.0, "2024-01-03"), ("D2", "Order", 4.0, None), ("late", "Buy", 50.0, "2024-01-20"), ("small", "Buy", 2.0, "2024-01-14"), ("ample", "Make", 99.0, None), ("H", "OnHandSupply", 5.0, None)]
    edges = [("consumes", "D2", "p1", 1), ("consumes", "D1", "p1", 0), ("replenishes", "H", "p1", 0), ("replenishes", "late", "p1", 1), ("replenishes", "small", "p2", 0), ("replenishes", "ample", "p2", 1), ("replenishes", "ample", "p3", 0), ("consumes", "gone", "p3", 0), ("replenishes", "H", "p4", 0)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = table(nodes, "node_id string, node_type string, quantity double, due string").withColumn("due", F.col("due").cast("date"))
    edges = table(edges, "edge_type string, from_id string, to_id string, priority int")
    short = table([(f"p{i}", 6.0) for i in range(1, 5)], "node_id string, shortage_qty double").withColumn("bucket_end", F.lit("2024-01-14").cast("date"))
    got = {r.node_id: ([c.fact for c in r.causes], [c.edge_type for c in r.causes], r.root_cause) for r in pegging.explain(short, edges, nodes).collect()}
    assert got["p1"] == (["Order D1 requires 9.000 units due 2024-01-03", "Buy late provides 50.000 units due 2024-01-20", "Buy late is 6 days late"], ["consumes", "replenishes", "depends_on"], "late")
    assert got["p2"][0] == ["nothing demands of this bucket", "Buy small provides 2.000 units due 2024-01-14", "Buy small is 4.000 units short of it"] and got["p2"][2] == "small"
    assert got["p3"][0][::2] == ["the demand is gone", "demand is more than all supply by 6.000 units"] and got["p3"][2] is None
    assert got["p4"][0][1:] == ["nothing replenishes this bucket", "no supply for a shortage of 6.000 units"]


def test_origins_add_up_to_dependent_demand(spark):
    params = spark.createDataFrame([(i, llc, make, held, 0.0) for i, llc, make, held in ((1, 0, True, 2.0), (2, 0, True, 0.0), (3, 1, True, 6.0), (4, 2, False, 0.0))], "item_id long, llc int, is_make boolean, on_hand double, safety double")
    flows = lambda rows: spark.createDataFrame(rows, "item_id long, qty double")
    bom = spark.createDataFrame([(1, 3, 1.0, 0.0), (2, 3, 2.0, 0.0), (3, 4, 1.0, 0.5), (1, 4, 1.0, 0.0)], "parent long, component long, qty_per double, scrap double")
    got = {(r.item_id, r.origin): r.qty for r in pegging.origins(params, flows([(1, 10.0), (2, 4.0), (3, 8.0)]), flows([(1, 2.0)]), bom).collect()}
    # 1 lacks 6, 2 lacks 4; 3 needs 6 + 8 + 8 of its own and lacks 16 of 22; 4 gets 24 in these shares, and 6 from 1.
    assert got == {(3, 1): 6.0, (3, 2): 8.0, (4, 1): pytest.approx(6 + 24 * 6 / 22), (4, 2): pytest.approx(24 * 8 / 22), (4, 3): pytest.approx(24 * 8 / 22)}


def days(spark, rows, schema, *names):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({n: F.col(n).cast("date") for n in names})


def test_working_days_past_long_closures(spark):
    """A place shut for 115 days, one without closures, steps of none, and past the calendar's end."""
    start = date(2024, 1, 5)
    shut = [start + timedelta(days=k) for k in range(1, 116)] + [date(2024, 5, 4)]
    rng = random.Random(2)
    rows = [(k, k % 2 + 1, str(start + timedelta(days=rng.randrange(140))), rng.choice([-1, 0, 1, 3, 40])) for k in range(60)] + [(60, 1, "2024-01-05", 3)]
    closed = days(spark, [(1, str(x)) for x in shut], "location_id long, day string", "day")
    got = {r.k: r.moved for r in capacity.add_working_days(days(spark, rows, "k long, location_id long, day string, n int", "day"), closed, "day", "n").collect()}
    for k, place, day, n in rows:
        day = date.fromisoformat(day)
        while n > 0:
            day += timedelta(days=1)
            n -= place == 2 or day not in shut
        assert got[k] == day
    assert got[60] == date(2024, 5, 2)


def test_working_days_between(spark):
    calendar = days(spark, [(1, "2024-01-06", True), (1, "2024-01-08", True), (1, "2024-01-09", False)], "location_id long, day string, works boolean", "day")
    rows = days(spark, [(1, "2024-01-05", "2024-01-09"), (1, "2024-01-09", "2024-01-12"), (2, "2024-01-01", "2024-01-14"), (None, "2024-01-06", "2024-01-07"), (1, "2024-01-09", "2024-01-01")], "location_id long, a string, b string", "a", "b")
    got = {(r.location_id, str(r.a)[8:], str(r.b)[8:]): r.working_days for r in capacity.count_working_days(rows, calendar, "a", "b").collect()}
    assert got == {(1, "05", "09"): 2, (1, "09", "12"): 4, (2, "01", "14"): 10, (None, "06", "07"): 0, (1, "09", "01"): 0}


def test_first_feasible_day_needs_stock_and_all_resources(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    atp = table([(1, 1, t, float(3 * t)) for t in range(8)], "item_id long, location_id long, day int, closing double")
    needs = table([(1, 10), (1, 11), (1, 10)], "item_id long, resource_id long")
    capacity_days = table([(r, t, 8.0) for r in (10, 11) for t in range(8)], "resource_id long, day int, capacity double")
    load = table([(10, 2, 6.0), (11, 3, 1.0), (11, 3, 2.0)], "resource_id long, day int, qty double")
    asked = table([("a", 1, 1, 6.0, 1), ("b", 1, 1, 9.0, 0), ("c", 1, 1, 3.0, 5), ("d", 2, 1, 1.0, 0), ("e", 1, 1, 2.0, 1)], "request_id string, item_id long, location_id long, qty double, request_day int")
    got = {r.request_id: r.feasible_day for r in capacity.first_feasible(asked, atp, needs, capacity_days, load, 7).collect()}
    assert got == {"a": 4, "b": None, "c": 5, "d": None, "e": 1}


def test_relief_frees_the_excess(spark):
    """Latest due first until enough is freed; no job beyond what is needed; overloads nobody bears on have no rows."""
    rng = random.Random(4)
    jobs = [(rng.randrange(3), k, rng.randrange(30), float(rng.randrange(1, 30))) for k in range(120)]
    overs = [(r, t, float(rng.randrange(1, 14))) for r in range(4) for t in range(0, 30, 3)]
    got = capacity.relief(spark.createDataFrame(overs, "resource_id long, day int, excess double"), spark.createDataFrame(jobs, "resource_id long, order_id long, due_day int, hours double"), 8.0, 28, 5).collect()
    want = []
    for r, t, excess in overs:
        freed = 0.0
        for _, k, due, hours in sorted((j for j in jobs if j[0] == r), key=lambda j: (-j[2], j[1])):
            took = max(1, -(-int(hours) // 8))
            if 0 <= due - t < took + 2 and freed < excess:
                far = min(t + 5, 28)
                want.append((r, t, k, hours / took, due, t + 1 if excess <= 8 and t + 1 <= far else far))
                freed += hours / took
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40


def plan_nodes(spark, rows):
    return days(spark, [(*r, True) for r in rows], "node_id string, node_type string, item_id long, location_id long, span_start string, sequence int, qty double, uom string, active boolean", "span_start")


def test_forks_overrides_and_promotion(spark):
    base = plan_nodes(spark, [("a", "PI", 1, None, "2024-01-01", 0, 5.0, None), ("b", "PI", 1, 2, "2024-01-01", 0, 6.0, "EA"), ("c", "PI", 2, 2, None, None, 7.0, "EA")]).withColumn("active", F.col("node_id") != "x")
    edges = spark.createDataFrame([("a", "b", 1)], "from_id string, to_id string, priority int")
    own, links = scenarios.fork(base, edges, "s")
    again, _ = scenarios.fork(base, edges, "s")
    ids = {r.item_id * 10 + (r.location_id or 0): r.node_id for r in own.collect()}
    assert {r.node_id for r in again.collect()} == set(ids.values()) and not set(ids.values()) & {"a", "b", "c"}
    assert [(r.from_id, r.to_id) for r in links.collect()] == [(ids[10], ids[12])]
    with pytest.raises(ValueError, match="without an active node"):
        scenarios.fork(base.withColumn("active", F.col("node_id") != "b"), edges, "s")

    fields = ("qty", "uom")
    schema = "node_id string, node_type string, item_id long, location_id long, span_start string, sequence int, field_name string, value string, at int"
    rows = [(ids[10], None, None, None, None, None, "qty", "50", 2), (ids[10], None, None, None, None, None, "qty", "60", 1), ("a", "PI", 1, None, "2024-01-01", 0, "uom", "KG", 1), ("c", "PI", 2, 2, None, None, "uom", None, 1), ("gone", "PI", 9, 9, None, None, "qty", "1", 1)]
    ledger = scenarios.recorded(own, days(spark, rows, schema, "span_start"), fields)
    assert {(r.node_id, r.field_name): (r.old_value, r.new_value) for r in ledger.collect()} == {(ids[10], "qty"): ("5.0", "50"), (ids[10], "uom"): (None, "KG"), (ids[22], "uom"): ("EA", None)}
    with pytest.raises(ValueError, match="can't be overridden"):
        scenarios.recorded(own, days(spark, [(ids[10], None, None, None, None, None, "item_id", "3", 1)], schema, "span_start"), fields)

    mine = scenarios.overridden(own, ledger, fields)
    assert sorted((r.item_id, r.location_id or 0, r.qty, r.uom, r.is_dirty) for r in mine.collect()) == [(1, 0, 50.0, "KG", True), (1, 2, 6.0, "EA", False), (2, 2, 7.0, None, True)]
    found = {(r.item_id, r.field_name): (r.base_value, r.scenario_value) for r in scenarios.difference(base, mine, fields).collect()}
    assert found == {(1, "qty"): ("5.0", "50.0"), (1, "uom"): (None, "KG"), (2, "uom"): ("EA", None)}

    after = {r.node_id: (r.qty, r.uom, r.is_dirty) for r in scenarios.promoted(base, own, ledger, fields).collect()}
    assert after == {"a": (50.0, "KG", True), "b": (6.0, "EA", False), "c": (7.0, None, True)}
    moved = base.withColumn("qty", F.col("qty") + 1)
    assert [tuple(r) for r in scenarios.conflicts(moved, own, ledger, fields).collect()] == [("a", "qty", "5.0", "6.0")]
    with pytest.raises(ValueError, match="the base has changed: a, qty, 5.0, 6.0"):
        scenarios.promoted(moved, own, ledger, fields)
    assert scenarios.promoted(base.where("node_id <> 'a'"), own, ledger, fields).count() == 2


def test_two_to_five_plans_are_compared(spark):
    figures = spark.createDataFrame([("x", 3, 1.5), ("y", 5, 1.0), ("base", 4, 2.0)], "plan string, shortages long, value double")
    got = {r["plan"]: (r.delta_shortages, r.delta_value) for r in scenarios.compared(figures, ["y", "x"], ["shortages", "value"]).collect()}
    assert got == {"y": (0, 0.0), "x": (-2, 0.5)}
    assert {r["plan"]: r.delta_value for r in scenarios.compared(figures, ["y", "base"], ["value"]).collect()} == {"y": -1.0, "base": 0.0}
    for order in (["x"], ["x", "x"], ["x", "y", "base", "a", "b", "c"]):
        with pytest.raises(ValueError, match="two to five"):
            scenarios.compared(figures, order, ["value"])
    with pytest.raises(ValueError, match="no such plans"):
        scenarios.compared(figures, ["x", "z"], ["value"])
