"""What larger or odder tables bring out: repeated lines, and what a task must hold."""

import duckdb
import pytest

from stockweave.operators import actions, pegging
from stockweave.plans import catalog as registry
from stockweave.sources import planning
from stockweave.streaming import events as streams

DATA = "/root/testdata/sf0.001"

#: Queries on the running stock of a series' buckets; none of them needs to sort, or to look up, a row for each bucket.
RUNNING = (
    "projection projection_by_day projection_by_month projection_by_calendar_month shortages_per_site worst_shortages shortage_delta shortage_scan dq_impact portfolio first_shortage "
    "scenario_compare available_to_promise scenario_differences"
).split()


def test_days_to_due_of_a_line_that_comes_twice(spark, tmp_path):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        again = f" UNION ALL SELECT * FROM '{DATA}/{name}.parquet' WHERE l_orderkey % 3 = 0" if name == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '{DATA}/{name}.parquet'{again}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = sorted((r.id, str(r.b), r.working_days) for r in registry.QUERIES["days_to_due"](spark, str(tmp_path)).collect())
    con.execute(registry.ORACLE_SQL["days_to_due"])
    want = sorted((i, str(b), n) for i, b, n in con.fetchall())
    assert got == want and len(set(want)) < len(want)


@pytest.mark.parametrize("name", RUNNING)
def test_running_stock_is_not_sorted_by_bucket(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_plan_s_buckets_are_not_sorted_to_meet_changes(spark):
    nodes = spark.sql("select 'o' as node_id, cast(null as date) as start, 1 as item_id, 1 as location_id union all select 'b', date'2024-01-01', 1, 1")
    events = spark.sql("select 'e' as event_id, 'o' as trigger_id, date'2024-01-01' as old_date, date'2024-01-02' as new_date")
    found = pegging.dirty(events, spark.sql("select 'o' as from_id, 'x' as to_id"), nodes)
    assert "strategy=shuffle_hash" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.node_id for r in found.collect()) == ["b", "o"]


def partitionings(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]


def test_pegged_series_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    """A task sorts as many demands whatever the number of lines."""
    whole = registry.QUERIES["demand_pegging"](spark, DATA)
    monkeypatch.setattr(planning, "SHARE", 1000)
    n = planning.tasks(spark, DATA)
    found = registry.QUERIES["demand_pegging"](spark, DATA)
    assert n > 4 and any(x.endswith(f", {n}") for x in partitionings(found))
    assert sorted(found.collect()) == sorted(whole.collect())


def test_a_walk_s_steps_are_dealt_by_what_they_meet(spark, monkeypatch):
    seen, kept = [], pegging.counted
    monkeypatch.setattr(pegging, "counted", lambda df, *by: seen.append(partitionings(df)) or kept(df, *by))
    monkeypatch.setattr(pegging, "STEP_ROWS", 2)
    edges = spark.sql("select 'e' as edge_type, cast(id as string) as from_id, cast(id + 1 as string) as to_id from range(8)")
    found = pegging.walk(edges, spark.sql("select '0' as node_id"), 2, 3)
    assert sorted((r.depth, r.node_id) for r in found.collect()) == [(0, "0"), (1, "1"), (2, "2")]
    assert [x.endswith(", 3") for x in seen[0]] == [True] and len(seen[2]) == 3 and all(x.endswith(", 5") for x in seen[2])


def test_suppliers_of_an_item_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(planning, "SHARE", 1000)
    n = planning.tasks(spark, DATA)
    assert [x.endswith(f", {n}") for x in partitionings(registry.QUERIES["shortage_scan"](spark, DATA))] == [True, True]


def test_pairs_of_a_closure_are_not_sorted_to_meet_short_items(spark):
    closure = spark.sql("select 1 as ancestor, 2 as component, 1 as depth union all select 1, 3, 2 union all select 2, 3, 1")
    found = actions.affected(closure, spark.sql("select 3 as item_id"), spark.sql("select 1 as item_id union all select 2"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") >= 2 and "distinct" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2), (2, 1, 1)]


def test_series_are_not_sorted_to_meet_their_items(spark):
    plan = registry.QUERIES["shortages_per_site"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan


@pytest.mark.parametrize("name", ["streamed_projection", "incremental_projection"])
def test_moves_of_changed_series_are_dealt_by_the_number_of_lines(spark, monkeypatch, name):
    """A task sums as many series' moves whatever the number of lines, and however Spark groups what it has shuffled."""
    seen, kept = [], streams.counted
    monkeypatch.setattr(streams, "counted", lambda df, *by: seen.extend(partitionings(df)) or kept(df, *by))
    monkeypatch.setattr(planning, "SHARE", 1000)
    n = planning.tasks(spark, DATA)
    found = registry.QUERIES[name](spark, DATA)
    assert n > 4 and [x.endswith(f", {n}") for x in seen + partitionings(found)] == [True]
    assert sorted(found.collect()) == sorted(registry.QUERIES["projection"](spark, DATA).collect())


def test_dirty_nodes_takes_no_step_for_a_bucket(spark, monkeypatch):
    """Series are walked along within their rows, dealt by the number of lines; before, each of 26 buckets was a job."""
    steps, kept = [], pegging.counted
    monkeypatch.setattr(pegging, "counted", lambda df, *by: steps.append(1) or kept(df, *by))
    monkeypatch.setattr(planning, "SHARE", 1000)
    n = planning.tasks(spark, DATA)
    found = registry.QUERIES["dirty_nodes"](spark, DATA)
    assert not steps and n > 4 and [x.endswith(f", {n}") for x in partitionings(found)] == [True, True]


def test_dirty_nodes_of_orders_that_come_twice_or_miss_dates(spark, tmp_path):
    con = duckdb.connect()
    odd = {
        "part": f"SELECT * FROM '{DATA}/part.parquet'",
        "orders": f"SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM '{DATA}/orders.parquet' UNION ALL SELECT * REPLACE (o_orderdate + INTERVAL 50 DAY AS o_orderdate) FROM '{DATA}/orders.parquet' WHERE o_orderkey % 3 = 0",
        "lineitem": f"SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey END AS l_partkey) FROM '{DATA}/lineitem.parquet' UNION ALL SELECT * FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 2 = 0",
    }
    for name, rows in odd.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = sorted(map(tuple, registry.QUERIES["dirty_nodes"](spark, str(tmp_path)).select("event_id", "node_id").collect()))
    con.execute(registry.ORACLE_SQL["dirty_nodes"])
    assert got == sorted(con.fetchall()) and len(got) > 1000
