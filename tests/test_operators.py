"""Operators that SQL can't state, against plain Python, and their edge cases."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stockweave.operators import actions, bom, demand, mrp, netting, supply

rng = random.Random(3)


def lots(net, on_hand, p, weeks):
    """Orders of one item, week by week."""
    out, stock = [], on_hand
    lead = -(-(p["lead_days"] or 30) // 7)
    for t in range(weeks):
        stock -= net[t]
        if stock < p["safety"]:
            short, rule = p["safety"] - stock, p["lot_rule"]
            qty = short
            if rule == "POQ":
                qty += sum(max(0, net[k]) for k in range(t + 1, min(t + p["periods"], weeks)))
            if rule == "EOQ" and p["eoq"] > 0:
                qty = max(p["eoq"], short)
            if rule == "MIN_MAX" and p["top"] > 0:
                qty = p["safety"] + p["top"] - stock
            if rule == "FIXED_QTY" and p["moq"] > 0:
                qty = math.ceil(short / p["moq"]) * p["moq"]
            qty = max(qty, p["moq"])
            if p["multiple"] > 0:
                qty = math.ceil(qty / p["multiple"]) * p["multiple"]
            if p["most"] > 0 and rule != "MIN_MAX":
                qty = min(qty, p["most"])
            stock += qty
            out.append((qty, max(0, t - lead), t, t < lead))
    return out


@pytest.mark.parametrize("together", [0, 3, 4096])
def test_cascade_by_hand(spark, together):
    rng = random.Random(3)
    weeks, edges = 8, [(1, 3, 2.0, 0.0), (1, 4, 1.0, 0.5), (2, 4, 3.0, 0.0), (3, 5, 1.0, 0.0), (4, 5, 2.0, 0.25)]
    levels = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 0}
    made = {a for a, *_ in edges}
    rules = ["L4L", "POQ", "EOQ", "MIN_MAX", "FIXED_QTY", "L4L"]
    params = [dict(item_id=i, llc=levels[i], is_make=i in made, on_hand=float(i), safety=float(i % 3), lead_days=[None, 0, 7, 10, 21, 5][i - 1], lot_rule=rules[i - 1], periods=3, eoq=16.0, top=8.0, moq=4.0 * (i % 2), multiple=2.0 * (i % 3), most=12.0) for i in levels]
    gross = [(1, t, float(rng.randrange(1, 9))) for t in range(weeks)] + [(2, 3, 6.0), (2, 3, 1.0), (2, 99, 5.0), (4, 0, 2.0)]
    receipts = [(1, 2, 5.0), (5, 1, 7.0), (6, 0, 1.0)]
    schema = "item_id long, llc int, is_make boolean, on_hand double, safety double, lead_days int, lot_rule string, periods int, eoq double, top double, moq double, multiple double, most double"
    flows = lambda x: spark.createDataFrame(x, "item_id long, bucket int, qty double")
    bill = spark.createDataFrame(edges, "parent long, component long, qty_per double, scrap double")
    got = mrp.cascade(spark.createDataFrame([tuple(p.values()) for p in params], schema), flows(gross), flows(receipts), bill, weeks, together=together).collect()
    need = {i: [0.0] * weeks for i in levels}
    asked = {i for i, *_ in gross}
    for i, t, q in gross:
        if t < weeks:
            need[i][t] += q
    want = []
    for p in sorted(params, key=lambda p: p["llc"]):
        i = p["item_id"]
        if i not in asked:
            continue  # no demand: no orders, not even for the safety stock
        net = [need[i][t] - sum(q for j, s, q in receipts if (j, s) == (i, t)) for t in range(weeks)]
        for qty, release, t, late in lots(net, p["on_hand"], p, weeks):
            want.append((i, qty, release, t, "WO" if i in made else "PO", late))
            for a, c, per, scrap in edges:
                if a == i:
                    need[c][release] += qty * per * (1 + scrap)
                    asked.add(c)
    assert sorted((r.item_id, round(r.qty, 6), r.release_bucket, r.need_bucket, r.kind, r.past_due) for r in got) == sorted((i, round(q, 6), *rest) for i, q, *rest in want)
    assert {r.item_id for r in got} == {1, 2, 3, 4, 5} and len({r.kind for r in got}) == 2


def test_lots_are_exact():
    """Against fractions, over all rules, with quantities of which doubles aren't exact: what is exactly enough makes no order."""
    rng = random.Random(11)
    orders = 0
    for n in range(400):
        rule = ("L4L", "POQ", "EOQ", "MIN_MAX", "FIXED_QTY")[n % 5]
        p = dict(safety=rng.choice([0, 5]), lot_rule=rule, periods=rng.randrange(1, 5), eoq=rng.choice([0, 40]), top=rng.choice([0, 60]), moq=rng.choice([0, 5, Fraction(13, 10)]), multiple=rng.choice([0, 0, Fraction(7, 10)]), most=rng.choice([0, 0, 55]), lead_days=rng.choice([None, 0, 3, 15]))
        net = [Fraction(rng.choice([0, 0, 1, 105, 1050, 11025, -2205]), 1000) * rng.randrange(1, 9) for _ in range(26)]
        on_hand = Fraction(rng.choice([0, 13, 105]), 10)
        whole = lambda x: int(x * mrp.UNIT)
        got = mrp.plan_item([whole(x) for x in net], whole(on_hand), p["lead_days"], whole(p["safety"]), rule, p["periods"], *(whole(p[k]) for k in ("eoq", "top", "moq", "multiple", "most")))
        want = lots(net, on_hand, p, 26)
        assert [(Fraction(q, mrp.UNIT), *rest) for q, *rest in got] == want
        orders += len(want)
    assert orders > 1000


def test_receipts_are_placed_where_half_of_them_is_used(spark):
    """The rule walked bucket by bucket: stock below safety is a need in the first, without demand there too."""
    rng = random.Random(7)
    weeks, items, gross, receipts = 10, [], [], []
    for i in range(60):
        items.append((i, float(rng.choice([0, 3, 20])), float(rng.choice([0, 10]))))
        gross += [(i, t, float(rng.randrange(1, 6))) for t in range(weeks + 2) if rng.random() < 0.4]
        receipts += [(i, 100 * i + k, f"2024-01-{rng.randrange(1, 28):02d}", float(rng.randrange(1, 15))) for k in range(rng.randrange(4))]
    want = {}
    for i, stock, safety in items:
        needs = []
        for t in range(weeks):
            stock -= sum(q for j, b, q in gross if (j, b) == (i, t))
            if stock < safety:
                needs.append([t, safety - stock])
                stock = safety
        for _, key, due, qty in sorted((r for r in receipts if r[0] == i), key=lambda r: (r[2], r[1])):
            got, left, want[key] = 0.0, qty, None
            while left > 0 and needs:
                take = min(left, needs[0][1])
                got, left, needs[0][1] = got + take, left - take, needs[0][1] - take
                if want[key] is None and got >= qty / 2:
                    want[key] = needs[0][0]
                if not needs[0][1]:
                    needs.pop(0)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    due = table(receipts, "item_id long, receipt_id long, due string, qty double").withColumn("due", F.col("due").cast("date"))
    placed = actions.needed_in(due, table(gross, "item_id long, bucket int, gross double"), table(items, "item_id long, on_hand double, safety double"), weeks)
    assert {r.receipt_id: r.need for r in placed.collect()} == want


def test_bills_are_as_deep_as_they_are_and_cycles_raise(spark):
    table = lambda edges: spark.createDataFrame(edges, "parent long, component long")
    deep = [(i, i + 1) for i in range(70)]
    levels = {r.item_id: r.llc for r in bom.low_level_codes(spark.range(71).select(F.col("id").alias("item_id")), table(deep)).collect()}
    assert levels == {i: i for i in range(71)}
    with pytest.raises(ValueError, match="cycle"):
        bom.low_level_codes(spark.range(3).select(F.col("id").alias("item_id")), table([(0, 1), (1, 2), (2, 1)]))
    with pytest.raises(ValueError, match="cycle"):
        bom.explode(spark.createDataFrame([(0, 1.0)], "item_id long, qty double"), table([(0, 1), (1, 0)]).withColumns({"qty_per": F.lit(1.0), "scrap": F.lit(0.0)}))
    assert bom.closure(table([])).count() == 0


def test_windowed_consumption_by_hand(spark):
    rows = [(i, b, float(rng.choice([0, 3, 8])), float(rng.choice([0, 5, 9]))) for i in range(4) for b in range(9)]
    got = {(r.item_id, r.bucket): r.gross for r in netting.consume_windowed(spark.createDataFrame(rows, "item_id long, bucket int, orders double, forecast double"), window=2, fence=2).collect()}
    want = {}
    for i in range(4):
        left = {b: f for j, b, _, f in rows if j == i}
        for j, b, qty, _ in rows:
            if j == i and b >= 2:
                for at in (b, b - 1, b + 1, b - 2, b + 2):
                    if at >= 2 and left.get(at, 0) > 0:
                        eaten = min(qty, left[at])
                        left[at] -= eaten
                        qty -= eaten
        for j, b, orders, _ in rows:
            if j == i:
                want[i, b] = orders + (left[b] if b >= 2 else 0.0)
    assert got == {k: v for k, v in want.items() if v}


def test_pareto_ranks_ties_and_many_parts(spark):
    rows = [(i, float(rng.choice([1, 2, 2, 5, 40]))) for i in range(500)]
    got = {r.item_id: (r.rank, r.share) for r in demand.pareto(spark.createDataFrame(rows, "item_id long, qty double"), parts=7).collect()}
    total = sum(q for _, q in rows)
    done = 0.0
    for n, (i, q) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        done += q
        assert got[i] == (n, pytest.approx(done / total, abs=1e-6))


def test_as_of_takes_the_day_itself(spark):
    facts = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (1, 9, 4.0)], "k long, t int, v double")
    asked = spark.createDataFrame([(1, 4), (1, 5), (1, 8), (2, 9), (1, 8)], "k long, t int")
    assert sorted((r.k, r.t, r.v) for r in actions.as_of(asked, facts, ["k"], "t", "v").collect() if r.v) == [(1, 5, 3.0), (1, 8, 3.0), (1, 8, 3.0)]


def test_fair_shares():
    lane = lambda s, d, priority=1, lead=1, multiple=1.0, least=0.0, most=math.inf: (priority, s, d, lead, multiple, least, most)
    # Proportional, rounded down; what is left goes to the neediest.
    got = supply.fair_shares({0: 12.0}, {1: (3, 20.0), 2: (0, 20.0)}, [lane(0, 1, multiple=12.0), lane(0, 2, multiple=12.0)])
    assert got == [(0, 1, 12.0, 2, 3)]
    got = supply.fair_shares({0: 10.0}, {1: (3, 6.0), 2: (0, 9.0)}, [lane(0, 1), lane(0, 2, lead=2)])
    assert got == [(0, 1, 4.0, 2, 3), (0, 2, 6.0, 0, 2)]
    # A lower priority waits; a lane's most and least hold.
    got = supply.fair_shares({0: 30.0, 1: 5.0}, {2: (1, 20.0)}, [lane(0, 2, priority=2), lane(1, 2, priority=1)])
    assert got == [(1, 2, 5.0, 0, 1), (0, 2, 15.0, 0, 1)]
    assert supply.fair_shares({0: 30.0}, {2: (1, 20.0)}, [lane(0, 2, most=8.0), lane(0, 2, least=15.0)]) == [(0, 2, 8.0, 0, 1)]
    # Sources with the lowest priority of any lane come first, whatever their number.
    got = supply.fair_shares({0: 9.0, 1: 9.0}, {2: (1, 10.0), 3: (1, 1.0)}, [lane(0, 2, priority=2), lane(1, 2, priority=2), lane(1, 3, priority=1)])
    assert got[0] == (1, 3, 1.0, 0, 1) and got[1][:3] == (1, 2, 8.0)
    assert supply.fair_shares({}, {}, []) == []
