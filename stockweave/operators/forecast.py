"""Forecast methods and their accuracy, as folds and aggregates over ordered series."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(points: DataFrame, periods: int) -> DataFrame:
    """item_id, values: dense arrays of `periods` sums, zero where there is no demand."""
    sums = points.groupBy("item_id", "period").agg(F.sum("qty").alias("qty"))
    pairs = sums.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("period", "qty"))).alias("found"))
    return pairs.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0.0))).alias("values"))


def moving_average(values: Column, k: int) -> Column:
    """Mean of the last k values; null for fewer."""
    last = F.slice(values, -k, k)
    return F.when(F.size(values) >= k, F.aggregate(last, F.lit(0.0), lambda s, x: s + x) / k)


def exponential(values: Column, alpha: float) -> Column:
    """Simple exponential smoothing from the first value on."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda f, x: alpha * x + (1 - alpha) * f)


def croston(values: Column) -> Column:
    """Mean positive size over mean interval; one positive value stands for itself, none is 0."""
    at = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] > 0)
    total = F.aggregate(at, F.lit(0.0), lambda s, e: s + e["x"])
    span = F.element_at(at, -1)["i"] - F.element_at(at, 1)["i"]
    n = F.size(at)
    return F.when(n == 0, 0.0).when(n == 1, total).otherwise((total / n) / (span / (n - 1)))


def seasonal_naive(values: Column, season: int, horizon: int) -> Column:
    """The last season repeated, none below 0."""
    last = F.slice(values, -season, season)
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.greatest(F.lit(0.0), F.element_at(last, (h % season + 1).cast("int"))))


def value_added(data: DataFrame, season: int, horizon: int, method: Callable[[Column], Column]) -> DataFrame:
    """naive: WAPE of the seasonal-naive forecast of the last `horizon` values; value_added: the share of its error that `method` avoids."""
    past, future = F.slice("values", F.lit(1), F.size("values") - horizon), F.slice("values", -horizon, horizon)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = data.select("item_id", future.alias("future"), seasonal_naive(past, season, horizon).alias("naive"), method(past).alias("flat"))
    naive = total(F.zip_with("future", "naive", lambda a, f: F.abs(a - f)))
    own = total(F.transform("future", lambda a: F.abs(a - F.col("flat"))))
    return both.select("item_id", (naive / F.nullif(total(F.col("future")), F.lit(0.0))).alias("naive"), (1 - own / F.nullif(naive, F.lit(0.0))).alias("value_added"))


def accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MAPE, bias, MAD, MSE, tracking signal, WAPE and sMAPE of (actual, forecast) rows."""
    e = F.col("actual") - F.col("forecast")
    both = F.abs("actual") + F.abs("forecast")
    r = lambda c, n: (F.round(c, n) + F.lit(0.0))  # noqa: E731  no negative zeros
    mad = F.avg(F.abs(e))
    return pairs.groupBy(*keys).agg(
        r(F.avg(F.when(F.col("actual") != 0, F.abs(e) / F.abs("actual") * 100).otherwise(0.0)), 6).alias("mape"),
        r(F.sum(e), 6).alias("bias"),
        r(mad, 6).alias("mad"),
        r(F.avg(e * e), 6).alias("mse"),
        r(F.sum(F.abs(e)) / F.nullif(F.sum(F.abs("actual")), F.lit(0.0)), 6).alias("wape"),
        r(F.avg(F.when(both != 0, 2 * F.abs(e) / both)), 6).alias("smape"),
        r(F.sum(e) / F.nullif(mad, F.lit(0.0)), 4).alias("tracking"),
    )


#: For every value of a series the forecast made from the values before it.
Running = Callable[[Column], Column]


def folded(values: Column, start: Column, update: Callable[[Column, Column], Column], forecast: Callable[[Column], Column]) -> Column:
    """Forecasts from a state that each value updates, in one pass over the series."""
    zero = F.struct(start.alias("state"), F.array().cast("array<double>").alias("made"))
    step = lambda acc, x: F.struct(update(acc["state"], x).alias("state"), F.concat(acc["made"], F.array(forecast(acc["state"]).cast("double"))).alias("made"))
    return F.aggregate(values, zero, step)["made"]


def running_average(k: int) -> Running:
    """moving_average() from every origin."""
    sums = lambda v: F.transform(v, lambda _, i: F.when(i >= k, F.aggregate(F.slice(v, F.greatest(i - (k - 1), F.lit(1)), F.lit(k)), F.lit(0.0), lambda s, x: s + x) / k))
    return sums


def running_exponential(alpha: float) -> Running:
    """exponential() from every origin."""
    return lambda v: folded(v, F.lit(None).cast("double"), lambda f, x: F.coalesce(alpha * x + (1 - alpha) * f, x), lambda f: f)


def running_croston(values: Column) -> Column:
    """croston() from every origin."""
    state = lambda i, n, total, first, last: F.struct(i.alias("i"), n.alias("n"), total.alias("total"), first.alias("first"), last.alias("last"))
    zero = F.lit(0)

    def update(s: Column, x: Column) -> Column:
        some = x > 0
        return state(s["i"] + 1, F.when(some, s["n"] + 1).otherwise(s["n"]), F.when(some, s["total"] + x).otherwise(s["total"]), F.when(some & (s["n"] == 0), s["i"]).otherwise(s["first"]), F.when(some, s["i"]).otherwise(s["last"]))

    made = lambda s: F.when(s["n"] == 0, 0.0).when(s["n"] == 1, s["total"]).otherwise((s["total"] / s["n"]) / ((s["last"] - s["first"]) / (s["n"] - 1)))
    return folded(values, state(zero, zero, F.lit(0.0), zero, zero), update, made)


def backtest(data: DataFrame, methods: Mapping[str, Running], first: int, periods: int) -> DataFrame:
    """(item_id, method, origin, actual, forecast): one-step forecasts of all methods from every origin on, each from the values before it."""
    own = lambda n, f: F.struct(F.lit(n).alias("method"), f(F.col("values")).alias("made"))
    by_method = data.select("item_id", "values", F.explode(F.array(*(own(n, f) for n, f in methods.items()))).alias("m"))
    at = F.transform(F.sequence(F.lit(first), F.lit(periods - 1)), lambda i: F.struct(i.alias("origin"), F.element_at("values", i + 1).alias("actual"), F.element_at("m.made", i + 1).alias("forecast")))
    return by_method.select("item_id", "m.method", F.explode(at).alias("o")).select("item_id", "method", "o.*")


def candidates(values: Column, windows: tuple[int, ...] = (3, 6, 12), alphas: tuple[float, ...] = (0.2, 0.5, 0.8), intermittent: float = 0.2) -> Column:
    """The methods that suit a series, as (label, first, made): from which origin on each can forecast, and its forecasts from every origin, 0 at least, the one after the last value included.

    Moving averages need their window; Croston's method is for series of which this share of values or more is zero.
    """
    more = F.concat(values, F.array(F.lit(0.0)))
    one = lambda label, first, f: F.struct(F.lit(label).alias("label"), F.lit(first).alias("first"), F.transform(f(more), lambda x: F.greatest(x, F.lit(0.0))).alias("made"))
    all_ = [one(f"MA(window={w})", w, running_average(w)) for w in windows] + [one(f"EXP_SMOOTHING(alpha={a:.2f})", 1, running_exponential(a)) for a in alphas] + [one("CROSTON", 1, running_croston)]
    zeros = F.size(F.filter(values, lambda x: x == 0)) / F.size(values)
    return F.filter(F.array(*all_), lambda c: (c["first"] <= F.size(values)) & ((c["label"] != "CROSTON") | (zeros >= intermittent)))


def evaluated(data: DataFrame, horizon: int, last: int = 52) -> DataFrame:
    """(item_id, label, wape, value): each candidate's WAPE over rolling origins (the `last` ones) and `horizon` steps from each, and its next forecast.

    Every forecast is flat over its steps; steps past the end of the series are left out. A series of fewer than 3 values, or without demand, has no WAPE.
    """
    rows = data.select("item_id", "values", F.explode(candidates(F.col("values"))).alias("c"))
    n, first = F.size("values"), F.greatest(F.col("c.first"), F.size("values") - last)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    empty = F.array().cast("array<double>")
    error, actual = F.lit(0.0), F.lit(0.0)
    for k in range(horizon):
        count = n - k - first
        seen = F.when(count > 0, F.slice("values", first + k + 1, count)).otherwise(empty)
        made = F.when(count > 0, F.slice("c.made", first + 1, count)).otherwise(empty)
        error, actual = error + add(F.zip_with(seen, made, lambda a, f: F.abs(a - f))), actual + add(seen)
    wape = F.when(n >= 3, F.round(error / F.nullif(actual, F.lit(0.0)), 9))
    return rows.select("item_id", "c.label", wape.alias("wape"), F.element_at("c.made", n + 1).alias("value"))


def selected(scored: DataFrame) -> DataFrame:
    """(item_id, label, wape, value, ensemble): the candidate of the least WAPE, ties by label (without any WAPE the first), and all of them blended.

    A blend weighs each by 1 / WAPE (of 0.0001 at least), or by 1 if it has none.
    """
    weight = F.when(F.col("wape").isNull(), 1.0).otherwise(1 / F.greatest("wape", F.lit(1e-4)))
    best = F.min(F.struct(F.col("wape").isNull().alias("none"), "wape", "label", "value"))
    both = scored.groupBy("item_id").agg(best.alias("b"), (F.sum(F.col("value") * weight) / F.sum(weight)).alias("ensemble"))
    return both.select("item_id", "b.label", "b.wape", "b.value", F.greatest("ensemble", F.lit(0.0)).alias("ensemble"))


def confidence(wape: Column, depth_days: Column, age_days: Column, sla: int = 7, enough: int = 365, unknown: float = 0.25) -> Column:
    """(score, accuracy, depth, freshness, stale): half by the error, a quarter each by how long the history is and how old its last entry.

    Each part is from 0 to 1, of 4 decimals; what isn't known counts as `unknown`. Data older than `sla` days are stale.
    """
    part = lambda c: F.bround(c.cast("decimal(20,10)"), 4)
    known = lambda c, v: part(F.when(c.isNull(), F.lit(unknown)).otherwise(v))
    age = F.greatest(age_days, F.lit(0))
    accuracy, depth = known(wape, 1 / (1 + wape)), known(depth_days, F.least(F.lit(1.0), depth_days / enough))
    fresh = known(age_days, F.when(age <= sla, 1.0).otherwise(sla / F.greatest(age, F.lit(1))))
    score = F.bround(accuracy * F.lit(0.5).cast("decimal(4,2)") + depth * F.lit(0.25).cast("decimal(4,2)") + fresh * F.lit(0.25).cast("decimal(4,2)"), 4)
    return F.struct(*(c.cast("double").alias(x) for c, x in ((score, "score"), (accuracy, "accuracy"), (depth, "depth"), (fresh, "freshness"))), F.coalesce(age > sla, F.lit(False)).alias("stale"))


def best_method(scored: DataFrame) -> DataFrame:
    """Each item's method of the least WAPE, ties by name; items without a score are left out."""
    return scored.where("wape is not null").groupBy("item_id").agg(F.min(F.struct("wape", "method")).alias("b")).select("item_id", "b.method", "b.wape")


def interval(residuals: DataFrame, alpha: float) -> DataFrame:
    """Conformal bounds per item from order statistics; items with too few residuals are left out."""
    n = F.size("r")
    lists = residuals.groupBy("item_id").agg(F.sort_array(F.collect_list("residual")).alias("r")).where(n >= F.ceil(F.lit(2 / alpha)) - 1)
    low = F.greatest(F.lit(1), F.floor((n + 1) * alpha / 2)).cast("int")
    high = F.least(n, F.ceil((n + 1) * (1 - alpha / 2))).cast("int")
    return lists.select("item_id", n.alias("n"), F.element_at("r", low).alias("low"), F.element_at("r", high).alias("high"))


def seasonal_profile(points: DataFrame, season: int, periods: int) -> DataFrame:
    """Seasonal index of each position: its mean over the last whole cycles by the grand mean."""
    whole = periods // season * season
    used = points.where(F.col("period") >= periods - whole)
    sums = used.groupBy("item_id", (F.pmod(F.col("period") - (periods - whole), F.lit(season))).alias("position")).agg(F.sum("qty").alias("qty"))
    grand = F.sum("qty").over(Window.partitionBy("item_id"))
    return sums.select("item_id", "position", F.round(F.col("qty") * season / F.nullif(grand, F.lit(0.0)), 6).alias("index"))


def middle_out(curves: DataFrame, weights: DataFrame) -> DataFrame:
    """A node's curve split over its leaves by historical share; leaves without history take their siblings' mean.

    Quantities and weights are whole numbers of units. A leaf's share is w k / (S n): its
    weight w, the sum S of the k positive weights and n leaves; without history it is 1 / n.
    The product is rounded once, half up, to 6 decimals.
    """
    own = Window.partitionBy("node")
    whole = lambda c: c.cast("decimal(38,0)")
    known = F.col("weight") > 0
    total = F.greatest(F.coalesce(F.sum(F.when(known, F.col("weight"))).over(own), F.lit(0.0)), F.lit(1.0))
    parts = weights.select("node", "leaf", whole(F.when(known, F.col("weight") * F.count_if(known).over(own)).otherwise(total)).alias("part"), whole(total * F.count("*").over(own)).alias("all"))
    both = curves.join(parts, "node").select("node", "leaf", "period", (whole(F.col("qty")) * F.col("part") * 2000000).alias("x"), "all")
    return both.select("node", "leaf", "period", (F.expr("(x + all) div (all * 2)") / 1000000).alias("qty"))
