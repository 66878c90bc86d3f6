"""Small planning rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Z scores of service levels, interpolated between.
Z_SCORES = ((0.5, 0.0), (0.8, 0.842), (0.85, 1.036), (0.9, 1.282), (0.95, 1.645), (0.975, 1.96), (0.99, 2.326), (0.995, 2.576), (0.999, 3.09))


def cents(price: Column) -> Column:
    """A price in whole cents, whose sums don't depend on the order of their terms."""
    return F.round(price * 100).cast("long")


def unit_price(cents: Column, qty: Column) -> Column:
    """Cents over a whole quantity as a price of 4 decimals, rounded once, half up."""
    units = qty.cast("long")
    return F.floor((cents * 200 + units) / (2 * units)).cast("long") / 10000


def z_score(level: Column) -> Column:
    """Linear interpolation of the table, clamped at its ends."""
    out = F.lit(Z_SCORES[-1][1])
    for (a, za), (b, zb) in reversed(list(zip(Z_SCORES, Z_SCORES[1:]))):
        out = F.when(level <= b, F.lit(za) + (level - a) / (b - a) * (zb - za)).otherwise(out)
    return F.when(level <= Z_SCORES[0][0], F.lit(Z_SCORES[0][1])).otherwise(out)


def safety_stock(demand: Column, deviation: Column, lead: Column, lead_deviation: Column, level: Column) -> Column:
    """z * sqrt(L sd^2 + d^2 sL^2)."""
    return z_score(level) * F.sqrt(lead * deviation * deviation + demand * demand * lead_deviation * lead_deviation)


def economic_quantity(annual: Column, ordering: Column, holding: Column) -> Column:
    """Wilson's lot; 1.0 for inputs that aren't positive."""
    good = (annual > 0) & (ordering > 0) & (holding > 0)
    return F.when(good, F.sqrt(2 * annual * ordering / holding)).otherwise(F.lit(1.0))


def program_of(order_type: Column) -> Column:
    """Buying program of an order type: the first keyword found, UNKNOWN if blank, else BASE."""
    upper = F.upper(F.trim(order_type))
    out = F.lit("BASE")
    for word in reversed(("SPRING", "SUMMER", "EARLY", "FWD BUY")):
        out = F.when(upper.contains(word), word.replace(" ", "_")).otherwise(out)
    return F.when(F.coalesce(upper, F.lit("")) == "", "UNKNOWN").otherwise(out)
