"""Weights, weighted sums and tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default scorecard's dimensions and weights, and the limits of tiers.
DEFAULT_CARD = [("momentum", 0.25), ("market", 0.2), ("demand", 0.2), ("feasibility", 0.2), ("fit", 0.15)]
CORE, SHORT = 78.0, 60.0
# How tiers and verdicts are shown.
TIER_NAMES = {"long": "Long-list", "short": "Short-list", "core": "핵심 Portfolio"}
VERDICT_MARKS = {"approved": "✅ 승인", "rejected": "❌ 반려"}


def normalise_weights(dimensions: Column) -> Column:
    """Weights of keyed dimensions (array of key and weight): none negative, of sum 1, equal if all are 0."""
    keyed = F.filter(dimensions, lambda d: F.coalesce(F.trim(d["key"]), F.lit("")) != "")
    least = F.transform(keyed, lambda d: F.struct(d["key"].alias("key"), F.greatest(F.coalesce(d["weight"].cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")))
    total = F.aggregate(least, F.lit(0.0), lambda s, d: s + d["weight"])
    n = F.size(least)
    return F.transform(least, lambda d: F.struct(d["key"].alias("key"), F.when(total > 0, d["weight"] / F.when(total > 0, total)).otherwise(F.lit(1.0) / F.when(n > 0, n)).alias("weight")))


def clamp(value: Column) -> Column:
    """A number from 0 to 100; 0 for what is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


#: 2 to the power of 52: the steps between 1 and 2 of a double.
STEPS = 1 << 52


def round_even(value: Column, digits: int = 1) -> Column:
    """A double rounded to at most three decimals by its exact value, ties to the even digit: 2.25 gives 2.2, and 0.15, which is a little less, 0.1.

    The fraction in steps of 2^-52 is a whole number but for a rest (of numbers below 1), so that what is cut off is compared with a half
    without an error.
    """
    scale = 10**digits

    def near(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size).cast("long")
        steps = (size - whole) * float(STEPS)
        n = F.floor(steps).cast("long")
        shifted = n * F.lit(scale).cast("long")
        kept = whole * scale + F.shiftright(shifted, 52)
        excess = (shifted.bitwiseAND(F.lit(STEPS - 1)) - (STEPS >> 1)).cast("double") + (steps - n) * float(scale)
        up = (excess > 0) | ((excess == 0) & (kept % 2 == 1))
        found = (kept + F.when(up, 1).otherwise(0)).cast("double") / float(scale)
        return F.when(size >= float(STEPS), v).otherwise(F.when(v < 0, -found).otherwise(found))

    # The value is an array's only element, so that it is made once for all that asks for it.
    return F.element_at(F.transform(F.array(value.cast("double")), near), 1)


def tier(total: Column, core: float = CORE, short: float = SHORT) -> Column:
    return F.when(total >= core, "core").when(total >= short, "short").otherwise("long")


def shown(value: Column, names: dict[str, str], default: Column) -> Column:
    """The name of a value in a fixed list, else the default."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], default)
