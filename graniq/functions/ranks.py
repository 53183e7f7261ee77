"""The text rank of a database over word positions, as Column expressions.

Two words at a distance d add a weight w(d) that falls off quickly; all pairs of places of two
different query words count, and the rank is 1 less the product of 1 - w. For a single word its
places count by their number alone. A word has at most 255 places, and places end at 16383. The
rank has the precision of a float: seven decimals, so far pairs and saturated ranks are ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight of a word in a plain text, the last place, the most places of a word, the farthest distance that counts, the limit of the sum of 1 / n².
WEIGHT, LAST, MOST, FAR, LIMIT = 0.1, 16383, 255, 100, 1.64493406685


def pair_weight(d: int) -> float:
    return WEIGHT * math.sqrt(1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))


_LOGS = [math.log1p(-pair_weight(d)) for d in range(1, FAR + 1)]
_SINGLE = [0.0]
for _j in range(1, MOST + 1):
    _SINGLE.append(_SINGLE[-1] + WEIGHT / _j**2)


def places(positions: Column) -> Column:
    """Positions (from 1, in order) as they are kept of a word."""
    return F.slice(F.array_distinct(F.transform(positions, lambda p: F.least(p, F.lit(LAST)))), 1, MOST)


def _of(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def rank(words: Column) -> Column:
    """Rank of a text that has all of several words: words is an array, for each of them, of its places."""
    zero = F.lit(0.0)
    total = lambda xs, of: F.aggregate(xs, zero, lambda s, x: s + of(x))
    near = lambda a, b: F.when(F.abs(a - b).between(1, FAR), _of(_LOGS, F.greatest(F.abs(a - b), F.lit(1)).cast("int"))).otherwise(zero)
    # Each word is paired with those before it.
    numbered = F.transform(words, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    logs = total(numbered, lambda w: total(F.slice(words, 1, w["i"]), lambda other: total(w["p"], lambda a: total(other, lambda b: near(a, b)))))
    alone = _of(_SINGLE, F.size(F.element_at(words, 1)) + 1) / LIMIT
    return F.round(F.when(F.size(words) == 1, alone).otherwise(1 - F.exp(logs)), 7)


def bound(words: Column, pairs: Column, most: Column) -> Column:
    """No rank of ``words`` words with at most ``pairs`` pairs of places, or of one with at most ``most`` places, is above this."""
    return F.when(words == 1, _of(_SINGLE, F.least(most, F.lit(MOST)).cast("int") + 1) / LIMIT).otherwise(1 - F.exp(pairs * _LOGS[0])) + 1e-7
