"""Small column helpers shared by the gates, scores and explanations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore of any script: the word characters the rules are written for.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def lowered(column: Column) -> Column:
    return F.lower(text(column))


def literal(value: object, ddl: str) -> Column:
    """A nested constant. The optimizer folds it to one literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def strings(values: Sequence[str]) -> Column:
    return literal(list(values), "array<string>")


def contains_any(haystack: Column, needles: Sequence[str]) -> Column:
    """One pattern of alternatives: compiled once per task and kept inside whole-stage codegen (no lambda)."""
    return haystack.rlike("|".join(re.escape(n) for n in needles))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once where ``use`` refers to it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps(value: Column, bounds: Sequence[tuple[float, float]], *, at_most: bool) -> Column:
    """First matching step of a points table; 0 when none matches (or the value is NULL)."""
    chain = None
    for bound, points in bounds:
        test = value <= F.lit(bound) if at_most else value >= F.lit(bound)
        chain = F.when(test, F.lit(float(points))) if chain is None else chain.when(test, F.lit(float(points)))
    return chain.otherwise(F.lit(0.0))


def exact_round(value: Column, digits: int) -> Column:
    """Round a non-negative double half-to-even on its exact binary value.

    ``round`` and ``bround`` decide ties on the shortest decimal text of the double, which differs from the
    exact value in the last place (0.00015 is a little below the tie). The product ``value * 10^digits`` is
    split into a rounded part and its exact remainder, so the comparison with one half is exact.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    spread = value * F.lit(134217729.0)  # 2^27 + 1: splits a double in two 26-bit halves
    high = spread - (spread - value)
    remainder = (high * scale - product) + (value - high) * scale
    whole = F.floor(product).cast("double")
    past_half = (product - whole) - F.lit(0.5)
    odd = (whole % F.lit(2.0)) == F.lit(1.0)
    up = (past_half > 0) | ((past_half == 0) & ((remainder > 0) | ((remainder == 0) & odd)))
    return (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
