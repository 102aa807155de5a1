"""Vector expressions over ARRAY<DOUBLE> columns, evaluated in the JVM."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def constant(vector: Sequence[float]) -> Column:
    """A finite vector as one constant, folded before the plan runs, so that a search needs no join."""
    return F.from_json(F.lit(json.dumps([float(x) for x in vector])), "array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; NULL for a zero vector, a NULL or vectors of different width."""
    return F.when(F.size(a) == F.size(b), clamped(F.try_divide(dot(a, b), norm(a) * norm(b))))


def clamped(value: Column) -> Column:
    """`value` held within [-1, 1]; NULL and NaN stay without a value (least and greatest alone would skip NULL).

    The value is bound to a lambda's variable, so that it is worked out once however often it is named here.
    """
    held = F.transform(F.array(value), lambda v: F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))))
    return F.get(held, 0)


def unit(vector: Column) -> Column:
    """The vector scaled to length one; NULL for a zero vector or one without a finite length.

    Vector and length are bound to variables: within the lambda over the components they would be worked out for each.
    """

    def scaled(v: Column) -> Column:
        bound = F.transform(F.array(norm(v)), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n)))
        return F.get(bound, 0)

    return F.get(F.transform(F.array(vector), scaled), 0)


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """`cosine` to a vector that is known when the plan is made: scaled once, so that a row costs one product and one norm."""
    length = math.sqrt(sum(float(x) * x for x in vector))
    if not 0 < length < math.inf:
        return F.lit(None).cast("double")
    return F.when(F.size(a) == len(vector), clamped(F.try_divide(dot(a, constant([x / length for x in vector])), norm(a))))


def rounded_cosine_to(a: Column, vector: Sequence[float], places: int = 6) -> Column:
    """The score that rankings use: rounded before ranking, so that ties fall to the id whatever the summation order."""
    return F.round(cosine_to(a, vector), places)
