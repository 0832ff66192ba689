"""Vector columns (arrays of numbers) as expressions, and their grouped sums without exploding.

Sums run in the JVM over dense vectors with map-side combination, so a group's cost in a shuffle is one vector per task.
Guards for zero norms: "eps" puts 1e-10 for the norm (similarity 0), "null" gives null, "none" divides as it is.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def as_double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def is_valid(v: Column | str) -> Column:
    """Not null, not empty, and without null or NaN."""
    v = as_double(v)
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def vector_sum(v: Column | str) -> Column:
    """Aggregate: element-wise sum of vectors of one size, none of which is null (see ``is_valid`` and ``zero``)."""
    return vector_to_array(Summarizer.sum(array_to_vector(as_double(v))))


def zero(v: Column) -> Column:
    """A vector of zeros as long as v."""
    return F.transform(v, lambda x: F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    """v / by, null for by = 0."""
    return F.transform(v, lambda x: F.try_divide(x, by))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column, guard: str = "eps") -> Column:
    n = norm(v)
    return scaled(v, F.when(n == 0, F.lit(EPS)).otherwise(n) if guard == "eps" else n)


def cosine_similarity(a: Column, b: Column, guard: str = "eps", clip: bool = True) -> Column:
    na, nb = norm(a), norm(b)
    if guard == "eps":
        na, nb = (F.when(x == 0, F.lit(EPS)).otherwise(x) for x in (na, nb))
    s = F.try_divide(dot(a, b), na * nb)
    return F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)) if clip else s


def cosine_distance(a: Column, b: Column, guard: str = "null", clip: bool = False) -> Column:
    return 1 - cosine_similarity(a, b, guard, clip)


def euclidean(a: Column, b: Column) -> Column:
    return norm(minus(a, b))
