"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a, b) -> Column:
    squares = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a) -> Column:
    """Length one; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(_c(a), lambda x: x.cast("double") / norm(a))).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def rounded(x, digits: int) -> Column:
    """Rounded, with what is left of a small negative number keeping its sign, as in SQL."""
    x = _c(x)
    out = F.round(x, digits)
    return F.when((out == 0) & x.cast("string").startswith("-"), F.lit(-0.0)).otherwise(out)


def unit_similarity(distance) -> Column:
    """Cosine of unit vectors from their distance."""
    return 1 - _c(distance) * _c(distance) / 2


def mean_pooled(rows, mask) -> Column:
    """Mean of the vectors whose mask is set; zero where none is."""
    rows, mask = _c(rows), _c(mask)
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda s: s["m"] > 0), lambda s: s["v"])
    total = F.aggregate(kept, F.transform(rows[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def backoff_ms(attempt) -> Column:
    return F.least(F.lit(400.0), 50 * F.pow(F.lit(2.0), _c(attempt) - 1)).cast("long")
