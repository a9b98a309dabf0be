"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x, lo, hi) -> Column:
    """Limit to [lo, hi]; a NULL input stays NULL."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def bound(x, lo, hi) -> Column:
    """Limit a value that is never NULL to [lo, hi]; uses its argument once."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def clip01(x) -> Column:
    """Limit a value that is never NULL to [0, 1]."""
    return bound(x, 0.0, 1.0)


def nz(x, default=0.0) -> Column:
    """NULL to a default."""
    return F.coalesce(_c(x), F.lit(default))


def ratio(num, den, empty=0.0) -> Column:
    """num / den, or `empty` when den is zero or missing."""
    num, den = _c(num), _c(den)
    return F.when(den != 0, num / den).otherwise(F.lit(empty))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that sums in any order compare equal."""
    return df.select(
        *[round_off_tie(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def round_off_tie(x: Column, digits: int = 6) -> Column:
    """Round half up, moved a hair off exact decimal ties, whose last bit depends on the order of a sum."""
    return F.round(x + 1e-9, digits) if digits == 6 else F.round(x, digits)


def std_from_parts(parts) -> Column:
    """Population deviation of the union of disjoint parts, the same in whatever order they arrive.

    `parts` is an array of struct(n, mean, m2) whose length is bounded by the number of time
    bins, never by the number of rows. Fewer than two values give 0.
    """
    parts = F.array_sort(_c(parts))
    n = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["n"] * x["mean"]) / n
    m2 = F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("m2"), mean.alias("mu")),
        lambda a, x: F.struct(
            (a["m2"] + x["m2"] + x["n"] * (x["mean"] - a["mu"]) * (x["mean"] - a["mu"])).alias("m2"),
            a["mu"].alias("mu"),
        ),
    )["m2"]
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), m2 / n))).otherwise(F.lit(0.0))


UNIT = 1_000_000_000


def units(amount) -> Column:
    """An amount as a whole number of its smallest unit, so that sums do not depend on their order."""
    return F.round(_c(amount) * UNIT).cast("long")


def amount(total) -> Column:
    """The amount of a sum of `units`."""
    return _c(total).cast("double") / UNIT


def std_of_units(n, s1, s2) -> Column:
    """Population deviation, as an amount, from exact count, sum and sum of squares of `units`.

    With s1 = a * n + r, the squared deviations are s2 - a * s1 - a * r (whole numbers) less r * r / n."""
    n, s1, s2 = _c(n), _c(s1).cast("decimal(19,0)"), _c(s2)
    a = F.floor(s1 / F.greatest(n, F.lit(1)).cast("decimal(10,0)")).cast("decimal(13,0)")
    r = (s1 - a * n.cast("decimal(10,0)")).cast("decimal(19,0)")
    whole = (s2 - a * s1 - a * r).cast("double") - r.cast("double") * r.cast("double") / n
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), whole) / n) / UNIT).otherwise(F.lit(0.0))


def std_from_integer_sums(n, s1, s2) -> Column:
    """Population deviation of integers from exact count, sum and sum of squares."""
    n, s1, s2 = _c(n), _c(s1), _c(s2)
    spread = n.cast("decimal(15,0)") * s2.cast("decimal(22,0)") - s1.cast("decimal(18,0)") * s1.cast("decimal(18,0)")
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), spread.cast("double"))) / n).otherwise(F.lit(0.0))
