"""Column helpers that behave alike on Spark and on the engine they are checked against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.when(col(b) != 0, col(a).cast("double") / col(b))


def fixed(c: Column | str, digits: int = 4) -> Column:
    """Rounded half up at ``digits`` in binary floating point, the same on other engines."""
    return F.round(col(c) * F.lit(float(10**digits))) / F.lit(float(10**digits))


def money(c: Column | str) -> Column:
    """The exact sum of an amount in cents, as double, whatever the order of rows."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def uniform(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) from the md5 of a key and a salt; the same on any engine."""
    digest = F.md5(F.concat(col(key).cast("string"), F.lit(f"|{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def count_if(condition: Column) -> Column:
    """Rows where a condition holds; null doesn't."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def household_factor(size: Column | str) -> Column:
    """How much faster a larger household uses things up: 1.45 - 0.125 x size; unknown counts as 1."""
    return F.coalesce(F.lit(1.45) - F.lit(0.125) * col(size), F.lit(1.0))


def mean_gap(first: Column | str, last: Column | str, n: Column | str) -> Column:
    """Mean days between n purchase days, by the first and the last alone; null under two."""
    return F.when(col(n) >= 2, F.datediff(col(last), col(first)).cast("double") / (col(n) - 1))


def expected_days(observed: Column | str, typical: Column | str, factor: Column | str, n: Column | str, min_obs: int = 2, floor: float = 2.0) -> Column:
    """The observed cycle if there are enough purchases, else the typical one; at least ``floor``."""
    own = F.when((col(n) >= min_obs) & col(observed).isNotNull(), col(observed)).otherwise(col(typical).cast("double") * col(factor))
    return F.greatest(own, F.lit(floor))


def need_weight(overdue: Column | str) -> Column:
    """Overdue ratio as a weight in [0, 1]; unknown is 0."""
    ratio = col(overdue)
    return F.when(ratio.isNull(), 0.0).when(ratio >= 1, 1.0).otherwise(ratio)


def category_need_score(n_days: Column | str, due: Column | str) -> Column:
    """How much a category is needed: the days it was bought on, doubled if it is due; unknown due is not due."""
    return col(n_days).cast("double") * (1 + F.coalesce(col(due).cast("double"), F.lit(0.0)))


def personal_score(n: Column | str, overdue: Column | str) -> Column:
    """n x (1 + due) + overdue, with unknowns as 0."""
    n, over = F.coalesce(col(n), F.lit(0)), F.coalesce(col(overdue), F.lit(0.0))
    return n * (1 + F.when(over >= 1, 1).otherwise(0)) + over
