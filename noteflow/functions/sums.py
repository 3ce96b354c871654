"""Sums that do not depend on the order in which rows meet."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_avg(name: str) -> Column:
    """Average of a double column, the same however rows are dealt over tasks.

    Doubles add up a last place higher or lower by their order, which decides about a group whose average
    is a limit itself; decimals add up exactly.  Values that no decimal holds leave the plain average.
    """
    exact = F.col(name).try_cast("decimal(38,18)")
    total = F.try_sum(exact).cast("double") / F.count(name)
    return F.when(F.count(exact) == F.count(name), F.coalesce(total, F.avg(name))).otherwise(F.avg(name))
