"""Column-level functions (scalar projections)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``.

    Catalyst inlines aliases when it pushes filters or collapses projections,
    so a sub-expression referenced k times is copied k times (and evaluated k
    times). A one-element ``transform`` binds it to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
