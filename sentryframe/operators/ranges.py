"""Values cut into ranges of about equal numbers, so that what must go in order can be done in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import unused


def with_slots(rows: DataFrame, by: tuple[str, ...], value: str, slots: int = 128) -> DataFrame:
    """Adds slot: the number of boundaries under the value, so larger values never have smaller slots and equal ones share theirs.

    The boundaries are quantiles of each group's values by a sketch that tasks build apart and merge; there is one row of
    them a group. However values crowd, a slot holds about its share of the rows (distinct values are best given once)."""
    bounds, *theirs = unused(rows, "bounds", *[f"of_{k}" for k in by])
    shares = [i / slots for i in range(1, slots)]
    cuts = rows.groupBy(*[F.col(k).alias(t) for k, t in zip(by, theirs)]).agg(F.percentile_approx(value, shares, 20 * slots).alias(bounds))
    on = [rows[k].eqNullSafe(cuts[t]) for k, t in zip(by, theirs)]
    met = rows.join(cuts, on) if on else rows.crossJoin(cuts)  # without groups a single row
    under = F.size(F.filter(F.coalesce(bounds, F.array()), lambda b: b < F.col(value)))
    return met.withColumn("slot", F.coalesce(under, F.lit(0))).drop(bounds, *theirs)
