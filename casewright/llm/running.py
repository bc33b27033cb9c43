"""Running totals over long ordered lists without putting a list into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a level: a window never holds more than 16 ** DIGITS rows.
DIGITS = 2


def levels_for(rows: int, per_cell: int) -> int:
    """Levels at which cells of evenly dealt rows hold about ``per_cell`` rows at most."""
    return max(1, math.ceil(math.log(max(1, rows / per_cell), 16**DIGITS)))


def totals_before(cells: DataFrame, owner: str, cell: str, amount: str, levels: int) -> DataFrame:
    """``owner, cell, before``: for each cell the sum of ``amount`` over the owner's cells that sort before it.

    ``cells`` has one row for each owner and cell; cells are hexadecimal strings of ``DIGITS * levels`` digits. Sums
    are taken among the children of one prefix, level by level, so a hot owner is spread over all prefixes.
    """
    done = None
    for level in range(1, levels + 1):
        prefix = F.substring(cell, 1, DIGITS * level)
        sums = cells.groupBy(owner, prefix.alias("_prefix")).agg(F.sum(amount).alias("_sum"))
        parent = F.substring("_prefix", 1, DIGITS * (level - 1))
        among = Window.partitionBy(owner, parent).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        here = sums.select(
            owner, "_prefix", parent.alias("_parent"), F.coalesce(F.sum("_sum").over(among), F.lit(0)).alias("_before")
        )
        if done is None:
            done = here.select(owner, "_prefix", F.col("_before").alias("before"))
        else:
            above = done.select(owner, F.col("_prefix").alias("_parent"), "before")
            done = here.join(above, [owner, "_parent"]).select(
                owner, "_prefix", (F.col("_before") + F.col("before")).alias("before")
            )
    return done.withColumnRenamed("_prefix", cell)


def hex_cell(number: Column, levels: int) -> Column:
    """A whole number as a cell that sorts as the number does."""
    return F.lpad(F.lower(F.hex(number.cast("long"))), DIGITS * levels, "0")
