"""Positions in a global order, without sorting anything in one task.

Rows are dealt to ranges of the order, sorted there and stored; a row's position is the count of all
rows before its range plus its place in it. Only the counts, a row for each range and group, are
brought together. A group of any size is spread over as many ranges as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sizing import AUTO, lookup_join, stored

PLACE, RANGE, RUN = "__place", "__range", "__run"


def with_positions(
    rows: DataFrame, order: list[Column | str], group: list[str] = [], name: str = "position", strategy: str = AUTO
) -> DataFrame:
    """``rows`` with ``name``: their place (from 0) in ``order`` inside their group (null is a group).

    Ties beyond ``order`` get positions in any order, but lasting ones: the dealt rows are stored.
    """
    columns = [*group, *order]
    dealt = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = stored(dealt.withColumn(PLACE, F.monotonically_increasing_id()))
    # a null and an empty group are told apart; an ungrouped order is one group
    run = F.to_json(F.struct(*group)) if group else F.lit("")
    placed = placed.withColumns({RANGE: F.shiftright(PLACE, 33), RUN: run})
    runs = placed.groupBy(RUN, RANGE).agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(RUN).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(RUN, RANGE, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    shifted = lookup_join(placed, starts, [RUN, RANGE], strategy=strategy, salts=1)
    return shifted.withColumn(name, F.col(PLACE) + F.col("__shift")).drop(PLACE, RANGE, RUN, "__shift")
