"""A mergeable quantile sketch of non-negative integers, kept as a table of counts per cell.

A cell holds the values that agree in their bit length and their ``BITS``
leading bits, so its edges are within 1/64 of each other, and cells below 128
hold one value. Two sketches merge by adding counts; the result depends neither
on the order of the rows nor on their partitions, and repeats exactly. A sketch
has at most ``64 * 2**BITS`` cells, whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 6


def cell(value: Column) -> Column:
    """Least value of the cell of ``value``; negative values count as 0."""
    v = F.greatest(value.cast("long"), F.lit(0).cast("long"))
    drop = F.greatest(F.length(F.bin(v)) - (BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def cell_top(low: Column) -> Column:
    """Greatest value of the cell whose least value is ``low``."""
    drop = F.greatest(F.length(F.bin(low)) - (BITS + 1), F.lit(0))
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1
