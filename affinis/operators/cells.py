"""Triangle of cells: each unordered pair of rows meets in exactly one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, BOTH = 0, 1, 2


def cell_array(group: Column, groups: int | Column) -> Column:
    """The cells (i, j, side) of a row: (d, d) as both, (i, d) for i < d as left, (d, j) for j > d as right."""
    make = lambda i, j, side: F.struct(i.cast("int").alias("cell_i"), j.cast("int").alias("cell_j"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), (F.lit(groups) if isinstance(groups, int) else groups) - 1)
    return F.transform(every, lambda o: F.when(o == group, make(group, group, BOTH)).when(o < group, make(o, group, LEFT)).otherwise(make(group, o, RIGHT)))


def triangle_cells(df: DataFrame, groups: int, id_col: str = "id") -> DataFrame:
    """df once for each cell of its rows, with cell_i, cell_j and side; rows are spread over groups by a hash of the id."""
    group = F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")
    rest = [c for c in df.columns]
    return df.withColumn("cell", F.explode(cell_array(group, groups))).select(*rest, "cell.cell_i", "cell.cell_j", "cell.side")
