"""Stacks of rasters named by columns, in files: one folder for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of cells that lie in one file of a raster.
STRIP_ROWS = 1024


def write_stack(cells: DataFrame, path: str, names: list[str]) -> None:
    """Cells (names, row_ix, col_ix and values) in a folder for each raster, cut into strips of rows.

    Rasters that are there already and come again are replaced; others stay.
    """
    strips = cells.repartition(*names, F.floor(F.col("row_ix") / STRIP_ROWS))
    strips.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


def read_stack(spark: SparkSession, path: str, **wanted: list) -> DataFrame:
    """The cells of the rasters with the wanted values of their names; other folders are not read."""
    cells = spark.read.parquet(path)
    for name, values in wanted.items():
        cells = cells.filter(F.col(name).isin(list(values)))
    return cells
