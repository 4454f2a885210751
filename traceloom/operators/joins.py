"""Joins with tables that are small in practice, checked before they are broadcast."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row is sent to all executors: some 10 MB.
SMALL = 100_000


def small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """table, broadcast if it has at most so many rows; beyond that the join shuffles, and skewed keys are split at run time."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
