"""Tables of few files dealt over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task reads about so many bytes of a file, Spark's own default; a table that fills all cores so is left as it lies.
SPLIT = 128 << 20


def evenly(stored: DataFrame) -> DataFrame:
    """A stored table, its rows dealt over all cores if it is one of few and small files.

    A file of one block of rows is read by one task, whatever the number of
    cores, and all that follows up to the first shuffle runs there.  Tables of
    as many files as there are cores, or of more bytes than these read at once,
    stay as they are and cost no shuffle.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    if len(stored.inputFiles()) >= cores:
        return stored
    files = stored.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    size = files.agg(F.sum("size")).first()[0] or 0
    return stored.repartition(cores) if 0 < size < cores * SPLIT else stored
