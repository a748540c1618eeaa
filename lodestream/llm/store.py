"""Lineage cuts by the library's store, and names for columns. Rows go to Python in batches that Spark bounds by bytes, so large rows need no setting."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestream.sources.store import discard
from lodestream.sources.store import shared_path
from lodestream.sources.store import shared_root as shared_dir
from lodestream.sources.store import written as stored

__all__ = ["discard", "fresh", "shared_dir", "stored", "stored_by"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns that no column of ``df`` has, by Spark's reckoning without case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``stored``, with a folder for each value of ``column``, so that reads of one value touch nothing else."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
