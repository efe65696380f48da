"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    return written(df, name)


#: Up to so many rows of ids, a join sends them to the tasks that read the texts.
MOST_SENT_IDS = 1_000_000


def sent_if_few(ids: DataFrame, most: int) -> DataFrame:
    """ids, a written table, for a join with texts: sent to the tasks that read these, so that no text is shuffled, if they are few enough."""
    return F.broadcast(ids) if ids.count() <= most else ids


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_trained_on(doc_id):
    """True for rows a model may learn from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0
