"""Stored tables: scans, snapshots and upserts (I-07, I-15, I-17)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from paperloom import schema


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """I-17: a table scan; a filter put on it reaches the Parquet row groups.

    With ``name`` the columns come from the declared schema, so that files written before a column was
    added still read (the column is NULL there).
    """
    reader = spark.read
    if name is not None:
        reader = reader.schema(schema.TABLES[name])
    return reader.parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; written as a new snapshot."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], doomed: Column, parent_key: str, child_key: str):
    """I-15: what is left of the parent and of every child table after deleting the parents that match."""
    ids = parent.filter(doomed).select(parent.select(parent_key)[parent_key].alias(child_key))
    left = {name: child.join(ids, child_key, "left_anti") for name, child in children.items()}
    return parent.filter(~doomed | doomed.isNull()), left


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A new snapshot folder; a reader switches to it once it is complete."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
