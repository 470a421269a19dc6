"""Reading the documents table and adding computed columns to whole rows."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import words as W


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def append(docs: DataFrame, compute: Callable[[pa.RecordBatch, int], dict], fields: str, text: str = "text") -> DataFrame:
    """``docs`` as columns ``c0, c1, ...`` followed by the ``fields`` that ``compute(batch, text_index)`` returns.

    Positional names keep clear of columns of the caller that are named like ours; ``restore`` brings names back.
    """
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            if batch.num_rows:
                new = compute(batch, at)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(new[n]) if not isinstance(new[n], pa.Array) else new[n] for n in names)], names=[*batch.schema.names, *names])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added.fields]))


def restore(names: list[str], frame: DataFrame, replaced: dict | None = None) -> DataFrame:
    """The columns ``c0, c1, ...`` under their own names again, some of them replaced by other columns."""
    replaced = replaced or {}
    return frame.select(*[replaced.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
