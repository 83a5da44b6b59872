"""Shared pieces of the operators: written intermediates, Arrow maps, columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.session import checkpoint_dir, delete_path, ship_package, track
from auditframe.sources.tables import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["Scratch", "arrow_map", "ascii_lower", "documents", "plain_names", "table"]


class Scratch:
    """Parquet tables of one operator call under the shared checkpoint folder.

    A written table is computed once, survives the loss of any executor and
    ends the lineage. ``drop`` removes a table as soon as nothing reads it any
    more; the rest goes with ``release`` once the call's result is written, or
    with the ``lineage_scope`` it was made in."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
        self._n = 0
        track(self.base)

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        self._n += 1
        path = f"{self.base}/t{self._n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t.scratch_path)

    def release(self) -> None:
        delete_path(self.spark, self.base)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batch-wise ``mapInArrow``: ``fn`` sees one non-empty record batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name that an operator uses itself
    can be among them. ``out.toDF(*df.columns)`` gives the names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table, all rows."""
    return table(spark, sf_dir, "documents")
