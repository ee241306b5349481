"""Sequential work on small groups, without a pandas frame for each of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Arrow batches hold about this many bytes, however large the files or texts in them are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ``BATCH_BYTES``: without it, a batch has ten thousand rows of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # set in other units, or larger
        spark.conf.set(key, f"{BATCH_BYTES}b")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys into the session's number of shuffle partitions, which are not merged again however small they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan_groups(df: DataFrame, keys: list[str], order: list[str], schema: StructType, f: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """Runs ``f`` on the rows of each group, as tuples in the given order, and collects the tuples it makes.

    One shuffle brings a group into one partition, one sort makes it a run of
    rows; a group that crosses the end of a batch is carried into the next.
    """
    columns, width = df.columns, len(keys)
    at = [columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[tuple] = []
        key = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = tuple(row[i] for i in at)
                if k != key:
                    if held:
                        out.extend(f(held))
                    held, key = [], k
                held.append(row)
            yield made(out)
        if held:
            yield made(list(f(held)))

    assert width
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
