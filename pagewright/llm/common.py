"""Helpers shared by the corpus operators.

Texts travel as UTF-8 bytes: every delimiter class used here holds ASCII code
points only, so byte work and code-point work agree, and byte offsets become
code-point offsets only where a result needs them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; 0-9, a-z and every byte from 0x80 stay; the rest is a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``; on a single machine where it is unset (tests), a local one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagewright-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Arrow batches hold about this many bytes, however long the texts are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ``BATCH_BYTES``: a worker holds one batch and what it makes of it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # set in other units, or larger
        spark.conf.set(key, f"{BATCH_BYTES}b")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, setup: Callable | None = None) -> DataFrame:
    """Runs ``f`` on every Arrow batch; ``setup()`` is called once a task and its value passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            if b.num_rows:
                yield f(b, state) if setup else f(b)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
