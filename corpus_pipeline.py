"""The corpus pipeline: from raw documents to packed batches.

``STAGES`` are run in order.  Each takes (spark, docs, sf_dir), works on all that
the one before kept, and returns a DataFrame, which is written as Parquet and
read again for the next.  All but the last return the columns of ``documents``.

1. language: drops documents without text or letters and those in no learned
   language; fills null languages.
2. near_duplicates: keeps one document, the least id, of every class of texts
   linked by a Jaccard similarity of 0.8 or more of their five-word shingles;
   bit-sliced SimHash finds the links, the shingle sets verify them.
3. decontamination: cuts passages of the benchmark out of the texts; drops
   documents that are benchmark text for more than half.
4. personal_data: masks personal data and secrets in the texts.
5. packing: length bucket and batch of every document that is left.

An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontam, langid, near, packing, pii
from pagewright.llm.common import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate stage: shingle length in words.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.  Null, empty and letterless texts go; repeated rows stay; without labelled rows all texts with letters stay."""
    return langid.keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class.  Null, empty and wordless texts are one class; of rows with equal id and text one stays; a row with an id goes before one without."""
    return near.keep_one(docs.select(*COLUMNS), words=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark.  Null and empty texts and repeated rows stay as they are."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked.  Null and empty texts and repeated rows stay as they are."""
    return pii.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every row.  Null and empty texts have no tokens; repeated rows and null ids are rows like any other."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No stage's rows can be had from SQL: filters learned from the texts, XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's files go when the next has read them.

    Packing counts its input's tokens before it returns and reads it no more.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if last:
            _delete(spark, last)
        docs, last = spark.read.parquet(out), out
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _delete(spark, folder)
    return packed


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
