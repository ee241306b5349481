"""The registered corpus queries: SQL twins, and the pipeline on small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_exact_top_k", "op8_url_filter"])
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = contract.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    want = db.sql(contract.oracle_sql()[name]).df()
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0.8 * before < docs.count() <= before
    assert docs.select("doc_id").distinct().count() == docs.count()


def test_pipeline_runs_whole_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 150
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
