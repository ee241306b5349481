"""Each stage of the pipeline on awkward rows: nulls in any column, empty and long texts, repeats, clashing extra columns, no rows."""

import random

import pytest

import corpus_pipeline

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = [c.split()[0] for c in KIND.split(", ")]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma kappa".split()) + rng.choice("abcdef") for _ in range(n))
    item = text(30)
    rows = [(i, text(60), "en", "s", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (None, text(40), "en", None, None), (None, None, None, None, None), (101, "", "en", "s", 0), (102, "12 34", "en", "s", 5), (103, text(60_000), None, "s", 1)]
    rows += [rows[0], rows[0], (104, rows[1][1], "en", "t", 1), (105, item, "en", "s", 1), (106, f"{text(80)} {item} mail a.b@example.com", "en", "s", 1), (106, text(50), "en", "s", 1)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as row", "2 as h", "3 as name", "4 as hits", "5 as starts", "6 as n_tokens", "7 as bucket")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, at, rows, item


def run(spark, inputs, name, docs=None):
    stage = dict(corpus_pipeline.STAGES)[name]
    return stage(spark, inputs[0] if docs is None else docs, inputs[1])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, inputs, name):
    out = run(spark, inputs, name, inputs[0].limit(0))
    assert out.collect() == [] and (name == "packing" or out.columns == COLUMNS)


def test_language(spark, inputs):
    out = run(spark, inputs, "language")
    rows = [tuple(r) for r in out.collect()]
    gone = {100, 101, 102}
    want = [r for r in inputs[2] if r[1] is not None and r[0] not in gone]
    assert out.columns == COLUMNS and sorted((r[0] or -1, r[1]) for r in rows) == sorted((r[0] or -1, r[1]) for r in want)
    assert {r[2] for r in rows} == {"en"}


def test_near_duplicates(spark, inputs):
    out = run(spark, inputs, "near_duplicates")
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == COLUMNS and len(rows) == len(set(rows)) == 60 + 7
    ids = [r[0] for r in rows]
    assert 104 not in ids and ids.count(0) == 1 and ids.count(106) == 2 and ids.count(None) == 1 and 100 in ids and 101 not in ids


def test_decontamination(spark, inputs):
    rows = {(r.doc_id, r.n_chars): r.text for r in run(spark, inputs, "decontamination").filter("doc_id in (100, 101, 105, 106)").collect()}
    assert (100, None) in rows and rows[(101, 0)] == "" and not any(k[0] == 105 for k in rows)
    changed = [(k, t) for k, t in rows.items() if k[0] == 106 and "mail" in (t or "")]
    assert len(changed) == 1 and inputs[3] not in changed[0][1] and changed[0][0][1] == len(changed[0][1])


def test_personal_data(spark, inputs):
    out = run(spark, inputs, "personal_data")
    rows = out.collect()
    assert out.columns == COLUMNS and len(rows) == len(inputs[2])
    assert [r.text[-7:] for r in rows if r.doc_id == 106 and "mail" in r.text] == ["<EMAIL>"]
    assert sum(r.text is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1


def test_packing(spark, inputs):
    rows = run(spark, inputs, "packing").collect()
    assert len(rows) == len(inputs[2]) and max(r.n_tokens for r in rows) == 60_000
    assert all(r.n_tokens <= r.bucket_tokens for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.batch_id, []).append(r.batch_docs)
    assert all(set(v) == {len(v)} for v in by.values())
