"""Queries on tables made for one case each."""

import math

import duckdb
import numpy as np

from pagewright.plans import catalog


def test_charts_multiply_as_the_twin_does(spark, tmp_path):
    """Products of single precision that only round up to a whole number there."""
    near = [v for v in (np.float32(i / 1000) for i in range(1, 1000)) if math.floor(np.float32(v * np.float32(1000))) != math.floor(float(v) * 1000)]
    assert near
    rows = [(i, [float(near[(i + j) % len(near)]) for j in range(5)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["chart_projection"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(f"select doc_id, shape, series_idx, point_idx, label, x, y from ({catalog.ORACLE_SQL['chart_projection']})").fetchall()
    assert got == sorted(want) and got


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_uses_of_references_are_dealt_out_by_number(spark):
    from pagewright.operators import documents

    items = spark.createDataFrame([(1, "#/texts/0", "text", "#/body")], "doc_id bigint, ref string, kind string, parent_ref string")
    edges = spark.createDataFrame([(1, "#/body", "#/texts/0")], "doc_id bigint, parent_ref string, child_ref string")
    out = documents.integrity_errors(items, edges)
    assert "RepartitionByExpression [doc_id" in plan(out) and out.collect() == []


def test_office_items_are_made_once_and_by_many_tasks(spark):
    from pagewright.operators import office

    rows = [(1, 1, "sheet", '{"index":1,"visible":false}'), (1, 2, "sheet_chart", '{"sheet_index":1}'), (1, 3, "sheet", '{"index":1,"visible":true}'), (1, 4, "sheet_chart", '{"sheet_index":1}'), (1, 5, "sheet_chart", '{"sheet_index":2}')]
    items = office.office_items(spark.createDataFrame(rows, "doc_id bigint, seq bigint, kind string, payload string"), ("sheet", "sheet_chart"))
    assert plan(items).count("LogicalRDD") == 1 and "RepartitionByExpression [doc_id" in plan(items)
    got = {r.seq: (r.parent_ref, r.layer) for r in items.filter("arena = 'pictures'").collect()}
    assert got == {2: ("#/groups/0", "INVISIBLE"), 4: ("#/groups/1", "BODY"), 5: ("#/body", "BODY")}


def test_grid_keeps_the_last_cell_of_a_place(spark):
    from pagewright.operators import office

    cells = '[{"row":0,"column":1,"text":"a"},{"row":0,"column":1,"text":"b"},{"row":2,"column":0,"text":"out"},{"row":0,"column":2,"text":"out"},{"row":1,"column":0}]'
    events = spark.createDataFrame([(1, 1, "table", f'{{"rows":2,"columns":2,"cells":{cells}}}'), (1, 2, "table", '{"rows":1,"columns":1}'), (1, 3, "table", '{"rows":5000,"columns":1}')], "doc_id bigint, seq bigint, kind string, payload string")
    grid = office.table_grid(office.office_items(events, ("table",)))
    assert plan(grid).count("LogicalRDD") == 1
    assert sorted(tuple(r) for r in grid.collect()) == [(1, "#/tables/0", 0, 0, ""), (1, "#/tables/0", 0, 1, "b"), (1, "#/tables/0", 1, 0, ""), (1, "#/tables/0", 1, 1, ""), (1, "#/tables/1", 0, 0, "")]


def test_grids_of_long_tables_are_whole(spark):
    """Tables over 4,096 positions: cells at both ends and at the cuts of runs, two of one place, none at all."""
    from pyspark.sql import functions as F

    from pagewright.operators import office

    places = [(0, 0), (0, 1), (2, 96), (2, 97), (2, 97), (3, 1), (4, 1999), (5, 0), (0, 2000)]
    cells = ",".join(f'{{"row":{r},"column":{c},"text":"t{i}"}}' for i, (r, c) in enumerate(places))
    tables_ = [(1, 5, 2000, cells), (2, 5000, 1, ""), (3, 1, 1, '{"row":0,"column":0,"text":"x"}'), (4, 0, 7, ""), (5, 2, 2048, ",".join(f'{{"row":{i // 2048},"column":{i % 2048},"text":"{i}"}}' for i in range(4096)))]
    events = spark.createDataFrame([(1, n, "table", f'{{"rows":{r},"columns":{c},"cells":[{x}]}}') for n, r, c, x in tables_], "doc_id bigint, seq bigint, kind string, payload string")
    grid = office.table_grid(office.office_items(events, ("table",)), limit=None)
    assert plan(grid).count("LogicalRDD") == 1
    told = {("#/tables/0", *at): f"t{i}" for i, at in enumerate(places) if at[0] < 5 and at[1] < 2000} | {("#/tables/2", 0, 0): "x"} | {("#/tables/4", i // 2048, i % 2048): str(i) for i in range(4096)}
    want = {(f"#/tables/{n - 1}", r, c): told.get((f"#/tables/{n - 1}", r, c), "") for n, rows, cols, _ in tables_ for r in range(rows) for c in range(cols)}
    got = grid.collect()
    assert len(got) == len(want) and {(r.ref, r.row, r.col): r.text for r in got} == want
    of_query = catalog.QUERIES["event_table_grid"](spark, "/root/testdata/sf0.001").filter("doc_id = 0").groupBy("ref").agg(F.count("*").alias("n"))
    assert {r.ref: r.n for r in of_query.collect()} == {f"#/tables/{i}": 10_000 if i == 19 else 4 for i in range(20)}


def test_positions_of_a_grid_are_made_by_many_tasks(spark):
    from pagewright.operators import office

    events = spark.createDataFrame([(1, 1, "table", '{"rows":1000,"columns":100}')], "doc_id bigint, seq bigint, kind string, payload string")
    made = office.table_grid(office.office_items(events, ("table",)), limit=None).rdd.glom().map(len).collect()
    assert sum(made) == 100_000 and sum(n > 0 for n in made) > 1


def test_token_streams_of_a_short_file_go_to_many_tasks(spark):
    from pagewright.operators import tables

    rows = [(i, ["<tr>", "<td></td>", "<td></td>"], [(1, 2, 3, 4)] if i % 2 else []) for i in range(64)]
    out = tables.token_cells(spark.createDataFrame(rows, "id bigint, tokens array<string>, boxes array<struct<left:int,top:int,right:int,bottom:int>>").coalesce(1), ["id"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted((r.id, r.col, r.bottom) for r in out.collect()) == sorted((i, c, 4 if i % 2 and c == 0 else 0) for i in range(64) for c in (0, 1))


def test_pdf_lines_leave_a_worker_in_bounded_batches(spark):
    from pagewright.sources import pdf

    docs = spark.createDataFrame([(i, b"x") for i in range(3)], "doc_id bigint, content binary")
    rows = pdf.pdf_rows(docs)
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    assert "MapInArrow" in plan(rows) and limit.isdigit() and int(limit) <= 8 << 20
    assert sorted(r.doc_id for r in rows.filter("error is not null").collect()) == [0, 1, 2]


def test_counting_needs_no_reading_order(spark, monkeypatch):
    from pagewright.operators import layout

    def dear(_):
        raise AssertionError("the reading order was computed")

    monkeypatch.setattr(layout, "reading_order", dear)
    assert {r.metric for r in catalog.QUERIES["parse_counters"](spark, "/root/testdata/sf0.001").select("metric").collect()} >= {"documents_rejected_total", "pages_digital_total"}
