"""Decontamination with benchmark items shorter than the window."""

from pagewright.llm import decontam


def test_documents_of_short_items_are_dropped(spark):
    items = ["what is the capital of france", "name three noble gases", "x y"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [items[0].title() + "?", f"{items[0]} and {items[1]} or {items[2]}", f"he asked {items[1]} before the lesson in the old school began", "nothing of it", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for words in (100_000, 5):
        assert {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, max_words=words).collect()} == {i: texts[i] for i in (2, 3, 4, 5)}
