"""Near copies against a brute-force join on whole shingle sets."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import near


def similarity(a, b):
    x, y = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def classes(texts):
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * similarity(texts[i], texts[j]) >= 4 - 1e-9 and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("bounds", [{}, {"chunk_rows": 5}, {"compare": 8, "recall": 0.999}, {"compare": 8, "recall": 0.999, "bucket_rows": 5}])
def test_near_copies_are_those_of_brute_force(spark, bounds):
    rng = random.Random(7)
    texts = []
    for _ in range(8):
        base = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 20, 60, 150, 400])))
        texts += [base, *(edited(rng, base, n) for n in (1, 1, 2, 3, 5, 8, 12, 20)), base + " and a tail", base.upper()]
    notice = " ".join(f"n{i}" for i in range(40))
    texts += [notice + " " + " ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(12)] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    lower = [t.lower() for t in texts]
    got = {r.doc_id: r.component_id for r in near.near_copies(docs, **bounds).collect()}
    assert [got[i] for i in range(len(texts))] == classes(lower)


def test_recall_of_pairs_at_the_bound():
    """Pairs of similarity just over 0.8, alone: found by radius and tables as often as the parameters say."""
    rng, found, n = np.random.default_rng(3), 0, 400
    bits, tables = near.tables_for(1_000_000)
    spread = random.Random(1)
    masks = [np.array([spread.sample(range(near.BITS), bits) for _ in range(tables)])]
    for _ in range(n):
        base = rng.integers(0, 2**63, 360, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(base[:320]), np.unique(np.r_[base[:285], base[320:355]])
        assert near.linked(a, b)
        x, y = (np.unpackbits(near.set_fingerprint(s).view(np.uint8)) for s in (a, b))
        same = x == y
        found += (~same).sum() <= near.RADIUS and same[masks[0]].all(axis=1).any()
    assert found >= 0.96 * n


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)) for n in (3, 16, 17, 20, 300)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64)]) for s in sets]
    sketches = near.Sketches(sets)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))]
    a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
    apart = sketches.apart(a, b)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(apart, a, b, strict=True))


def test_keep_one_and_its_cases(spark):
    kind = "doc_id bigint, text string, lang string, __row int"
    rows = [(7, "a b c", "x", 1), (7, "a b c", "x", 1), (7, "quite another text", "y", 2), (None, "A b  c", "z", 3), (None, "no id at all", "z", 4), (None, "no id at all", "z", 4), (9, None, None, None), (8, "", "u", 5), (3, " ", "u", 6)]
    docs = spark.createDataFrame(rows, kind).withColumnRenamed("__row", "row")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "no id at all"), (3, " "), (7, "a b c"), (7, "quite another text")]
    got = [(r.doc_id, r.component_id) for r in near.near_copies(docs).collect()]
    assert len(got) == len(rows) and sorted(c for d, c in got if d == 9) == [3] and sorted(c or -1 for d, c in got if d is None) == [-1, -1, 7]
    assert near.near_copies(docs.limit(0)).collect() == [] and near.keep_one(docs.limit(0)).collect() == []


def test_stage_keeps_one_of_near_copies_and_all_others(spark):
    rng = random.Random(11)
    texts = []
    for n in (120, 200, 400):
        base = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        texts += [base, *(edited(rng, base, k) for k in range(1, 14))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(classes(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []
