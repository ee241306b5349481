"""Packing bounds beyond 4,096 different lengths."""

import numpy as np

from pagewright.llm import packing


def test_many_lengths_and_one_long_text_are_packed_exactly(spark):
    kinds = 4200
    rows = spark.range(kinds + 1).selectExpr("id as doc_id", f"case when id = {kinds} then repeat('w ', 1000000) else repeat('w ', cast(id + 1 as int)) end as text")
    got = packing.pack(rows, buckets=3).collect()
    lengths = np.array([*range(1, kinds + 1), 1000000])
    # the long text is alone, the others are halved
    best = packing.padding(lengths, np.ones(len(lengths), dtype=int), [kinds // 2, kinds, 1000000])
    assert len(got) == kinds + 1 and sum(r.bucket_tokens - r.n_tokens for r in got) == best


def test_bounds_agree_with_the_plain_programme():
    rng = np.random.default_rng(4)
    for n, buckets in ((300, 16), (250, 5), (40, 40)):
        lengths = np.sort(rng.choice(5000, n, replace=False))
        counts = rng.integers(1, 1000, n)
        bounds = packing.optimal_bounds(lengths, counts, buckets)
        c, s = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
        best = lengths * c[1:] - s[1:]
        for _ in range(1, buckets):
            best = np.array([min(best[j], *(best[:j] + lengths[j] * (c[j + 1] - c[1 : j + 1]) - (s[j + 1] - s[1 : j + 1]))) if j else 0 for j in range(n)])
        assert len(bounds) <= buckets and packing.padding(lengths, counts, bounds) == best[-1]
