"""Packing by optimal length buckets.

Texts of a bucket are padded to its upper bound.  Dynamic programming over the
histogram of all lengths chooses the bounds that waste least:

    best[b][j] = min over i < j of best[b - 1][i] + sum of (length_j - length_t)
                 over the texts t with lengths from i + 1 to j

with prefix sums.  The sum is a Monge cost, so the best i never falls as j grows
and halving the range of j finds all in O(buckets * lengths * log lengths).  A
bucket's batches hold as many texts as fit the token budget at its bound, one at
least.

The histogram is one small aggregate, used whole.  Batches form within shards of a bucket, dealt by a hash of id and row, so
a bucket with most of the texts is many tasks; each shard leaves one batch that
may be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import saved

BUCKETS = 16
TOKENS = 16_384
SHARD = 4096


def n_tokens(text="text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least padding; ``lengths`` ascend."""
    n = len(lengths)
    if n == 0:
        return []
    length = lengths.astype(np.int64)
    c = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    s = np.r_[0, np.cumsum(counts.astype(np.int64) * length)]
    best = length * c[1:] - s[1:]  # one bucket
    back = []
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), np.full(n, -1, dtype=np.int64)
        at[0] = 0
        part = best - c[1:] * length[0] + s[1:]  # the cost of i is part[i] - c[i + 1] * (length[j] - length[0]), and terms of j alone
        ranges = [(1, n, 0, n - 1)]  # rows from, to, least and largest i
        while ranges:
            first, last, low, high = ranges.pop()
            if first >= last:
                continue
            j = (first + last) // 2
            upto = min(high + 1, j)
            k = low + int((part[low:upto] - c[low + 1 : upto + 1] * (length[j] - length[0])).argmin())
            cost = best[k] + length[j] * (c[j + 1] - c[k + 1]) - (s[j + 1] - s[k + 1])
            if cost < best[j]:
                new[j], at[j] = cost, k + 1
            ranges += [(first, j, low, k), (j + 1, last, k, high)]
        back.append(at)
        best = new
    bounds, j = [int(lengths[-1])], n - 1
    for at in reversed(back):
        if j > 0 and at[j] > 0:
            j = int(at[j]) - 1
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: list[int]) -> int:
    """Padding tokens of all texts under the given bounds."""
    upper = np.asarray(bounds)[np.searchsorted(bounds, lengths)]
    return int(((upper - lengths) * counts).sum())


def _histogram(table: DataFrame, grid: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts); of at most 2 * ``grid`` entries, rounded up, where a grid is asked for."""
    hist = table.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    if grid is not None:
        step = max(1, -(-(hist.agg(F.max("n_tokens")).first()[0] or 0) // grid))
        hist = hist.groupBy((F.ceil(F.col("n_tokens") / step) * step).cast("bigint").alias("n_tokens")).agg(F.sum("n").alias("n"))
    rows = sorted((r.n_tokens, r.n) for r in hist.collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS, tokens: int = TOKENS, grid: int | None = None, shard: int = SHARD) -> DataFrame:
    """(id_col, n_tokens, bucket, bucket_tokens, batch_id, batch_docs) for every row.

    ``bucket_tokens`` is the length that the row is padded to; a batch holds
    ``batch_docs`` rows, with batch_docs * bucket_tokens within the budget unless
    a single row is longer.  Nothing is cut.  Null, empty and wordless texts have
    0 tokens; repeated rows stay repeated; a null id is an id like any other;
    other columns are ignored; an empty table gives an empty result.
    """
    # the row's number tells repeated and null ids apart, so that they spread over shards as well
    table = saved(docs.select(F.col(id_col), n_tokens().alias("n_tokens"), F.monotonically_increasing_id().alias("__row")))
    lengths, counts = _histogram(table, grid)
    bounds = optimal_bounds(lengths, counts, buckets)
    per = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)).astype(int) if bounds else []
    # one row a bucket: bound, texts a batch, shards
    plan = F.array(*(F.struct(F.lit(int(b)).cast("bigint").alias("upper"), F.lit(int(max(1, tokens // max(1, b)))).cast("bigint").alias("size"), F.lit(int(max(1, -(-int(m) // shard)))).alias("shards")) for b, m in zip(bounds, per, strict=True))) if bounds else None
    if plan is None:
        plan = F.array(F.struct(F.lit(0).cast("bigint").alias("upper"), F.lit(1).cast("bigint").alias("size"), F.lit(1).alias("shards")))
    inside = F.filter(plan, lambda p: p["upper"] >= F.col("n_tokens"))
    placed = table.withColumn("__p", inside[0]).withColumn("bucket", (F.size(plan) - F.size(inside)).cast("int"))
    placed = placed.withColumn("__shard", F.pmod(F.xxhash64(F.col(id_col), "__row", F.lit(11)), F.col("__p.shards")).cast("int"))
    group = Window.partitionBy("bucket", "__shard")
    seq = F.floor((F.row_number().over(group.orderBy("n_tokens", id_col)) - 1) / F.col("__p.size")).cast("bigint")
    numbered = placed.withColumn("__seq", seq).withColumn("__all", F.count(F.lit(1)).over(group))
    full = F.least(F.col("__p.size"), F.col("__all") - F.col("__seq") * F.col("__p.size"))
    return numbered.select(F.col(id_col), "n_tokens", "bucket", F.col("__p.upper").alias("bucket_tokens"), F.concat_ws("-", "bucket", "__shard", "__seq").alias("batch_id"), full.cast("bigint").alias("batch_docs"))
