"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, floor(scale * x), ranged by length, longest
first, and cut into buckets of ``BUCKET`` neighbours in that order.  Each query
first scores the bucket of the longest vectors; its k-th best score there is a
lower bound theta.  A bucket whose longest vector has length l can hold a better
one only if theta <= |q| * l; the ratio theta / (|q| * l) is the cosine that its
vectors must reach.

* Low ratio: length pruning.  The bucket is sorted by length, so only its front,
  up to the last vector with |q| * |p| >= theta, is multiplied.
* High ratio: coordinate pruning.  For the focus coordinate f with the largest
  |q_f|, unit vectors with the needed cosine have their coordinate between two
  bounds; the rest of the bucket is not multiplied.

What is left is verified by integer products.  Queries go in blocks, and a task
takes one block of queries and one bucket; a bucket that no query of the block
needs is not sent.  Products are taken in 64-bit floats only while they are
exact (all sums under 2^53), else in 64-bit integers, else in Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import map_batches, saved

SCALE = 1024
BUCKET = 4096
QUERIES = 1024
#: The longest bucket of each dimension is broadcast for up to so many dimensions, the heads of query blocks up to so many blocks; beyond, keys are salted.
BROADCAST_DIMS, BROADCAST_HEADS, SALTS = 16, 100_000, 64
#: From this cosine on, coordinate pruning takes over from length pruning.
COSINE = 0.6
_BLOCK = "dim int, n int, most double, ids binary, lengths binary, data binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v, norm): integer vectors; null vectors and those with null or non-finite components are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).filter(whole).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).withColumn("norm", norm)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one dimension, in the order of the partition."""

    def blocks(ids, norms, flat, offsets):
        dims = np.diff(offsets)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            for at in range(0, len(own), size):
                k = own[at : at + size]
                data = flat[(offsets[k][:, None] + np.arange(dim)).ravel()] if dim else flat[:0]
                yield int(dim), len(k), float(norms[k].max(initial=0.0)), ids[k].tobytes(), norms[k].tobytes(), _narrow(data)

    def run(batches):
        held: list[tuple] = []
        have = 0

        def close():
            ids = np.concatenate([h[0] for h in held])
            norms = np.concatenate([h[1] for h in held])
            flat = np.concatenate([h[2] for h in held])
            lens = np.concatenate([h[3] for h in held])
            offsets = np.r_[0, np.cumsum(lens)]
            out = list(zip(*blocks(ids, norms, flat, offsets), strict=True))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["dim", "n", "most", "ids", "lengths", "data"])

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                col = part.column(2)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.value_lengths().to_numpy(zero_copy_only=False))))
                have += part.num_rows
                if have >= size:
                    yield close()
                    held, have = [], 0
        if held:
            yield close()

    return rows.select("id", "norm", "v").mapInArrow(run, _BLOCK)


def _narrow(data: np.ndarray) -> bytes:
    """The integers in the smallest of 2, 4 or 8 bytes each that holds them all."""
    for kind in (np.int16, np.int32):
        if not data.size or (data.min() >= np.iinfo(kind).min and data.max() <= np.iinfo(kind).max):
            return data.astype(kind).tobytes()
    return data.tobytes()


def _open(dim, n, ids, lengths, data):
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(1, n * dim), np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.float64), np.frombuffer(data, kind).reshape(n, dim).astype(np.int64)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products q @ p.T."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    bound = int(np.abs(q.astype(np.float64)).max()) * int(np.abs(p.astype(np.float64)).max()) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return q @ p.T
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def search(q_ids, q_norms, q, theta, p_ids, p_norms, p, k: int):
    """(query row, id, score) of up to k candidates per query that reach ``theta``, by the pruning that suits each query."""
    out = []
    top = p_norms.max(initial=0.0)
    order = np.argsort(-p_norms, kind="stable")
    p_ids, p_norms, p = p_ids[order], p_norms[order], p[order]
    unit = p / np.maximum(p_norms, 1e-300)[:, None]
    # theta is null (-inf) for a query that has seen fewer than k candidates
    reach = q_norms * top
    ratio = np.where(reach > 0, theta / np.maximum(reach, 1e-300), np.where(theta <= 0, -1.0, 2.0))
    able = ratio <= 1 + 1e-9
    by_length = np.flatnonzero(able & (ratio < COSINE))
    if len(by_length):
        # one product for all of them, over the longest front that any of them needs
        need = np.where(theta[by_length] > 0, theta[by_length] / np.maximum(q_norms[by_length], 1e-300), 0.0).min() * (1 - 1e-9)
        front = int(np.searchsorted(-p_norms, -need, side="right"))
        score = products(q[by_length], p[:front])
        for row, s in zip(by_length, score, strict=True):
            out.append(_best(row, s, p_ids[:front], q_ids[row], theta[row], k))
    for row in np.flatnonzero(able & (ratio >= COSINE)):
        u = q[row] / q_norms[row]
        f = int(np.abs(u).argmax())
        # unit vectors at cosine c or more to u have coordinate f within u_f * c -+ sqrt((1 - u_f^2)(1 - c^2))
        c = min(1.0, ratio[row])
        near, wide = u[f] * c, np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - c * c)))
        low = -1.0 if u[f] < -c else near - wide
        high = 1.0 if u[f] > c else near + wide
        keep = np.flatnonzero((unit[:, f] >= low - 1e-7) & (unit[:, f] <= high + 1e-7) & (p_norms * q_norms[row] >= theta[row] * (1 - 1e-9)))
        out.append(_best(row, products(q[row : row + 1], p[keep])[0], p_ids[keep], q_ids[row], theta[row], k))
    return out


def _best(row, score, ids, own, theta, k):
    keep = np.flatnonzero((ids != own) & (score >= theta))
    if len(keep) > k:
        cut = np.partition(score[keep], len(keep) - k)[len(keep) - k]
        keep = keep[score[keep] >= cut]
    keep = keep[np.lexsort((ids[keep], -score[keep]))][:k]
    return row, ids[keep], score[keep]


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, bucket: int = BUCKET, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer products, ties to the smaller id.

    ``is_query`` is a condition on the rows of ``vectors``.  Candidates are all
    rows with another id and the query's dimension; fewer than k give fewer
    rows.  Null vectors and vectors with null or non-finite components take no
    part; zero vectors do.  Products beyond 64 bits count as the largest or
    smallest 64-bit integer.  Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(vectors.filter(is_query), id_col, vector_col, scale)
    # ranges of the length, ties broken by id, so that equal vectors spread over tasks
    candidates = saved(_packed(rows.repartitionByRange(F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id")), bucket).withColumn("bucket", F.monotonically_increasing_id()))
    blocks = saved(_packed(asked.repartitionByRange(F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id")), queries).withColumn("block", F.monotonically_increasing_id()))
    first = candidates.groupBy("dim").agg(F.max_by("bucket", "most").alias("bucket"))
    longest = candidates.join(first, ["dim", "bucket"], "left_semi").select("dim", F.col("n").alias("pn"), F.col("ids").alias("pids"), F.col("lengths").alias("plengths"), F.col("data").alias("pdata"))

    def bounds(batch: pa.RecordBatch) -> pa.RecordBatch:
        thetas, needs = [], []
        for r in batch.to_pylist():
            q_ids, q_norms, q = _open(r["dim"], r["n"], r["ids"], r["lengths"], r["data"])
            p_ids, _, p = _open(r["dim"], r["pn"], r["pids"], r["plengths"], r["pdata"])
            score = products(q, p)
            theta = np.full(len(q), -np.inf)
            for i, s in enumerate(score):
                s = s[p_ids != q_ids[i]]
                if len(s) >= k:
                    theta[i] = np.partition(s, len(s) - k)[len(s) - k]
            thetas.append(theta.tobytes())
            # the shortest length that any of the block's queries still needs
            need = np.where(theta > 0, theta / np.maximum(q_norms, 1e-300), 0.0)
            needs.append(float(need.min(initial=0.0) if (theta <= 0).any() else need.min()) * (1 - 1e-9))
        keep = [batch.column(i) for i in range(6)]
        return pa.RecordBatch.from_arrays([*keep, pa.array(thetas, pa.binary()), pa.array(needs, pa.float64())], names=["block", "dim", "n", "ids", "lengths", "data", "theta", "need"])

    # one bucket a dimension, and mostly one dimension: broadcast, or in SALTS copies, so that no task gets all query blocks
    few = first.limit(BROADCAST_DIMS + 1).count() <= BROADCAST_DIMS
    salt = F.pmod("block", F.lit(1 if few else SALTS)).cast("int")
    copies = F.broadcast(longest.withColumn("salt", F.lit(0))) if few else longest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked_blocks = saved(map_batches(blocks.select("block", "dim", "n", "ids", "lengths", "data", salt.alias("salt")).join(copies, ["dim", "salt"]).select("block", "dim", "n", "ids", "lengths", "data", "pn", "pids", "plengths", "pdata"), bounds, "block bigint, dim int, n int, ids binary, lengths binary, data binary, theta binary, need double"))
    # which bucket meets which block, by the small columns alone
    heads = asked_blocks.select("block", "dim", "need")
    if heads.count() <= BROADCAST_HEADS:
        meet = candidates.select("bucket", "dim", "most").join(F.broadcast(heads), "dim")
    else:
        spread = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        meet = candidates.select("bucket", "dim", "most", F.pmod("bucket", F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["dim", "salt"])
    meet = meet.filter("most >= need").select("bucket", "block")
    pairs = meet.join(asked_blocks, "block").join(candidates.select("bucket", F.col("n").alias("pn"), F.col("ids").alias("pids"), F.col("lengths").alias("plengths"), F.col("data").alias("pdata")), "bucket")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        who, ids, scores = [], [], []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            q_ids, q_norms, q = _open(r["dim"], r["n"], r["ids"], r["lengths"], r["data"])
            theta = np.frombuffer(r["theta"], np.float64)
            for row, best, score in search(q_ids, q_norms, q, theta, *_open(r["dim"], r["pn"], r["pids"], r["plengths"], r["pdata"]), k):
                who.append(np.full(len(best), q_ids[row]))
                ids.append(best)
                scores.append(score)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(who), cat(ids), cat(scores)], names=["query_id", "vec_id", "score"])

    found = map_batches(pairs.select("dim", "n", "ids", "lengths", "data", "theta", "pn", "pids", "plengths", "pdata"), verify, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB SQL, over the view ``embeddings``.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
