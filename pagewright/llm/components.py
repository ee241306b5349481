"""Connected components of a graph that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import saved

#: Nodes of over so many edges are hubs, or with very many edges nodes of over a ``MAX_HUBS``-th of them; so few that they can be broadcast.
HUB, MAX_HUBS = 100, 50_000
#: Edges of a round are kept in files of about so many, in ``FILES`` at least.
ROWS_A_FILE, FILES = 100_000, 8


def _kept(edges: DataFrame, n: int) -> DataFrame:
    """``edges``, of which there are about ``n``, computed once and kept in few files: small graphs make no thousands of empty ones."""
    return saved(edges.coalesce(max(FILES, n // ROWS_A_FILE)))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hubs(edges: DataFrame, n: int) -> DataFrame | None:
    """Nodes with so many of the ``n`` edges that a task of its own would stand out; at most 2 * ``MAX_HUBS``, None if there are none."""
    found = saved(_both_ways(edges).groupBy("u").count().filter(F.col("count") > max(HUB, n // MAX_HUBS)).select("u").coalesce(1))
    return None if found.isEmpty() else found


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the least v of each u."""
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def _large_star(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours; edges of hubs stay where they are and get their least by broadcast."""
    both = _both_ways(edges)
    if hubs is None:
        least = _with_least(both)
    else:
        few = F.broadcast(hubs)
        of_hubs = both.join(few, "u", "left_semi")
        least = _with_least(both.join(few, "u", "left_anti")).unionByName(of_hubs.join(F.broadcast(of_hubs.groupBy("u").agg(F.min("v").alias("m"))), "u"))
    moved = least.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # a node with very many smaller neighbours has their least by now, mostly one and the same, very many times
    return moved if hubs is None else moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, moves to the least of them; each edge once."""
    pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
    return _with_least(edges).select(F.inline(F.array(pair("u"), pair("v")))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node it can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars.  A step is one window over a node's edges; those of nodes
    with very many are not brought together, so such a node costs no single
    task.  After a large-star step a node has few smaller neighbours left.
    Nothing but a count and a checksum of each round comes to the driver.  Loops
    and repeated edges are ignored, nulls too.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and u <> v").distinct()
    now, last = saved(now), None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == last or seen[0] == 0:
            break
        last = tuple(seen)
        now = _kept(_small_star(_large_star(now, _hubs(now, seen[0]))), seen[0])
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
