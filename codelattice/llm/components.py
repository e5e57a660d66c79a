"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Each round rewrites the edge set twice.  Large-star hangs every larger neighbour of a
node on the smallest one it sees; small-star does the same with the smaller neighbours.
Both are one partial aggregate, one join and one distinct over (long, long) rows.  When a
whole round leaves the edge set as it was, it is a set of stars whose centres are the
components' minima.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from codelattice.plans.identify import number_ids
from codelattice.plans.materialize import Workspace
from codelattice.plans.skew import split_join

#: A node with more neighbours than max(HUB_FLOOR, edges / HUB_SHARE) gets its minimum by
#: broadcast instead of through the shuffle; at most 2 * HUB_SHARE nodes can have so many.
HUB_FLOOR, HUB_SHARE = 50_000, 2_000


def _with_minimum(pairs: DataFrame, n_edges: int) -> DataFrame:
    """(u, v) -> (u, v, m), m the least v of each u; the rows of hubs never travel."""
    minima = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    limit = max(HUB_FLOOR, n_edges // HUB_SHARE)
    if n_edges <= limit:  # no node can exceed it
        return pairs.join(minima.select("u", "m"), "u")
    hubs = F.broadcast(minima.where(F.col("deg") > limit).select("u", F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, "u", "left")
    light = marked.where(F.col("hub_m").isNull()).select("u", "v").join(minima.where(F.col("deg") <= limit).select("u", "m"), "u")
    return light.unionByName(marked.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m")))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = _with_minimum(both, 2 * n_edges).where(F.col("v") > F.col("u"))
    m = F.least("u", "m")
    return rows.select(F.col("v").alias("u"), m.alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    rows = _with_minimum(edges, n_edges)
    centre = rows.where(F.col("v") == F.col("m")).select("u", F.col("m").alias("v"))
    rest = rows.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return centre.unionByName(rest)


def _settle(work: Workspace, df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Write the distinct edges (u > v); count and checksum come with the same job."""
    seen = Observation()
    kept = df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    digest = F.xxhash64("u", "v").cast("decimal(20,0)")
    kept = kept.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(digest).alias("s"))
    out = work.write(kept, name)
    got = seen.get
    return out, (got["n"], got["s"])


def components(pairs: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Group id of each node that is an end of a pair with two different ends.

    Returns ``(node_id, group_id)``, one row a node; ``group_id`` is the smallest node id
    of all nodes linked to it directly or over others.

    Rows with a null end and pairs of a node with itself say nothing and are left out;
    repeated pairs and pairs in both directions count once; further columns are not read;
    an empty input gives an empty result.  Raises if ``max_rounds`` don't suffice.
    """
    work = Workspace(pairs.sparkSession, "components")
    ends = pairs.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b"))
    ends = ends.where((F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = work.write(ends, "pairs")
    n = ends.count()
    ids = number_ids(ends.select(F.col("a").alias("node_id")).unionByName(ends.select(F.col("b").alias("node_id"))), "node_id", work, "ids")
    left, right = ids.select(F.col("node_id").alias("a"), F.col("nr").alias("u")), ids.select(F.col("node_id").alias("b"), F.col("nr").alias("v"))
    # a hub's id may stand on a third of the pairs
    half = work.write(split_join(ends, left, "a", n, work).select("u", "b"), "half")
    edges, state = _settle(work, split_join(half, right, "b", n, work).select("u", "v"), "edges")
    work.drop(ends)
    work.drop(half)
    for _ in range(max_rounds):
        before = state
        large, (n, _s) = _settle(work, _large_star(edges, before[0]), "large")
        small, state = _settle(work, _small_star(large, n), "small")
        work.drop(edges)
        work.drop(large)
        edges = small
        if state == before:
            break
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    # edges are stars now: u hangs on its component's minimum v
    labelled = ids.join(edges.select(F.col("u").alias("nr"), F.col("v").alias("centre")), "nr", "left")
    labelled = labelled.select("node_id", F.coalesce("centre", "nr").alias("centre"))
    smallest = labelled.groupBy("centre").agg(F.min("node_id").alias("group_id"))
    # a component may hold a third of all nodes: its rows are spread by salting the join key
    return _spread_join(labelled, smallest).select("node_id", "group_id")


def _spread_join(labelled: DataFrame, smallest: DataFrame, salts: int = 16) -> DataFrame:
    salt = F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int")
    every = smallest.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return labelled.withColumn("salt", salt).join(every, ["centre", "salt"])
