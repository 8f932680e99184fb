"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import settled

c = F.col
ROWS_PER_FILE = 500_000


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(c("v").alias("u"), c("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        _to_least(both.where("v > u"), least)
        .select(c("v").alias("u"), F.least("m", "u").alias("v"))
        .where("u <> v").distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Needs u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = _to_least(edges, least)
    return (
        linked.select(c("v").alias("u"), c("m").alias("v"))
        .union(least.select("u", c("m").alias("v")))
        .where("u <> v").distinct()
    )


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(c("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    n, most, mixed = nodes.agg(F.sum("low"), F.max("low"), F.max(F.when(c("low") > 0, c("high")).otherwise(0))).first()
    return n or 0, (most or 0) <= 1 and not mixed


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that ``edges`` name; component is the least node reachable.

    Edges are undirected; self-links and repeated links do nothing; an empty table gives no rows.
    Node columns must be of one orderable type and not null. Each round writes the edges to the
    shared folder, so lineage stays short; only three numbers per round reach the driver, which collects its garbage. Each star
    is an aggregation with map-side combine plus a join that Spark can split at hot nodes. What an earlier
    call gave may stand for its edges: stars need no round.
    """
    x, y = c(a), c(b)
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
    now = settled(now, "edges")
    for _ in range(rounds):
        # rounds only shorten the table, so its size bounds the files of the next round
        n, stars = _state(now)
        if stars:
            break
        now = settled(_small(_large(now)).coalesce(1 + n // ROWS_PER_FILE), "edges")
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(c("u").alias("node"), c("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
