"""Connected components of a graph given as a frame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each link (u, v) with ``m``, the smallest neighbour of u.

    The join is on the complement of u: a key on which neither side is already
    placed, so both are shuffled for the join and a hub's links can be split by
    the adaptive skew join.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")
    return edges.join(least, F.bitwise_not(edges["u"]) == least["k"]).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node reachable from it.

    ``links`` has two bigint columns, in any order and with repeats. Rounds of
    large-star and small-star (Kiveris et al., 2014) until nothing changes; each
    round is checkpointed, and only its row count and hash reach the driver.
    Nulls and self-links are ignored; no links give no rows.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = durable(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        small = _with_minimum(large).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u > v").distinct()
        edges, before = durable(small), state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def smallest_ids(folded: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id): for every row of ``folded`` (node, first_id) the
    smallest ``first_id`` of its component; null when all of them are null."""
    labels = durable(connected_components(links)).select(F.col("node").alias("linked"), "root")
    named = folded.join(labels, folded["node"] == labels["linked"]).select("node", "first_id", "root")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.bitwise_not("root").alias("k"), "component_id")
    in_groups = named.join(least, F.bitwise_not("root") == F.col("k")).select("node", "component_id")
    alone = folded.join(labels, folded["node"] == labels["linked"], "left_anti").select("node", F.col("first_id").alias("component_id"))
    return in_groups.unionByName(alone)
