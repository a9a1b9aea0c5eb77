"""Spreading activation: a breadth-first search per seed, one join per level for all seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT, EngineConfig
from hyperspark.functions import vector as V
from hyperspark.plans.runtime import cut, hot_keys, skew_join


def spread(seeds: DataFrame, edges: DataFrame, hops: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """``(q, seed, node, depth, rank, spike)`` of every node reached.

    ``seeds`` hold ``(q, seed, spike)``, ``edges`` hold ``(src, dst, adj_idx, weight, type, res)``. A node is claimed by
    the first parent in queue order, then by place in the parent's list, exactly as in a first-in-first-out queue; rows
    below the spike floor keep their rank but don't spread. A hub's edges are spread over as many tasks as they need.
    """
    hops = config.max_hops if hops is None else hops
    level = cut(seeds.select("q", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank"), F.col("spike").cast("double").alias("spike")))
    levels, visited = [level], level.select("q", "seed", "node")
    hubs = hot_keys(edges, "src")
    for depth in range(1, hops + 1):
        passed = config.spike_decay * F.col("spike") * (0.45 * F.col("res") + 0.45 * F.col("weight") + 0.10)
        passed = F.when(F.col("type").isin("EDGE_INHIBITORY", "INHIBITORY"), F.abs(-0.3 * passed)).otherwise(passed)
        reached = (
            skew_join(edges, level.where(F.col("spike") >= config.spike_floor).withColumnRenamed("node", "src"), "src", salt_by="dst", hot=hubs)
            .select("q", "seed", F.col("dst").alias("node"), F.struct("rank", "adj_idx").alias("order"), passed.alias("passed")).where(F.col("passed") >= config.enqueue_floor)
            .join(visited, ["q", "seed", "node"], "left_anti")
            .groupBy("q", "seed", "node").agg(F.min("order").alias("order"), F.min_by("passed", "order").alias("passed"))
        )
        rank = F.row_number().over(Window.partitionBy("q", "seed").orderBy("order.rank", "order.adj_idx"))
        level = cut(reached.select("q", "seed", "node", F.lit(depth).alias("depth"), rank.cast("long").alias("rank"), F.round("passed", 12).alias("spike")))
        if level.isEmpty():
            break
        levels.append(level)
        visited = visited.union(level.select("q", "seed", "node"))
    return reduce(DataFrame.union, levels)


def activations(spread_rows: DataFrame, bonus: DataFrame | None = None, pagerank: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """``(q, node, activation, hits)``: the saturating sum of what reaches a node.

    ``bonus (q, node, salience)`` multiplies a spike by ``10 · salience`` for nodes in working memory; ``pagerank (node, pr)`` adds
    ``.1 · pr`` per event.
    """
    rows = spread_rows.where(F.col("spike") >= config.spike_floor)
    factor, extra = F.lit(1.0), F.lit(0.0)
    if bonus is not None:
        rows = rows.join(bonus.select("q", "node", "salience"), ["q", "node"], "left")
        factor = F.coalesce(10 * F.col("salience"), F.lit(1.0))
    if pagerank is not None:
        rows = rows.join(pagerank.select("node", "pr"), "node", "left")
        extra = 0.1 * F.coalesce("pr", F.lit(0.0))
    return rows.groupBy("q", "node").agg(V.clamp(F.sum(F.col("spike") * factor + extra)).alias("activation"), F.count(F.lit(1)).alias("hits"))


def first_concepts(activated: DataFrame, limit: int, faithful: bool = True) -> DataFrame:
    """The reported concepts of each query: of ``(q, arrival, node, activation)`` the first ``limit`` arrivals sorted by activation
    (``faithful``), or the ``limit`` most active."""
    order = [F.asc("arrival")] if faithful else [F.desc("activation"), F.asc("node")]
    kept = activated.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= limit)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("activation"), "arrival"))).drop("n")
