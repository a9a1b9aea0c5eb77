"""Reasoning over activated nodes: chains, causal paths, contradictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT
from hyperspark.plans.runtime import cut, ship

#: Graphs of at most so many usable edges (48 MB) are sent to every worker, so that costs need no shuffle; larger ones are joined.
SENT_EDGES = 2_000_000
#: Costs of so many edges times sources are held at once, and rows given out in a batch.
HELD_COSTS, BATCH_ROWS = 2_000_000, 50_000


def chains(active: DataFrame, edges: DataFrame, pair_resonance: DataFrame, limit: int = DEFAULT.max_chains) -> DataFrame:
    """``(q, a, b, mid, relation, strength, chain)``: up to ``limit`` chains of each query.

    ``active (q, node, place, activation)`` are the chain ends (at most 16 a query), ``edges (src, dst, weight, type)`` pair edges,
    ``pair_resonance (a, b, res)`` the resonance of ends. A direct edge counts ``.5 res + .5 w``; without one, ends above
    .35 count ``.6 res`` and go over the active node with the largest product of weights, or "resonates with" each other.
    Chains below .15 are dropped; the order is that of the ends.
    """
    a = active.select("q", F.col("node").alias("a"), F.col("place").alias("pa"), F.col("activation").alias("act"))
    b = active.select("q", F.col("node").alias("b"), F.col("place").alias("pb"))
    pairs = a.join(b, "q").where("pa < pb").join(pair_resonance, ["a", "b"], "left").na.fill({"res": 0.0})
    direct = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"), "type")
    pairs = pairs.join(direct, ["a", "b"], "left")
    strength = F.when(F.col("w").isNotNull(), 0.5 * F.col("res") + 0.5 * F.col("w")).when(F.col("act") >= 0.35, 0.6 * F.col("res"))
    pairs = cut(pairs.withColumn("strength", strength).where("strength >= 0.15"))
    open_pairs = pairs.where("w is null").select("q", "a", "b")
    first = edges.select(F.col("src").alias("a"), F.col("dst").alias("mid"), F.col("weight").alias("w1"))
    second = edges.select(F.col("src").alias("mid"), F.col("dst").alias("b"), F.col("weight").alias("w2"))
    middles = active.select("q", F.col("node").alias("mid"))
    bridges = open_pairs.join(first, "a").join(second, ["mid", "b"]).join(middles, ["q", "mid"]).groupBy("q", "a", "b").agg(F.max_by("mid", F.struct(F.round(F.col("w1") * F.col("w2"), 9), -F.col("mid"))).alias("mid"))
    named = pairs.join(bridges, ["q", "a", "b"], "left").withColumn("relation", F.when(F.col("w").isNotNull(), F.col("type")).when(F.col("mid").isNotNull(), "bridge").otherwise("resonates with"))
    ranked = named.withColumn("chain", F.row_number().over(Window.partitionBy("q").orderBy("pa", "pb")))
    return ranked.where(F.col("chain") <= limit).select("q", "chain", "a", "mid", "b", "relation", F.round("strength", 6).alias("strength"))


def contradictions(active: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """``(q, a, b, confidence)``: active ends of contradicting edges, mean activation times weight, at most ``limit`` a query."""
    opposed = edges.where(F.regexp_replace("type", "^EDGE_", "").isin("CONTRADICTS", "ANTONYM"))
    a = active.where("activation >= 0.25").select("q", F.col("node").alias("src"), F.col("activation").alias("act_a"), F.col("place").alias("pa"))
    b = active.where("activation > 0.25").select("q", F.col("node").alias("dst"), F.col("activation").alias("act_b"))
    found = a.join(opposed, "src").join(b, ["q", "dst"])
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("pa", "adj_idx")))
    return ranked.where(F.col("n") <= limit).select("q", F.col("src").alias("a"), F.col("dst").alias("b"), F.round((F.col("act_a") + F.col("act_b")) / 2 * F.col("weight"), 6).alias("confidence"))


def causal_cost(weight, kind):
    """Cost of an edge: ``(1 − w)`` times .5 for causal, 2 for inhibitory edges; contradicting ones can't be used."""
    name = F.regexp_replace(kind, "^EDGE_", "")
    factor = F.when(name.isin("CAUSAL", "CAUSES"), 0.5).when(name == "INHIBITORY", 2.0).otherwise(1.0)
    return F.when(name == "CONTRADICTS", None).otherwise((1 - weight) * factor)


def causal_paths(sources: DataFrame, edges: DataFrame, max_len: int = DEFAULT.max_chain_len) -> DataFrame:
    """``(source, node, cost, strength, hops, path)``: cheapest paths from each source, of at most ``max_len`` nodes, and their nodes in order.

    ``sources (source)``, ``edges (src, dst, weight, type)``. Each round relaxes all frontier edges at once and keeps the
    cheapest way per (source, node); it ends when nothing improves.
    """
    usable = cut(edges.select("src", "dst", causal_cost(F.col("weight"), F.col("type")).alias("c"), "weight").where("c is not null"))
    best = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("strength"), F.lit(0).alias("hops"), F.array(F.col("source").cast("long")).alias("path")))
    frontier = best
    for hop in range(1, max_len):
        steps = frontier.withColumnRenamed("node", "src").join(usable, "src").select("source", F.col("dst").alias("node"), F.round(F.col("cost") + F.col("c"), 12).alias("cost"), (F.col("strength") * F.col("weight")).alias("strength"), F.lit(hop).alias("hops"), F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"))
        cheapest = steps.groupBy("source", "node").agg(F.min_by(F.struct("cost", "strength", "hops", "path"), F.struct("cost", -F.col("strength"), "path")).alias("s")).select("source", "node", "s.*")
        known = best.select("source", "node", F.col("cost").alias("known"))
        frontier = cut(cheapest.join(known, ["source", "node"], "left").where("known is null or cost < known").drop("known"))
        if frontier.isEmpty():
            break
        best = cut(best.join(frontier.select("source", "node"), ["source", "node"], "left_anti").unionByName(frontier))
    return best


def causal_costs(sources: DataFrame, edges: DataFrame, max_len: int = DEFAULT.max_chain_len) -> DataFrame:
    """``(source, node, cost)``: the costs of :func:`causal_paths`, without the paths.

    Each source's costs are relaxed over the whole graph in one task, some sources at a time, so nothing of the pairs of sources
    and nodes is shuffled or kept on disk. Each round is the same as there: all edges at once, costs rounded to 12 digits.
    """
    spark = sources.sparkSession
    usable = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), causal_cost(F.col("weight"), F.col("type")).cast("double").alias("c")).where("c is not null and src is not null and dst is not null"))
    # Spark orders NaN above all numbers, numpy below none; such costs go the long way.
    if usable.count() > SENT_EDGES or not usable.where("isnan(c) or abs(c) = double('infinity')").isEmpty():
        return causal_paths(sources, edges, max_len).select("source", "node", "cost")
    ship(spark)
    found = usable.toArrow()
    src, dst, c = (found[x].to_numpy() for x in ("src", "dst", "c"))
    ids = np.unique(np.concatenate([src, dst]))
    order = np.argsort(dst, kind="stable")
    ends, first = np.unique(dst[order], return_index=True)
    graph = spark.sparkContext.broadcast((ids, np.searchsorted(ids, src[order]).astype(np.int32), np.searchsorted(ids, ends), first, c[order]))

    def relaxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, src, ends, first, c = graph.value
        width = max(1, HELD_COSTS // max(len(src), 1))
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, wanted)
            there = np.append(ids, 0)[at] == wanted if len(ids) else np.zeros(len(wanted), bool)
            there &= at < len(ids)
            if not there.all():
                alone = pa.array(wanted[~there])
                yield pa.RecordBatch.from_arrays([alone, alone, pa.array(np.zeros(len(alone)))], ["source", "node", "cost"])
            wanted, at = wanted[there], at[there]
            for start in range(0, len(wanted), width):
                block = at[start : start + width]
                costs = np.full((len(ids), len(block)), np.inf)
                costs[block, np.arange(len(block))] = 0.0
                for _ in range(1, max_len):
                    # Rounding keeps order, so the least of the rounded costs is the least one rounded.
                    new = np.round(np.minimum.reduceat(costs[src] + c[:, None], first, axis=0), 12)
                    better = new < costs[ends]
                    if not better.any():
                        break
                    costs[ends] = np.where(better, new, costs[ends])
                for j, source in enumerate(wanted[start : start + width]):
                    reached = np.flatnonzero(costs[:, j] < np.inf)
                    for i in range(0, len(reached), BATCH_ROWS):
                        some = reached[i : i + BATCH_ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), source)), pa.array(ids[some]), pa.array(costs[some, j])], ["source", "node", "cost"])

    # Few sources lie in few tasks, whatever their size in bytes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return sources.select(F.col("source").cast("long").alias("source")).where("source is not null").repartition(parts, F.xxhash64("source")).mapInArrow(relaxed, "source bigint, node bigint, cost double")
