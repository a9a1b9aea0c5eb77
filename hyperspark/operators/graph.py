"""Nodes, pair edges and hyperedges as tables, and their changes.

Changes follow snapshot semantics: a pass computes from the state before it and then applies its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT
from hyperspark.functions import vector as V


#: Labels of a bucket when new nodes are numbered.
BUCKET_LABELS = 100_000


def valid_nodes(nodes: DataFrame, dim: int = DEFAULT.embed_dim) -> DataFrame:
    """Nodes whose ``vec`` can be used, with the unit vector ``v``; others are left out."""
    fine = (F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return nodes.where(F.col("id").isNotNull() & fine).withColumn("v", V.normalise(F.col("vec")))


def add_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes (id, label)`` and one new node per distinct new label of ``labels``; ids go on after the largest.

    Labels are numbered bucket by bucket, in order within a bucket, without one global sort.
    """
    fresh = labels.select("label").where("trim(label) <> ''").distinct().join(nodes.select("label"), "label", "left_anti")
    start = nodes.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    # A bucket holds about BUCKET_LABELS labels by hash, so neither a bucket's window nor the running count over buckets grows out of hand.
    buckets = max(1, -(-fresh.count() // BUCKET_LABELS))
    placed = fresh.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("label"))).join(before, "bucket")
    made = numbered.select((start + F.col("before") + F.col("i")).alias("id"), "label")
    return nodes.select("id", "label").union(made)


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per direction and pair: the last weight and type, the first place in the list.

    Self edges and edges to unknown nodes are refused; weights are clamped to [.001, 1], null weights refused.
    """
    known = nodes.select("id").distinct()
    rows = edges.where("src <> dst and weight is not null")
    rows = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = rows.groupBy("src", "dst").agg(F.min("adj_idx").alias("adj_idx"), F.max_by(F.struct("weight", "type", "last_fired"), F.struct("adj_idx", "weight", "type")).alias("last"))
    return last.select("src", "dst", "adj_idx", V.clamp(F.col("last.weight"), 0.001, 1.0).alias("weight"), F.col("last.type").alias("type"), F.col("last.last_fired").alias("last_fired"))


def hyperedges(members: DataFrame, edge: str, member: str, weight: Column, causal: Column, limit: int = DEFAULT.max_edge_nodes) -> DataFrame:
    """``(edge_id, members, weight, causal_strength, is_causal)`` from long rows: distinct members in order, at least 2, the first ``limit``.

    Only the smallest ``limit`` members of an edge are ever held.
    """
    distinct = members.groupBy(edge, member).agg(F.sum(weight).alias("w"), F.count(weight).alias("n"), F.max(causal).alias("causal"))
    ranked = distinct.withColumn("pos", F.row_number().over(Window.partitionBy(edge).orderBy(member)))
    sums = distinct.groupBy(edge).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.max("causal").alias("is_causal"), F.count(F.lit(1)).alias("size"))
    kept = ranked.where(F.col("pos") <= limit).groupBy(edge).agg(F.sort_array(F.collect_list(member)).alias("members"))
    weight_of = V.clamp(F.col("w") / F.col("n"))
    return kept.join(sums, edge).where("size >= 2").select(F.col(edge).alias("edge_id"), "members", weight_of.alias("weight"), weight_of.alias("causal_strength"), F.coalesce("is_causal", F.lit(False)).alias("is_causal"))


def node_entropy(usage: Column, idle: Column, importance: Column, time: float) -> Column:
    """``.5 usage/(t+1) + .3 e^(−.06 idle) + .2 importance``."""
    return 0.5 * usage / (time + 1) + 0.3 * F.exp(-0.06 * idle) + 0.2 * importance


def prune_pass(nodes: DataFrame, edges: DataFrame, time: float) -> DataFrame:
    """``(id, entropy, action, into)``: what a prune pass does to each node: ``keep``, ``drop`` or ``merge``.

    Fast-ring nodes are kept. Automatic nodes used less than .5 and idle for more than 10 are dropped. Others below .08
    with less than 3 uses merge into their most resonant live neighbour above .40. ``edges`` hold ``src, dst, res``.
    """
    idle = F.lit(time) - F.coalesce("last_active", F.lit(0.0))
    entropy = node_entropy(F.coalesce("usage_count", F.lit(0.0)), idle, F.coalesce("importance", F.lit(0.0)), time)
    scored = nodes.select("id", entropy.alias("entropy"), F.coalesce("in_fast_ring", F.lit(False)).alias("fast"), (F.coalesce("auto_created", F.lit(False)) & (F.coalesce("usage_count", F.lit(0.0)) < 0.5) & (idle > 10)).alias("idle_auto"), F.coalesce("usage_count", F.lit(0.0)).alias("usage"))
    best = edges.where("res > 0.40").groupBy(F.col("src").alias("id")).agg(F.max_by("dst", F.struct("res", -F.col("dst"))).alias("into"))
    action = F.when(F.col("fast"), "keep").when(F.col("idle_auto"), "drop").when((F.col("entropy") < DEFAULT.prune_threshold) & (F.col("usage") < 3) & F.col("into").isNotNull(), "merge").otherwise("keep")
    return scored.join(best, "id", "left").select("id", "entropy", action.alias("action"), F.when(action == "merge", F.col("into")).alias("into"))


def fast_ring(nodes: DataFrame, cap: int = DEFAULT.fast_ring_cap) -> DataFrame:
    """The ``cap`` nodes with the largest ``.5 entropy + .5 importance`` (a top-k; ties by id)."""
    score = 0.5 * F.coalesce("entropy_score", F.lit(0.0)) + 0.5 * F.coalesce("importance", F.lit(0.0))
    return nodes.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(cap)


def emergency_prune(nodes: DataFrame) -> DataFrame:
    """Nodes that stay under memory pressure: those not (entropy < .15 and usage < 1)."""
    return nodes.where(~((F.coalesce("entropy_score", F.lit(0.0)) < 0.15) & (F.coalesce("usage_count", F.lit(0.0)) < 1.0)))


def with_resonance(edges: DataFrame, nodes: DataFrame, now: Column | None = None) -> DataFrame:
    """``edges`` of usable nodes with ``res``, the resonance of their ends (to 9 places), and the decayed weight if ``now`` is given."""
    ends = valid_nodes(nodes).select("id", "v", "hash", "lang")
    a = ends.select(F.col("id").alias("src"), F.col("v").alias("va"), F.col("hash").alias("ha"), F.col("lang").alias("la"))
    b = ends.select(F.col("id").alias("dst"), F.col("v").alias("vb"), F.col("hash").alias("hb"), F.col("lang").alias("lb"))
    out = edges.join(a, "src").join(b, "dst").withColumn("res", F.round(V.resonance(F.col("va"), F.col("vb"), F.col("ha"), F.col("hb"), F.col("la"), F.col("lb")), 9))
    out = out.drop("va", "vb", "ha", "hb", "la", "lb")
    return out if now is None else out.withColumn("decayed", V.temporal_weight(F.col("weight"), F.col("last_fired"), now))
