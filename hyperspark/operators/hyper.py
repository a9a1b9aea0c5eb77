"""Hyperedges: evaluation, attention and message passing as joins with partitioned softmax.

``members (edge_id, pos, node)`` is the long form of hyperedges; ``active (node, activation)`` the activated nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT, EngineConfig
from hyperspark.functions import vector as V
from hyperspark.plans.runtime import ship


def evaluate(edges: DataFrame, members: DataFrame, active: DataFrame, fire: float = 0.2) -> DataFrame:
    """``(edge_id, activation, fires)``: causal edges with all members above .08 take the least activation times their strength, others the mean times the weight."""
    joined = members.join(active, "node", "left").na.fill({"activation": 0.0})
    by = joined.groupBy("edge_id").agg(F.min("activation").alias("least"), F.avg("activation").alias("mean"), F.count_if(F.col("activation") <= 0.08).alias("quiet"))
    value = F.when(F.col("is_causal"), F.when(F.col("quiet") == 0, F.col("least") * F.col("causal_strength")).otherwise(0.0)).otherwise(F.col("mean") * F.col("weight"))
    return by.join(edges, "edge_id").select("edge_id", value.alias("activation"), (value > fire).alias("fires"))


def _added(keys: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Sums of the rows of each key."""
    coded = keys.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
    return coded.dictionary.take(pa.array(place[order][first])), np.add.reduceat(table[order], first, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _vectors(keys: pa.Array, table: np.ndarray, names: list[str]) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], names)


def vector_sums(rows: DataFrame, key: str, vector: str, weight: str, name: str) -> DataFrame:
    """``(key, name)``: weighted sums of vectors of one length; added up in each batch, then one vector a key and batch is shuffled.

    Rows with a null key, vector or weight are left out.
    """
    names = [key, name]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _vectors(*_added(batch.column(0), _matrix(batch.column(1)) * batch.column(2).to_numpy()[:, None]), names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of keys; the last key of a batch may go on in the next.
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, table = _added(batch.column(0), _matrix(batch.column(1)))
            if held is not None:
                keys, table = _added(pa.concat_arrays([held[0], keys]), np.concatenate([held[1], table]))
            held = keys[-1:], table[-1:]
            if len(keys) > 1:
                yield _vectors(keys[:-1], table[:-1], names)
        if held is not None:
            yield _vectors(*held, names)

    few = rows.select(key, V.doubles(F.col(vector)).alias(name), F.col(weight).cast("double").alias("__w")).where(F.col(key).isNotNull() & F.col(name).isNotNull() & F.col("__w").isNotNull())
    schema = few.drop("__w").schema
    return few.mapInArrow(partial, schema).repartition(key).sortWithinPartitions(key).mapInArrow(total, schema)


def attention(edges: DataFrame, members: DataFrame, active: DataFrame, vectors: DataFrame, adjacency: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``(edge_id, node, attention, activation, entropy, fires)``.

    The centroid of an edge is the unit sum of activation · vector over members from .05 on; a member's score is
    ``activation · clamp(v · centroid) · (1 + .3 w) / T`` with ``w`` the weight of its first neighbour that is also a member;
    scores go through a softmax within the edge. The edge's activation is the clamped attention-weighted mean times its
    weight. ``vectors (node, v)``; ``adjacency (src, dst, adj_idx, weight)``.
    """
    rows = members.join(active, "node").join(vectors, "node").where("activation >= 0.05")
    centre = vector_sums(rows, "edge_id", "v", "activation", "sum").withColumn("centre", V.normalise(F.col("sum"))).drop("sum")
    others = members.select("edge_id", F.col("node").alias("dst"))
    first = members.join(adjacency.withColumnRenamed("src", "node"), "node").join(others, ["edge_id", "dst"]).groupBy("edge_id", "node").agg(F.min_by("weight", F.struct("adj_idx", "dst")).alias("w"))
    scored = rows.join(centre, "edge_id").join(first, ["edge_id", "node"], "left")
    score = F.col("activation") * V.clamp(V.dot(F.col("v"), F.col("centre"))) * (1 + 0.3 * F.coalesce("w", F.lit(0.0))) / config.attention_temperature
    scored = scored.select("edge_id", "node", "activation", F.round(score, 9).alias("score"))
    # An edge has few members, so its softmax is a window over them; one shuffle serves all four sums.
    of_edge = Window.partitionBy("edge_id")
    raised = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(of_edge)))
    shares = raised.withColumn("attention", F.col("e") / F.sum("e").over(of_edge))
    share_entropy = F.when(F.col("attention") > 1e-6, -F.col("attention") * F.log2("attention")).otherwise(0.0)
    summed = shares.withColumn("mean", F.sum(F.col("attention") * F.col("activation")).over(of_edge)).withColumn("entropy", F.sum(share_entropy).over(of_edge))
    fired = summed.join(edges.select("edge_id", "weight"), "edge_id").withColumn("edge_activation", V.clamp(F.col("mean") * F.col("weight")))
    return fired.select("edge_id", "node", F.round("attention", 6).alias("attention"), F.round("edge_activation", 6).alias("activation"), F.round("entropy", 6).alias("entropy"), (F.col("edge_activation") > config.attention_fire).alias("fires"))


def message_pass(fired: DataFrame, members: DataFrame, active: DataFrame, vectors: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``(node, v)``: vectors after one round of messages.

    Each fired edge sends the softmax-weighted sum of its active members' vectors (softmax of the product with their mean);
    a node adds the messages of the fired edges it is in, weighted by their clamped activations, and blends the unit sum in by
    ``message_blend``, once for each time it was activated (``hits``). Nodes without a message keep their vector.
    """
    rows = members.join(fired.select("edge_id", "activation").withColumnRenamed("activation", "edge_activation"), "edge_id").join(active, "node").join(vectors, "node")
    mean = vector_sums(rows.withColumn("one", F.lit(1.0)), "edge_id", "v", "one", "total")
    sizes = rows.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    scored = rows.join(mean.join(sizes, "edge_id").select("edge_id", V.scale(F.col("total"), 1 / F.col("n")).alias("mean")), "edge_id").withColumn("score", F.round(V.dot(F.col("v"), F.col("mean")), 9))
    top = scored.groupBy("edge_id").agg(F.max("score").alias("top"))
    raised = scored.join(top, "edge_id").withColumn("e", F.exp(F.col("score") - F.col("top")))
    share = raised.join(raised.groupBy("edge_id").agg(F.sum("e").alias("total_e")), "edge_id").withColumn("share", F.col("e") / F.col("total_e"))
    messages = vector_sums(share.select("edge_id", "v", "share"), "edge_id", "v", "share", "message")
    inbox = rows.select("edge_id", "node", V.clamp(F.col("edge_activation")).alias("w")).join(messages, "edge_id")
    received = vector_sums(inbox, "node", "message", "w", "inbox").withColumn("inbox", V.normalise(F.col("inbox")))
    hits = active.select("node", F.col("hits") if "hits" in active.columns else F.lit(1).alias("hits"))
    joined = vectors.join(received, "node").join(hits, "node")
    alpha = config.message_blend
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("hits").cast("int"), F.lit(1))), V.doubles(F.col("v")), lambda v, _: V.blend(v, F.col("inbox"), alpha))
    changed = joined.select("node", folded.alias("v"))
    return changed.union(vectors.join(changed.select("node"), "node", "left_anti").select("node", V.doubles(F.col("v"))))


def weighted_degree(members: DataFrame, edges: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``(node, degree)``: weights of the hyperedges of a node plus weights of its pair edges."""
    of_hyper = members.join(edges.select("edge_id", "weight"), "edge_id").select("node", "weight")
    of_pairs = adjacency.select(F.col("src").alias("node"), "weight")
    return of_hyper.union(of_pairs).groupBy("node").agg(F.sum("weight").alias("degree"))


def complexity(members: DataFrame, n_nodes: int, sigma: float) -> DataFrame:
    """``(density, complexity)``: members per node and ``σ ln(density + 1)``."""
    density = F.count(F.lit(1)) / F.lit(float(max(n_nodes, 1)))
    return members.agg(density.alias("density")).withColumn("complexity", F.lit(float(sigma)) * F.log(F.col("density") + 1))
