"""Steps that advance the graph: what prune passes, rewards, queries, answers and documents change.

Every step is computed from one snapshot and returns new rows; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT, EngineConfig
from hyperspark.functions import text as T
from hyperspark.functions import vector as V
from hyperspark.operators import hyper, topk
from hyperspark.plans.runtime import ship

MERGE_BLEND, MERGE_USAGE = 0.12, 0.35
FEEDBACK_RATE, FEEDBACK_USAGE, FEEDBACK_NODES, PROMOTE_ABOVE = 0.06, 2.0, 128, 0.70
KEY_NODES, KEY_ACTIVATION = 16, 0.3
SESSION_BLEND = 0.15
#: Words no node grows from when an answer is read.
ANSWER_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "this", "that", "it", "in", "on", "at", "by", "for", "with", "to", "of", "and", "or",
    "not", "note", "based", "graph", "context", "confidence", "formula", "chain",
)
#: Words a document is not read for.
DOCUMENT_SKIPPED = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "this", "that",
    "in", "on", "at", "by", "for", "with", "about", "from", "to", "of", "and", "or", "but", "not", "it", "its", "i", "you", "he", "she", "we", "they", "so", "as",
)


def apply_prune(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """``(id, v, usage, pruned)`` of all nodes after a prune pass.

    ``nodes (id, v, usage)``, ``actions (id, action, into)`` of :func:`hyperspark.operators.graph.prune_pass`. Dropped and merged
    nodes are pruned. The target of merges gains .35 of their usage, and its vector becomes the unit sum of itself by .88^m and
    the m merged ones by .12 · .88^(m − place) in order of ids: the repeated blend, made a unit once. Null usage counts 0.
    """
    rows = nodes.select("id", "v", F.coalesce("usage", F.lit(0.0)).alias("usage"))
    merged = actions.where("action = 'merge' and into is not null").select("id", "into").join(rows, "id")
    place = Window.partitionBy("into").orderBy("id")
    placed = merged.withColumn("n", F.row_number().over(place))
    sizes = merged.groupBy("into").agg(F.count(F.lit(1)).alias("m"), F.sum(MERGE_USAGE * F.col("usage")).alias("gain"))
    parts = placed.join(sizes.select("into", "m"), "into").select("into", "v", (MERGE_BLEND * F.pow(F.lit(1 - MERGE_BLEND), F.col("m") - F.col("n"))).alias("w"))
    own = rows.join(sizes, F.col("id") == F.col("into")).select("into", "v", F.pow(F.lit(1 - MERGE_BLEND), F.col("m")).alias("w"))
    blended = hyper.vector_sums(parts.union(own), "into", "v", "w", "sum").select(F.col("into").alias("id"), V.normalise(F.col("sum")).alias("blended"))
    gone = actions.where("action in ('drop', 'merge')").select("id", F.lit(True).alias("gone")).distinct()
    out = rows.join(sizes.select(F.col("into").alias("id"), "gain"), "id", "left").join(blended, "id", "left").join(gone, "id", "left")
    return out.select("id", F.coalesce("blended", V.doubles(F.col("v"))).alias("v"), (F.col("usage") + F.coalesce("gain", F.lit(0.0))).alias("usage"), F.coalesce("gone", F.lit(False)).alias("pruned"))


def drop_unfired(edges: DataFrame, time: float, after: float = 60.0) -> DataFrame:
    """Hyperedges that stay in a prune pass: after so long a time those that never fired are gone; null counts as never."""
    return edges.where(F.lit(time <= after) | (F.coalesce("fire_count", F.lit(0)) > 0))


def active_of(feedback: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, node, place)``: the first 128 different active nodes of each entry in order of ids; null nodes are none."""
    listed = feedback.select(key, "reward", "ts", F.slice(F.array_sort(F.array_distinct(F.filter("active_nodes", lambda x: x.isNotNull()))), 1, FEEDBACK_NODES).alias("held"))
    return listed.select(key, "reward", "ts", F.posexplode("held").alias("place", "node"))


def node_feedback(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """``(id, entropy, usage, promoted)``: entropy gains ``.06 r`` an entry, usage ``2 r`` of positive rewards.

    ``nodes (id, entropy_score, usage_count, in_fast_ring)``, ``feedback (query_id, reward, ts, active_nodes)``. Rewards are clamped
    to [−1, 1]; null and infinite ones count nothing. Entries add up before the clamp. A node that gained from a positive reward and
    ends above .70 is promoted if it isn't in the fast ring.
    """
    r = V.clamp(F.col("reward"), -1.0, 1.0)
    fine = feedback.where("reward is not null and not isnan(reward) and abs(reward) < double('infinity')")
    sums = active_of(fine).select(F.col("node").alias("id"), r.alias("r")).groupBy("id").agg(F.sum("r").alias("r"), F.sum(F.greatest("r", F.lit(0.0))).alias("gain"))
    out = nodes.select("id", F.coalesce("entropy_score", F.lit(0.0)).alias("e"), F.coalesce("usage_count", F.lit(0.0)).alias("u"), F.coalesce("in_fast_ring", F.lit(False)).alias("fast")).join(sums, "id", "left").na.fill({"r": 0.0, "gain": 0.0})
    entropy = V.clamp(F.col("e") + FEEDBACK_RATE * F.col("r"))
    return out.select("id", entropy.alias("entropy"), (F.col("u") + FEEDBACK_USAGE * F.col("gain")).alias("usage"), ((F.col("gain") > 0) & (entropy > PROMOTE_ABOVE) & ~F.col("fast")).alias("promoted"))


def episodes(results: DataFrame, activations: DataFrame) -> DataFrame:
    """``(q, query, response, confidence, key_nodes)`` to store: texts of at most 511 and 1,023 characters, the first 16 nodes above .3.

    ``results (q, query, response, confidence)``, ``activations (q, node, activation, arrival)``; only 16 nodes a query are held.
    """
    by = Window.partitionBy("q").orderBy("arrival", "node")
    kept = activations.where(F.col("activation") > KEY_ACTIVATION).withColumn("n", F.row_number().over(by)).where(F.col("n") <= KEY_NODES)
    keys = kept.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda e: e["node"]).alias("key_nodes"))
    return results.join(keys, "q", "left").select("q", F.substring("query", 1, 511).alias("query"), F.substring("response", 1, 1023).alias("response"), "confidence", F.coalesce("key_nodes", F.array().cast("array<bigint>")).alias("key_nodes"))


def working_inserts(activations: DataFrame, first: int = 4, above: float = 0.25) -> DataFrame:
    """``(q, node, salience)``: what a query puts into working memory, of its first four nodes those above .25."""
    by = Window.partitionBy("q").orderBy("arrival", "node")
    return activations.withColumn("n", F.row_number().over(by)).where((F.col("n") <= first) & (F.col("activation") > above)).select("q", "node", F.col("activation").alias("salience"))


def session_vectors(turns: DataFrame, session: str = "session_id", order: str = "turn", vector: str = "sig", alpha: float = SESSION_BLEND) -> DataFrame:
    """``(session, turn, v)``: the session's vector after each turn, blended by .15 and made a unit each time; it starts as the first turn's.

    Turns stream through in order; one vector of a session is held. Turns without a vector are left out.
    """
    ship(turns.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session_now, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, out = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), []
            for name, row in zip(batch.column(0).to_pylist(), rows):
                held = row if name != session_now else (1 - alpha) * held + alpha * row
                session_now = name
                length = np.sqrt(held @ held)
                held = held / length if length > 1e-12 else held
                out.append(held)
            table = np.concatenate(out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * rows.shape[1]), pa.array(table))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], [session, order, "v"])

    few = turns.where(F.col(session).isNotNull() & F.col(vector).isNotNull()).select(session, order, V.doubles(F.col(vector)).alias("v"))
    return few.repartition(session).sortWithinPartitions(session, order).mapInArrow(fold, few.schema)


def synonym_links(terms: DataFrame, lexicon: DataFrame, weight: float = 0.78) -> DataFrame:
    """``(a, b, weight, type)``: links of terms ``(label)`` that the lexicon ``(word, synonyms)`` knows to their synonyms, in lower case."""
    known = lexicon.select(F.lower("word").alias("a"), F.explode("synonyms").alias("b")).where("trim(b) <> ''")
    return terms.select(F.lower("label").alias("a")).distinct().join(known, "a").select("a", F.lower("b").alias("b")).where("a <> b").distinct().select("a", "b", F.lit(weight).alias("weight"), F.lit("SYNONYM").alias("type"))


def answer_terms(answers: DataFrame, known: DataFrame, limit: int = 6) -> DataFrame:
    """``(q, place, label, before)``: up to six new terms of each grounded answer with a confidence of .5 or more, and the term before each.

    ``answers (q, response, confidence, grounded)``; a term has four letters or more, is no stop word and no label of ``known``. Terms
    are linked by .30 to the top node of their query and by .35 to the term before.
    """
    good = answers.where((F.col("confidence") >= 0.5) & F.col("grounded") & F.col("response").isNotNull())
    words = good.select("q", F.posexplode(T.tokens(F.col("response"), 64)).alias("i", "label")).where((F.length("label") >= 4) & ~F.col("label").isin(*ANSWER_STOPWORDS))
    fresh = words.groupBy("q", "label").agg(F.min("i").alias("i")).join(known.select(F.lower("label").alias("label")).distinct(), "label", "left_anti")
    by = Window.partitionBy("q").orderBy("i")
    return fresh.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("q", "place", "label", F.lag("label").over(by).alias("before"))


def document_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, label)``: the terms a document is read for, of its first 128 tokens those of four letters or more that aren't skipped."""
    words = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(T.tokens(F.col(text), 128)).alias("i", "label")).where((F.length("label") >= 4) & ~F.col("label").isin(*DOCUMENT_SKIPPED))
    return words.select(key, F.row_number().over(Window.partitionBy(key).orderBy("i")).alias("place"), "label")


def document_links(terms: DataFrame, nodes: DataFrame, key: str, width: int = 8, least: float = 0.25, factor: float = 0.7) -> DataFrame:
    """``(a, b, weight)``: links of nodes met within eight terms of one another in a document whose vectors' product is above .25.

    ``terms (key, place, node)``, ``nodes (id, v)`` with unit vectors; the weight is .7 of the product. A pair is scored once,
    however often it is met.
    """
    # A term meets those before it where its document's terms lie in order: no pair of terms is shuffled before it is distinct.
    near = Window.partitionBy(key).orderBy("place").rangeBetween(-width, -1)
    met = terms.where(F.col(key).isNotNull() & F.col("place").isNotNull()).select(F.col("node").alias("a"), F.collect_list("node").over(near).alias("before"))
    pairs = met.select("a", F.explode("before").alias("b")).where("a <> b").distinct()
    ends = nodes.select("id", "v")
    joined = pairs.join(ends.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(ends.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    product = V.clamp(V.dot(F.col("va"), F.col("vb")))
    return joined.select("a", "b", F.round(product, 9).alias("sim")).where(F.col("sim") > least).select("a", "b", (factor * F.col("sim")).alias("weight"))


def reused(fresh: DataFrame, known: DataFrame, above: float = 0.88) -> DataFrame:
    """``(id, node)``: for each new vector ``(id, v)`` the known node nearest above the bound, else the smallest new one as near, else itself.

    New vectors are compared with known ones first; those left are led by their smallest near one, so that near copies within a
    batch enter once.
    """
    old = topk.topk_join(fresh, known, 1, above).where(F.col("sim") > above).select(F.col("q").alias("id"), F.col("id").alias("node"))
    left = fresh.join(old, "id", "left_anti")
    near = topk.topk_join(left, left, 16, above).where((F.col("sim") > above) & (F.col("id") < F.col("q"))).groupBy(F.col("q").alias("id")).agg(F.min("id").alias("node"))
    return old.union(left.select("id").join(near, "id", "left").select("id", F.coalesce("node", "id").alias("node")))


def fire_edges(edges: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Edges with ``last_fired`` set to ``now`` where ``(src, dst)`` fired; others keep theirs."""
    marks = fired.select("src", "dst", F.lit(True).alias("__fired")).distinct()
    return edges.join(marks, ["src", "dst"], "left").withColumn("last_fired", F.when(F.col("__fired"), now).otherwise(F.col("last_fired"))).drop("__fired")


def view_feedback(nodes: DataFrame, context: Column, reward: Column, rate: float = 0.02) -> DataFrame:
    """``(id, weights)``: view weights after a reward, by the view that agrees most with the context's; ``nodes (id, views, weights)``."""
    products = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: V.dot(F.get("views", k), F.get(context, k)))
    return nodes.select("id", V.learn_view_weights(F.col("weights"), products, reward, rate).alias("weights"))


def training_plan(epochs: int, rate: float, factor: float = 0.96, floor: float = 0.005) -> list[tuple[int, float]]:
    """``(epoch, rate)``: the learning rate of each epoch, falling by ``factor`` down to ``floor``."""
    return [(n, max(rate * factor**n, floor) if n else rate) for n in range(epochs)]


def training_weights(rate: float, config: EngineConfig = DEFAULT) -> dict[str, float]:
    """Weights a training step gives: dense links, the causal link, the hyperedge, and the rewards of right and wrong answers."""
    top = config.hebbian_ceiling
    return {"dense": min(0.65 + rate, top), "causes": min(0.78 + 0.5 * rate, top), "hyperedge": min(0.80 + 0.5 * rate, top), "right": min(15 * rate, 1.0), "wrong": max(-5 * rate, -1.0)}
