"""Growth of the graph from queries, documents and training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.operators import topk


def expand_abbreviations(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``(key, expanded)``: tokens that are abbreviations of a word are replaced by it, the rest kept; tokens joined by blanks.

    ``lexicon (word, abbrevs array<string>)``; of several words with one abbreviation the first in order counts. Null texts are left out.
    """
    known = lexicon.select("word", F.explode("abbrevs").alias("a")).groupBy(F.lower("a").alias("token")).agg(F.min("word").alias("word"))
    words = rows.where(F.col(text).isNotNull()).select(key, F.posexplode_outer(T.tokens(F.col(text))).alias("i", "token"))
    joined = words.join(known, "token", "left").select(key, "i", F.coalesce("word", "token").alias("w"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda e: e["w"]), " ").alias("expanded"))


def grow_actions(items: DataFrame, known: DataFrame, reuse: float = 0.78, link: float = 0.15) -> DataFrame:
    """``(id, action, nearest, weight)``: what happens to each new item ``(id, v)``.

    Above ``reuse`` similarity the nearest known node stands for it; above ``link`` it is added and linked with that weight, else
    added alone.
    """
    near = topk.topk_join(items, known, 1).select(F.col("q").alias("id"), F.col("id").alias("nearest"), "sim")
    s = F.col("sim")
    action = F.when(s > reuse, "reuse").when(s > link, "link").otherwise("add")
    return items.select("id").join(near, "id", "left").select("id", action.alias("action"), F.when(s > link, F.col("nearest")).alias("nearest"), F.when((s > link) & (s <= reuse), s).alias("weight"))


def token_chains(rows: DataFrame, key: str, text: str, least: int = 3, weight: float = 0.55) -> DataFrame:
    """``(a, b, n, weight)``: neighbouring words of a query that aren't stop words, for growing from queries the graph doesn't know."""
    words = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(T.tokens(F.col(text), 32)).alias("i", "token"))
    kept = words.where((F.length("token") >= least) & ~F.col("token").isin(T.GROW_STOPWORDS))
    before = F.lag("token").over(Window.partitionBy(key).orderBy("i"))
    return kept.select(before.alias("a"), F.col("token").alias("b")).where("a is not null and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(weight))


def training_edges(samples: DataFrame, key: str, concepts: str, rate: float = 0.05) -> DataFrame:
    """``(a, b, n, weight)``: the dense links a training step makes between a sample's first eight concepts, weight ``.65 + rate``."""
    held = F.slice(F.array_distinct(F.filter(F.transform(concepts, lambda x: F.lower(F.trim(x))), lambda x: x != "")), 1, 8)
    one = samples.select(key, held.alias("c"))
    pairs = one.select(F.explode(F.flatten(F.transform("c", lambda a: F.transform(F.filter(F.col("c"), lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.select("p.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(0.65 + rate))


def query_loss(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(q, loss)``: the distance of each query to its nearest node, 1 without one."""
    near = topk.topk_join(queries, nodes, 1).select("q", (1 - F.col("sim")).alias("loss"))
    return queries.select(F.col("id").alias("q")).join(near, "q", "left").select("q", F.coalesce("loss", F.lit(1.0)).alias("loss"))


def vocabulary_embed(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, projection: np.ndarray | None = None, limit: int = 128) -> DataFrame:
    """``(key, v)``: unit weighted means of word vectors, weights ``1.1 / (1 + .05 i)`` by place among the first ``limit`` words; texts without
    a known word are left out (they take n-gram vectors). ``vocabulary (word, v)`` is joined, never gathered."""
    from hyperspark.functions import vector as V
    from hyperspark.operators.hyper import vector_sums

    words = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(T.tokens(F.col(text), limit)).alias("i", "word"))
    held = words.join(vocabulary, "word").withColumn("weight", 1.1 / (1 + 0.05 * F.col("i")))
    means = vector_sums(held, key, "v", "weight", "v")
    if projection is None:
        return means.select(key, V.normalise(F.col("v")).alias("v"))
    shared = rows.sparkSession.sparkContext.broadcast(projection)

    def project(frames):
        for frame in frames:
            if len(frame):
                x = np.vstack(frame["v"].to_list()) @ shared.value.T
                frame["v"] = list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
                yield frame

    return means.mapInPandas(project, means.schema)


def random_projection(rows: int = 384, columns: int = 300, seed: int = 0xDEADBEEFCAFE1234) -> np.ndarray:
    """A fixed matrix of near-normal entries (sums of three uniforms of a 64-bit congruential generator), rows of unit length."""
    state, out = seed, np.zeros(rows * columns)
    for i in range(len(out)):
        total = 0.0
        for _ in range(3):
            state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            total += (state >> 33) / float(1 << 31) - 0.5
        out[i] = total
    out = out.reshape(rows, columns)
    return out / np.linalg.norm(out, axis=1, keepdims=True)
