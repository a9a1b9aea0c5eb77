"""Session memory: context blending, working memory, episodes and ring buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT
from hyperspark.functions import vector as V
from hyperspark.operators.topk import BLOCK_QUERIES, BLOCK_ROWS
from hyperspark.plans.runtime import ship


def ring(rows: DataFrame, partition: list[str], order: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of each ring buffer, oldest overwritten first."""
    newest = Window.partitionBy(*partition).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__age", F.row_number().over(newest)).where(F.col("__age") <= size).drop("__age")


def context_blend(turns: DataFrame, session: str = "session_id", order: str = "turn", vector: str = "sig") -> DataFrame:
    """Each turn's vector blended with the last four turns: weights .25, .125, .0625, .03125 one after the other (an iterated mean)."""
    w = Window.partitionBy(session).orderBy(order)
    rows = turns
    for k in range(1, 5):
        rows = rows.withColumn(f"__p{k}", F.lag(vector, k).over(w))
    out = V.doubles(F.col(vector))
    for k, alpha in enumerate((0.25, 0.125, 0.0625, 0.03125), 1):
        before = F.col(f"__p{k}")
        rows = rows.withColumn("__b", out if k == 1 else F.col("__b"))
        rows = rows.withColumn("__b", F.when(before.isNull(), F.col("__b")).otherwise(V.blend(F.col("__b"), before, alpha)))
    return rows.withColumn("blended", F.col("__b")).drop("__b", "__p1", "__p2", "__p3", "__p4")


def recall(episodes: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """``(q, episode, score, rank)``: ``.85 max(cos, 0) + .15 e^(−age/3600)`` of the ``k`` best episodes of a query.

    ``episodes (episode, v, age)`` with unit vectors and ages in seconds, ``queries (q, v)``; queries meet the episodes in blocks of both.
    """
    ship(episodes.sparkSession)
    blocks, parts = max(1, -(-episodes.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = episodes.select("episode", "v", F.col("age").cast("double").alias("age"), F.pmod(F.xxhash64("episode"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"), F.lit(None).cast("long").alias("q"))
    asked = queries.select(F.lit(None).cast("long").alias("episode"), "v", F.lit(0.0).alias("age"), each(blocks).alias("block"), F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), "q")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        own, q = frame[frame["q"].isna()].sort_values("episode"), frame[frame["q"].notna()]
        if own.empty or q.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "episode": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        sims = np.maximum(np.vstack(q["v"].to_list()) @ np.vstack(own["v"].to_list()).T, 0.0)
        scores = np.round(0.85 * sims + 0.15 * np.exp(-own["age"].to_numpy() / 3600.0), 9)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"q": np.repeat(q["q"].astype("int64").to_numpy(), order.shape[1]), "episode": own["episode"].astype("int64").to_numpy()[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

    found = rows.unionByName(asked).groupBy("block", "part").applyInPandas(best, "q long, episode long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "episode")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def warm_up(activation, reward):
    """Activation of a recalled key node: plus ``clamp(.3 reward + .1, 0, .3)``, at most .4."""
    return F.least(activation + V.clamp(0.3 * reward + 0.1, 0.0, 0.3), F.lit(0.4))


def working_memory(events: DataFrame, slots: int = DEFAULT.working_memory_slots) -> DataFrame:
    """``(session_id, node, salience)`` after all of a session's queries.

    ``events (session_id, turn, node, salience)``. Each query first fades all slots by .8 and drops those up to .05, then its nodes
    enter in order of salience: a node held already keeps the larger salience; when all slots are full the least is replaced
    if the new one is larger. Rows are sorted by session and stream through the fold, which holds one session's slots.
    """
    ship(events.sparkSession)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, turn, held = None, None, {}
        for frame in frames:
            done: list[tuple] = []
            for row in frame.itertuples(index=False):
                if row.session_id != session:
                    done += [(session, n, s) for n, s in held.items()]
                    session, turn, held = row.session_id, None, {}
                if row.turn != turn:
                    turn = row.turn
                    held = {n: s * 0.8 for n, s in held.items() if s * 0.8 > 0.05}
                if row.node in held:
                    held[row.node] = max(held[row.node], row.salience)
                elif len(held) < slots:
                    held[row.node] = row.salience
                else:
                    least = min(held, key=lambda x: (held[x], x))
                    if row.salience > held[least]:
                        del held[least]
                        held[row.node] = row.salience
            yield pd.DataFrame(done, columns=["session_id", "node", "salience"])
        yield pd.DataFrame([(session, n, s) for n, s in held.items()], columns=["session_id", "node", "salience"])

    rows = events.where("session_id is not null and node is not null and salience is not null").select(F.col("session_id").cast("long"), F.col("turn").cast("long"), F.col("node").cast("long"), F.col("salience").cast("double"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "turn", F.desc("salience"), "node").mapInPandas(fold, "session_id long, node long, salience double")


def ema(rows: DataFrame, partition: str, order: str, value: str, keep: float) -> DataFrame:
    """Exponential mean per partition: ``keep · mean + (1 − keep) · value`` in order, from 0; as a weighted sum with powers of ``keep``."""
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    aged = rows.where(F.col(value).isNotNull()).withColumn("__age", F.row_number().over(w) - 1)
    return aged.groupBy(partition).agg(F.sum((1 - keep) * F.pow(F.lit(keep), F.col("__age")) * F.col(value)).alias("mean"), F.count(F.lit(1)).alias("n"))
