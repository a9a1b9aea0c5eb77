"""A mixture of sources in which each source gives its target share of all tokens.

Every document of a source is due the same fractional number of copies; the whole part is taken, the rest is
drawn by the cube method: inclusion probabilities move within the null space of the balancing constraints
(token and document totals) until each is 0 or 1 but for two or three of a block; these are pooled and moved
again until a handful per source is left for the landing, which keeps the totals closest.

Defined results: documents without tokens and sources without a target give nothing; a source that can't
reach its target gives all its documents ``max_repeats`` times; a source without documents gives nothing and
is reported; a target listed twice counts once (the larger share); null source names are no source.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperspark.llm.tokenise import count_tokens
from hyperspark.plans.runtime import cut, ship

BLOCK_DOCUMENTS = 4000
#: Units of a source left for the landing.
LANDING = 8


def source_name(column: Column) -> Column:
    """One spelling of a source: lower case, trimmed, blanks and hyphens as ``_``."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_")


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities along null vectors of (1, size) until at most two aren't 0 or 1.

    Totals of probabilities and of probability times size stay as they were.
    """
    out = chance.astype(float).tolist()
    sizes = size.astype(float).tolist()
    draws = iter(rng.random(len(out) + 8).tolist())
    open_units: list[int] = []
    for i in [*rng.permutation(len(out)).tolist(), None]:
        if i is not None:
            if 1e-9 < out[i] < 1 - 1e-9:
                open_units.append(i)
            else:
                out[i] = float(round(out[i]))
        while len(open_units) >= 3:
            a, b, c = open_units[:3]
            way = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(way):
                way = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for unit, step in zip((a, b, c), way):
                if step > 0:
                    up, down = min(up, (1 - out[unit]) / step), min(down, out[unit] / step)
                elif step < 0:
                    up, down = min(up, out[unit] / -step), min(down, (1 - out[unit]) / -step)
            by = up if next(draws, None) is not None and rng.random() * (up + down) < down else -down
            for unit, step in zip((a, b, c), way):
                out[unit] = min(1.0, max(0.0, out[unit] + by * step))
            open_units = [u for u in (a, b, c) if 1e-9 < out[u] < 1 - 1e-9] + open_units[3:]
    return np.array([round(x) if x < 1e-9 or x > 1 - 1e-9 else x for x in out])


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice of a few units whose size total, then count, is closest to the expected one."""
    want, number = float((chance * size).sum()), float(chance.sum())
    return np.array(min(product((0, 1), repeat=len(chance)), key=lambda x: (abs(float(np.dot(x, size)) - want), abs(sum(x) - number), x)), int)


class Mixture:
    """``documents``: ``(id, source, n_tokens, copies)``; ``shares``: one row per target source."""

    def __init__(self, documents: DataFrame, shares: DataFrame):
        self.documents, self.shares = documents, shares


def mix(documents: DataFrame, targets: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None, seed: int = 5) -> Mixture:
    """Mix ``documents`` to ``targets (source, target_share, max_repeats)``; shares are of the tokens of all documents."""
    spark = documents.sparkSession
    ship(spark)
    counted = cut(count_tokens(documents.withColumn(source, source_name(F.col(source))), id_column, text, vocabulary, keep=(source,)).select(F.col(id_column).alias("id"), F.col(source).alias("source"), "n_tokens"))
    total = int(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    wanted = targets.where("source is not null").select(source_name(F.col("source")).alias("source"), F.col("source").alias("named"), "target_share", "max_repeats").groupBy("source").agg(F.min("named").alias("named"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = counted.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("held_tokens"))
    plan = wanted.join(held, "source", "left").toPandas()  # one row per target source
    plan = plan.fillna({"n_documents": 0, "held_tokens": 0, "target_share": 0.0, "max_repeats": 0}).sort_values("source", ignore_index=True)
    rate = np.minimum(np.where(plan["held_tokens"] > 0, plan["target_share"] * total / plan["held_tokens"].clip(lower=1), 0.0), plan["max_repeats"])
    plan["whole"], plan["part"] = np.floor(rate).astype(int), rate - np.floor(rate)
    plan["blocks"] = np.maximum(1, np.ceil(plan["n_documents"] / BLOCK_DOCUMENTS)).astype(int)
    rates = spark.createDataFrame(plan[["source", "whole", "part", "blocks"]], "source string, whole long, part double, blocks long")
    units = counted.where("n_tokens > 0").join(F.broadcast(rates), "source").select("id", "source", "n_tokens", "whole", F.col("part").alias("chance"), F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).alias("block"))

    schema = "id long, source string, n_tokens long, whole long, chance double, block long"

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        rng = np.random.default_rng([seed, int(frame["block"][0]), sum(frame["source"][0].encode())])
        frame["chance"] = flight(frame["chance"].to_numpy(), frame["n_tokens"].to_numpy(), rng)
        return frame

    flown = cut(units.groupBy("source", "block").applyInPandas(fly, schema))
    settled, left = flown.where("chance in (0, 1)"), flown.where("chance not in (0, 1)")
    # Two or three units of each block are left; pooled blocks leave a thousandth of them, and so on.
    while left.count() > LANDING * max(len(plan), 1):
        merged = left.groupBy("source").agg(F.countDistinct("block").alias("n"))
        pooled = left.join(F.broadcast(merged), "source").withColumn("block", F.pmod(F.xxhash64("block"), F.greatest(F.lit(1), F.ceil(F.col("n") / 1000)))).drop("n").select("id", "source", "n_tokens", "whole", "chance", "block")
        flown = cut(pooled.groupBy("source", "block").applyInPandas(fly, schema))
        settled, left = settled.union(flown.where("chance in (0, 1)")), flown.where("chance not in (0, 1)")
    last = left.toPandas().sort_values(["source", "id"], ignore_index=True)
    for _, rows in last.groupby("source"):
        chance, size = rows["chance"].to_numpy(), rows["n_tokens"].to_numpy()
        if len(rows) > LANDING:
            chance = flight(chance, size, np.random.default_rng(seed))
        free = (chance > 1e-9) & (chance < 1 - 1e-9)
        chance[free] = land(chance[free], size[free])
        last.loc[rows.index, "chance"] = chance
    landed = spark.createDataFrame(last[["id", "source", "n_tokens", "whole", "chance", "block"]], schema) if len(last) else spark.createDataFrame([], schema)
    drawn = settled.union(landed).select(F.col("id").alias(id_column), "source", "n_tokens", (F.col("whole") + F.round("chance").cast("long")).alias("copies"))
    reached = drawn.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    listed = spark.createDataFrame(plan[["source", "named", "target_share", "max_repeats", "n_documents", "held_tokens"]].astype({"max_repeats": int, "n_documents": int, "held_tokens": int}), "source string, named string, target_share double, max_repeats long, n_documents long, held_tokens long")
    shares = listed.join(F.broadcast(reached), "source", "left").select(
        F.col("named").alias("source"), "target_share", "max_repeats", "n_documents", "held_tokens", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("share_reached"), (F.col("held_tokens") * F.col("max_repeats") >= F.col("target_share") * F.lit(float(total))).alias("reachable"),
    )
    whole = F.greatest(shares.agg(F.sum("mixed_tokens")).scalar(), F.lit(1))
    shares = shares.withColumn("share_of_mix", F.col("mixed_tokens") / whole)
    return Mixture(drawn, shares)
