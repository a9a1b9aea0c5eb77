"""Ranks and spectra of the graph as iterated joins, lineage cut between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT, EngineConfig
from hyperspark.plans.runtime import cut


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, config: EngineConfig = DEFAULT) -> DataFrame:
    """``(node, rank, importance)`` by weighted PageRank: ``.15/n + Σ .85 · r(u)/deg(u) · w``, made to sum to 1 each round.

    ``deg`` counts list entries; mass of nodes without edges is lost before the normalisation. With ``rounds`` given that many
    rounds run, else up to 20 until the change is below ``tolerance``. ``importance`` is the rank over the largest rank.
    """
    ids = cut(nodes.select(F.col("id").alias("node")).distinct())
    n = ids.count()
    if n == 0:
        return ids.select("node", F.lit(0.0).alias("rank"), F.lit(0.0).alias("importance"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    flow = cut(edges.join(degree, "src").select("src", F.col("dst").alias("node"), (F.col("weight") / F.col("deg")).alias("share")).repartition("src"))
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    d = config.pagerank_damping
    for _ in range(rounds or config.pagerank_rounds):
        gained = flow.join(ranks.withColumnRenamed("node", "src"), "src").groupBy("node").agg(F.sum(d * F.col("rank") * F.col("share")).alias("gain"))
        raw = ids.join(gained, "node", "left").select("node", (F.lit((1 - d) / n) + F.coalesce("gain", F.lit(0.0))).alias("raw"))
        fresh = cut(raw)
        total = fresh.agg(F.sum("raw")).first()[0]
        fresh = fresh.select("node", (F.col("raw") / total).alias("rank"))
        if rounds is None:
            change = fresh.join(ranks.withColumnRenamed("rank", "before"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
            ranks = fresh
            if change < tolerance:
                break
        else:
            ranks = fresh
    top = ranks.agg(F.max("rank")).first()[0]
    return ranks.select("node", "rank", (F.col("rank") / top).alias("importance"))


def _product(flow: DataFrame, x: DataFrame) -> DataFrame:
    return flow.join(x.withColumnRenamed("node", "src"), "src").groupBy("node").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def spectral_norm(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> float:
    """Largest singular value of the symmetric weight matrix by ``rounds`` power steps from equal entries."""
    x = cut(nodes.select(F.col("id").alias("node")).distinct())
    n = max(x.count(), 1)
    x = x.withColumn("x", F.lit(n**-0.5))
    flow, value = cut(edges.select("src", F.col("dst").alias("node"), F.col("weight").alias("w"))), 0.0
    for _ in range(rounds):
        y = cut(_product(flow, x))
        value = (y.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0) ** 0.5
        if value < 1e-12:
            return 0.0
        x = y.select("node", (F.col("x") / value).alias("x"))
    return value


def spectral_coordinates(edges: DataFrame, degree: DataFrame, k: int = DEFAULT.spectral_k, rounds: int = 30) -> DataFrame:
    """``(node, axis, value)``: leading eigenvectors of ``D^−½ A D^−½`` by power steps with deflation, sign fixed by the largest entry.

    ``edges (src, dst, weight)``, ``degree (node, degree)``. Start vectors come from hashes of the node ids. Each round is a join
    and a sum; nothing is gathered.
    """
    roots = degree.where("degree > 0").select("node", (1 / F.sqrt("degree")).alias("root"))
    flow = cut(edges.join(roots.withColumnRenamed("node", "src").withColumnRenamed("root", "ra"), "src").join(roots.withColumnRenamed("node", "dst").withColumnRenamed("root", "rb"), "dst").select("src", F.col("dst").alias("node"), (F.col("weight") * F.col("ra") * F.col("rb")).alias("w")))
    found = cut(roots.select("node"))  # a column of values for each axis found
    for axis in range(k):
        before = [f"v{j}" for j in range(axis)]
        x = cut(found.select("node", (F.pmod(F.xxhash64("node", F.lit(axis)), F.lit(2001)) / 1000.0 - 1.0).alias("x")))
        for _ in range(rounds):
            # A shift by the identity keeps eigenvalues apart from their negatives.
            y = cut(_product(flow, x).union(x.select("node", "x")).groupBy("node").agg(F.sum("x").alias("x")).join(found, "node"))
            sums = y.agg(F.sum(F.col("x") * F.col("x")), *[F.sum(F.col(v) * F.col("x")) for v in before]).first()
            away = sum((part * F.col(v) for v, part in zip(before, sums[1:]) if part), F.lit(0.0))
            x = y.select("node", ((F.col("x") - away) / max((sums[0] or 0.0) ** 0.5, 1e-12)).alias("x"))
        x = cut(x)
        length = (x.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0) ** 0.5
        sign = x.agg(F.max_by(F.signum("x"), F.struct(F.round(F.abs("x") / max(length, 1e-12), 9), -F.col("node")))).first()[0] or 1.0
        found = cut(found.join(x.select("node", (F.col("x") * (sign / max(length, 1e-12))).alias(f"v{axis}")), "node"))
    values = [F.struct(F.lit(axis).alias("axis"), F.col(f"v{axis}").alias("value")) for axis in range(k)]
    return found.select("node", F.explode(F.array(*values)).alias("e")).select("node", "e.*")


def rescore_seeds(seeds: DataFrame, coordinates: DataFrame, limit: int = DEFAULT.seeds) -> DataFrame:
    """``(q, node, combined, place)``: ``.7 (1 − dist) + .3 clamp(cos)`` with the mean coordinates of the first three seeds.

    ``seeds (q, node, dist, place)``; ``coordinates (node, axis, value)``; seeds without coordinates have cosine 0.
    """
    joined = seeds.join(coordinates, "node")
    centre = joined.where("place <= 3").groupBy("q", "axis").agg(F.avg("value").alias("centre"))
    products = joined.join(centre, ["q", "axis"]).groupBy("q", "node").agg((F.sum(F.col("value") * F.col("centre")) / (F.sqrt(F.sum(F.col("value") * F.col("value"))) * F.sqrt(F.sum(F.col("centre") * F.col("centre"))) + 1e-12)).alias("cos"))
    combined = 0.7 * (1 - F.col("dist")) + 0.3 * F.greatest(F.least(F.coalesce("cos", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    scored = seeds.join(products, ["q", "node"], "left").withColumn("combined", F.round(combined, 9))
    return scored.withColumn("new_place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("combined"), "node"))).where(F.col("new_place") <= limit).select("q", "node", "combined", F.col("new_place").alias("place"))
