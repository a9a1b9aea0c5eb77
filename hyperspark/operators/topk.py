"""Exact top-k similarity join of a stated query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import ship

BLOCK_ROWS = 20_000
#: Queries of a block; a task holds a block of rows and a block of queries.
BLOCK_QUERIES = 5_000


def topk_join(queries: DataFrame, base: DataFrame, k: int, least: float = -2.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(q, id, sim, rank)``: for each query the ``k`` rows of ``base`` with the largest dot product, from ``least`` on.

    Both sides hold ``(id long, v array<double>)``. Rows of ``base`` fall into blocks of about ``block_rows``, queries
    into blocks of about 5,000; a task compares one of each and its best rows come back, so no pair of rows is ever shuffled. A row isn't
    its own neighbour; ties go to the smaller id; rows with null or other-length vectors are left out.
    """
    ship(base.sparkSession)
    blocks, parts = max(1, -(-base.count() // block_rows)), max(1, -(-queries.count() // BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = base.where("id is not null and v is not null").select("id", "v", own(blocks).alias("block"), each(parts).alias("part"), F.lit(False).alias("query"))
    asked = queries.where("id is not null and v is not null").select("id", "v", each(blocks).alias("block"), own(parts).alias("part"), F.lit(True).alias("query"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        q, b = frame[frame["query"]], frame[~frame["query"]].sort_values("id")
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        if q.empty or b.empty:
            return empty
        size = b["v"].map(len).mode()[0]
        q, b = q[q["v"].map(len) == size], b[b["v"].map(len) == size]
        ids, table, out = b["id"].to_numpy(), np.vstack(b["v"].to_list()), []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            sims = np.round(np.vstack(part["v"].to_list()) @ table.T, 9)
            sims[ids[None, :] == part["id"].to_numpy()[:, None]] = -np.inf
            n = min(k, len(ids))
            edge = np.partition(sims, len(ids) - n, axis=1)[:, len(ids) - n]
            row, column = np.nonzero((sims >= edge[:, None]) & (sims >= least) & np.isfinite(sims))
            found = pd.DataFrame({"q": part["id"].to_numpy()[row], "id": ids[column], "sim": sims[row, column]}).sort_values(["q", "sim", "id"], ascending=[True, False, True])
            out.append(found.groupby("q").head(k))
        return pd.concat(out) if out else empty

    found = rows.union(asked).groupBy("block", "part").applyInPandas(best, "q long, id long, sim double")
    ranked = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "id"))), 1, k).alias("near"))
    return ranked.select("q", F.posexplode("near").alias("i", "e")).select("q", F.col("e.id").alias("id"), (-F.col("e.d")).alias("sim"), (F.col("i") + 1).alias("rank"))


def near_duplicates(items: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``items`` without those that have a row of ``known`` at ``least`` similarity or more (strictly above)."""
    found = topk_join(items, known, 1).where(F.col("sim") > least).select(F.col("q").alias("id"))
    return items.join(found, "id", "left_anti")
