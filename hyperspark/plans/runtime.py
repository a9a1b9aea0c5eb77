"""Plan-level helpers shared by every operator: lineage cuts, skew-safe joins, shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # A checkpoint is deleted once nothing refers to it, unless the cluster says otherwise.
    context._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hyperspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and forget its lineage; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on remote executors that don't share the driver's file system."""
    context = spark.sparkContext
    if context.master.startswith("local[") or getattr(context, "_hyperspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        target = Path(tempfile.mkdtemp(prefix="hyperspark-")) / "hyperspark.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in root.rglob("*.py"):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
    context._hyperspark_shipped = True


def below_share(share: float, *columns: str, seed: int = 0) -> Column:
    """Whether the 64-bit hash of ``columns`` is among the lowest ``share`` of all hashes; never empty for a share of 2⁻⁶³ or more."""
    top = 2**63 - 1 if share >= 1 else int(-(2**63) + share * 2**64)
    return F.xxhash64(*columns, F.lit(seed)) <= F.lit(top)


def hash_sample(df: DataFrame, by: str, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` rows of different ``by``, those of the lowest hashes: the same rows in any layout and at any size.

    One pass estimates the number of different values, a second keeps little more than the sample, so no text
    outside the sample is shuffled. Of rows with one ``by`` the smallest stays.
    """
    h = F.xxhash64(by, F.lit(seed))
    there = df.where(F.col(by).isNotNull())
    n = max(there.agg(F.approx_count_distinct(h, 0.02)).first()[0], 1)
    others = [c for c in df.columns if c != by]
    few = there.where(below_share(1.25 * rows / n, by, seed=seed)).groupBy(by).agg(F.min(F.struct(*others) if others else F.lit(1)).alias("__rest"))
    return few.orderBy(h, by).limit(rows).select(by, *[F.col("__rest")[c].alias(c) for c in others])


#: A key is never split below so many rows; splitting costs more than it saves there.
LEAST_HOT_ROWS = 20_000


def hot_keys(df: DataFrame, key: str) -> dict | None:
    """Keys that hold more rows than a task should, with the number of tasks each is to be spread over; None if there are none.

    A task should hold the rows over the shuffle partitions, so there are fewer hot keys than partitions, at any size.
    Two columns of counts reach the driver, and the rows of hot keys only where there are some.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    share = max((total or 0) / parts, LEAST_HOT_ROWS)
    if (most or 0) <= share:
        return None
    return {r[0]: int(-(-r[1] // share)) for r in counts.where(F.col("__n") > share).collect()}


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt_by: str | None = None, hot: dict | None | str = "find") -> DataFrame:
    """Equi-join on one column whose hot keys in ``left`` are spread over as many tasks as their rows need.

    Only the right rows of hot keys are repeated; all other rows move once, and without hot keys this is a plain
    join. ``salt_by`` names the left column whose hash picks the task (default: the whole row); ``hot`` are the
    keys as :func:`hot_keys` gives them, if they are known. ``how`` is ``inner``, ``left``, ``left_semi`` or
    ``left_anti``. Null keys match nothing.
    """
    if hot == "find":
        hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    kind = left.select(key).schema[0].dataType
    spread = F.broadcast(left.sparkSession.createDataFrame([(k, n) for k, n in hot.items()], StructType([StructField(key, kind), StructField("__salts", IntegerType())])))
    salt = F.pmod(F.xxhash64(*([salt_by] if salt_by else left.columns)), F.col("__salts")).cast("int")
    marked = left.join(spread, key, "left").withColumn("__salt", F.coalesce(salt, F.lit(0))).drop("__salts")
    repeated = right.join(spread, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return marked.join(repeated, [key, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
