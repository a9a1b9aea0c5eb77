"""Train, validation and test splits that keep tied records together.

Records of one document, and documents tied by a shared source file (directly or through others),
form a component; whole components are assigned to splits. The components come from alternating star
contractions (a few rounds of joins, no group is gathered anywhere). The assignment is a component swap
search: hashed start, then moves and exchanges of whole components that reduce the deviation of sizes and
of label shares, annealed in parallel chains over blocks of components; the best chain of a block is kept.
Components above a thousandth of all records (at most a thousand of them) are annealed first, together.

Defined results: records without an id are placed by their source, those without either by themselves;
null, blank and stand-in sources tie nothing; repeated records count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import cut, ship, skew_join

#: Source values that name no file.
STAND_INS = {"", "-", "--", "?", "unknown", "(unknown)", "stdin", "<stdin>", "n/a", "na", "none", "(none)", "null", "nil", "nan", "undefined", "tbd", "missing"}

LABEL_BUCKETS = 16
LARGE_SHARE = 1000
BLOCK_COMPONENTS = 4000
CHAINS = 3
#: Weight of the deviation of label shares against that of sizes.
LABEL_WEIGHT = 0.03


def file_key(source: str | None) -> str | None:
    """The file a source value names, in one spelling (directory and name); None where it names none."""
    if source is None or source.strip().lower() in STAND_INS:
        return None
    text = unquote(re.split(r"[?#]", source.strip(), maxsplit=1)[0])
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.replace("\\", "/")).casefold())
    text = re.sub(r"^file:(//)?", "", text)
    parts: list[str] = []
    for part in (re.sub(r"\s+", " ", p).strip() for p in text.split("/")):
        if part == ".." and parts and parts[-1] != "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    key = "/".join(parts)
    return None if key in STAND_INS else key


def file_keys(df: DataFrame, column: str) -> DataFrame:
    """``(column, file_key)`` of each distinct value of ``column``."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(file_key)

    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("file_key", keyed(F.col(column)))


def tied_groups(pairs: DataFrame) -> DataFrame:
    """``(id, group)`` of ids tied by shared keys; ``pairs`` holds ``(id, key)``, the group is named by its smallest id.

    Each round is two star contractions, each an aggregation and a join on a vertex; a vertex with many
    neighbours is spread over tasks. Rounds are logarithmic in the longest chain of ties.
    """
    pairs = cut(pairs.where(F.col("id").isNotNull()).distinct())
    ids = pairs.select("id").distinct()
    tying = pairs.where(F.col("key").isNotNull())
    least = tying.groupBy("key").agg(F.min("id").alias("least"))
    edges = cut(skew_join(tying, least, "key", salt_by="id").where(F.col("id") != F.col("least")).select(F.col("id").alias("u"), F.col("least").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = skew_join(both, lowest, "u", salt_by="v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("group"))


def _deviation(sizes: np.ndarray, labels: np.ndarray, want: np.ndarray, want_labels: np.ndarray, total: float) -> float:
    return (np.abs(sizes - want).sum() + LABEL_WEIGHT * np.abs(labels - want_labels).sum()) / max(total, 1.0)


def anneal(size: np.ndarray, labels: np.ndarray, start: np.ndarray, want: np.ndarray, want_labels: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """The best assignment met by moves and exchanges of whole components, and its deviation.

    ``size`` (n) and ``labels`` (n × l) describe components, ``start`` (n) is their first split, ``want`` (s)
    and ``want_labels`` (s × l) the sizes to come near to.
    """
    n, s = len(size), len(want)
    if n == 0 or s < 2:
        return start, 0.0
    rng, total = np.random.default_rng(seed), float(size.sum())
    now = start.copy()
    sizes = np.bincount(now, size, s)
    held = np.zeros((s, labels.shape[1]))
    np.add.at(held, now, labels)
    value = _deviation(sizes, held, want, want_labels, total)
    best, best_value = now.copy(), value
    heat = 0.2 * value + 1e-9
    for step in range(steps):
        i = int(rng.integers(n))
        a = now[i]
        if step & 1:
            j = int(rng.integers(n))
            b = now[j]
            if a == b:
                continue
            change, change_labels = size[i] - size[j], labels[i] - labels[j]
        else:
            j, b = -1, int((a + 1 + rng.integers(s - 1)) % s)
            change, change_labels = size[i], labels[i]
        part = (abs(sizes[[a, b]] - want[[a, b]]).sum() + LABEL_WEIGHT * np.abs(held[[a, b]] - want_labels[[a, b]]).sum()) / total
        new_a, new_b = sizes[a] - change, sizes[b] + change
        new_part = (abs(new_a - want[a]) + abs(new_b - want[b]) + LABEL_WEIGHT * (np.abs(held[a] - change_labels - want_labels[a]).sum() + np.abs(held[b] + change_labels - want_labels[b]).sum())) / total
        worse = new_part - part
        # Cooling ends after half the steps; the rest only descends.
        if worse <= 0 or rng.random() < np.exp(-worse / (heat * max(0.0, 1 - 2 * step / steps) ** 2 + 1e-12)):
            now[i] = b
            if j >= 0:
                now[j] = a
            sizes[a], sizes[b] = new_a, new_b
            held[a] -= change_labels
            held[b] += change_labels
            value += worse
            if value < best_value - 1e-12:
                best, best_value = now.copy(), value
    return best, float(best_value)


def _hashed(keys: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Splits by hash, in proportion to the shares."""
    edges = np.cumsum(shares) / max(shares.sum(), 1e-12)
    return np.minimum(np.searchsorted(edges, (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right"), len(shares) - 1)


def _vectors(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["n"].to_numpy(float), np.vstack(frame["labels"].to_list()).astype(float) if len(frame) else np.zeros((0, LABEL_BUCKETS))


class Splits:
    """The result of :func:`split_records`."""

    def __init__(self, ids: DataFrame, components: DataFrame, shares: DataFrame):
        self.ids, self.components, self.shares = ids, components, shares


def split_records(records: DataFrame, targets: DataFrame, record: str = "sample_id", id_column: str = "doc_id", source: str = "source", label: str = "domain", steps: int = 6000) -> Splits:
    """Assign the components of ``records`` to the splits of ``targets (split_name, target_share)``.

    ``ids``: ``(id, group, split_name)`` of each id; ``components``: ``(component, n, split_name, hashed_split)``;
    ``shares``: ``(split_name, target_share, hashed_share, actual_share, n_records)``.
    """
    spark = records.sparkSession
    ship(spark)
    rows = records.select(
        F.col(record).cast("string").alias("record"), F.when(F.trim(F.col(id_column)) != "", F.col(id_column)).alias("id"), F.col(source).cast("string").alias("__source"), F.lower(F.trim(F.col(label))).alias("label")
    )
    keys = file_keys(rows, "__source")
    distinct = rows.groupBy("id", "__source").agg(F.count(F.lit(1)).alias("rows"))
    named = cut(skew_join(distinct, keys, "__source", "left", salt_by="id").select("id", "__source", F.col("file_key").alias("key")))
    groups = cut(tied_groups(named.select("id", "key")))
    # The component of a record: that of its id, else of its source, else its own.
    of_key = skew_join(named.where(F.col("id").isNotNull() & F.col("key").isNotNull()).select("id", "key"), groups, "id").groupBy("key").agg(F.min("group").alias("by_key"))
    orphan = named.where(F.col("id").isNull() & F.col("key").isNotNull()).select("__source", "key").join(of_key, "key", "left").select("__source", F.coalesce("by_key", F.concat(F.lit("file:"), "key")).alias("by_source"))
    with_id = skew_join(rows.where(F.col("id").isNotNull()), groups, "id", salt_by="record").select("record", "label", F.col("group").alias("component"))
    without = skew_join(rows.where(F.col("id").isNull()), orphan, "__source", "left", salt_by="record").select("record", "label", F.coalesce("by_source", F.concat(F.lit("record:"), "record")).alias("component"))
    once = with_id.union(without).groupBy("record", "component").agg(F.min("label").alias("label"))
    bucket = F.pmod(F.xxhash64(F.coalesce("label", F.lit(""))), F.lit(LABEL_BUCKETS))
    components = cut(once.groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum((bucket == b).cast("double")) for b in range(LABEL_BUCKETS)]).alias("labels")))

    wanted = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("target_share")).orderBy("split_name").collect()
    names, shares = [r[0] for r in wanted], np.array([r[1] for r in wanted], float)
    shares = shares / max(shares.sum(), 1e-12)
    totals = components.agg(F.sum("n"), F.count(F.lit(1)), F.array(*[F.sum(F.col("labels")[b]) for b in range(LABEL_BUCKETS)])).first()
    total, label_total = totals[0] or 0.0, np.array([x or 0.0 for x in totals[2]])

    # At most LARGE_SHARE components hold more than 1 / LARGE_SHARE of the records each.
    keyed = components.withColumn("h", F.xxhash64("component"))
    large = keyed.where(F.col("n") * LARGE_SHARE > total).toPandas().sort_values(["n", "component"], ascending=[False, True], ignore_index=True)
    size, labels = _vectors(large)
    hashed = _hashed(large["h"].to_numpy(np.int64), shares)
    rest_total = max(total - size.sum(), 0.0)
    # Each chain starts from its own order of filling the emptiest split; the small components fill what remains.
    placed, best = hashed.copy(), np.inf
    for seed in range(CHAINS if len(large) else 0):
        start, filled = hashed.copy(), np.zeros(len(names))
        if seed:
            for i in range(len(size)):
                start[i] = int(np.argmax(shares * total - filled))
                filled[start[i]] += size[i]
        tried, value = anneal(size, labels, start, shares * size.sum(), np.outer(shares, labels.sum(0)), seed, steps * 3)
        over = np.maximum(np.bincount(tried, size, len(names)) - shares * total, 0).sum() / max(total, 1.0)
        if (over, value) < (best if isinstance(best, tuple) else (best, best)):
            placed, best = tried, (over, value)
    held, held_labels = np.bincount(placed, size, len(names)), np.zeros((len(names), LABEL_BUCKETS))
    np.add.at(held_labels, placed, labels)
    left = np.maximum(shares * total - held, 0.0)
    left = left / max(left.sum(), 1e-12)
    left_labels = np.maximum(np.outer(shares, label_total) - held_labels, 0.0)
    left_labels = left_labels / np.maximum(left_labels.sum(0), 1e-12)

    blocks = max(1, -(-int(totals[1]) // BLOCK_COMPONENTS))
    small = keyed.where(F.col("n") * LARGE_SHARE <= total).withColumn("block", F.pmod(F.xxhash64("component", F.lit(7)), F.lit(blocks)).cast("int"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("component", ignore_index=True)
        block, chain = int(frame["block"][0]), int(frame["chain"][0])
        own, own_labels = _vectors(frame)
        first = _hashed(frame["h"].to_numpy(np.int64), left)
        found, value = anneal(own, own_labels, first, left * own.sum(), left_labels * own_labels.sum(0), 1000 * block + chain, steps)
        return pd.DataFrame({"component": frame["component"], "block": block, "chain": chain, "value": value, "split": found})

    tried = small.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1)))).groupBy("block", "chain").applyInPandas(search, "component string, block int, chain int, value double, split int")
    best_chain = F.row_number().over(_window("component", "value", "chain"))
    chosen = tried.withColumn("best", best_chain).where("best = 1").select("component", "split")
    fixed = spark.createDataFrame(pd.DataFrame({"component": large["component"].astype(str), "split": placed.astype(int)}), "component string, split int") if len(large) else spark.createDataFrame([], "component string, split int")
    name_of = F.element_at(F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit(None).cast("string")), F.col("split") + 1)
    hashed_split = spark.createDataFrame(pd.DataFrame({"i": range(len(names)), "low": np.concatenate([[0.0], np.cumsum(shares)[:-1]]) if names else [], "high": np.cumsum(shares)}), "i int, low double, high double")
    part = F.pmod(F.shiftright("h", 11), F.lit(1 << 53)) / float(1 << 53)
    assigned = keyed.join(chosen.union(fixed), "component").withColumn("part", part)
    assigned = cut(assigned.join(F.broadcast(hashed_split), (F.col("part") >= F.col("low")) & ((F.col("part") < F.col("high")) | (F.col("i") == len(names) - 1)), "left").select("component", "n", name_of.alias("split_name"), F.element_at(F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit(None).cast("string")), F.col("i") + 1).alias("hashed_split")))
    actual = assigned.groupBy("split_name").agg(F.sum("n").alias("n_records"))
    by_hash = assigned.groupBy(F.col("hashed_split").alias("split_name")).agg(F.sum("n").alias("hashed"))
    report = (
        targets.where("split_name is not null").groupBy("split_name").agg(F.max("target_share").alias("target_share"))
        .join(actual, "split_name", "left").join(by_hash, "split_name", "left")
        .select("split_name", "target_share", (F.coalesce("hashed", F.lit(0.0)) / max(total, 1.0)).alias("hashed_share"), (F.coalesce("n_records", F.lit(0.0)) / max(total, 1.0)).alias("actual_share"), F.coalesce("n_records", F.lit(0.0)).cast("long").alias("n_records"))
    )
    ids = skew_join(groups, assigned.select(F.col("component").alias("group"), "split_name"), "group", salt_by="id").select("id", "group", "split_name")
    return Splits(ids, assigned, report)


def _window(partition: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(*order)
