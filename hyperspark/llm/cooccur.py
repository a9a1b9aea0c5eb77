"""How often two items stand in the same basket, against chance.

The pair counts are a Gram matrix of the binary basket × item matrix, summed over blocks of records: a task
turns each block of baskets into sparse rows, multiplies the block by its transpose (an outer-product sum over
rows, one shifted product per distance within a row), adds products while they fit and sends sums on; sums of
the same pair meet in one aggregation. Item counts give the expected count of each pair.

Defined results: rows of one basket id are joined and count once; null and empty items, and rows without a
basket id, are left aside; baskets without items are no baskets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import cut, ship

#: Bits of the filter of items that can be part of a sought pair; fixed whatever the number of items.
FILTER_BITS = 1 << 24
#: Pair sums a task keeps before it sends them on, and products made at a time; both only bound memory.
HELD_PAIRS = 2_000_000
BLOCK_ITEMS = 200_000


def compared(item: Column) -> Column:
    """The form in which items are compared: lower case, ``-`` and ``_`` as spaces, white space trimmed and single."""
    return F.trim(F.regexp_replace(F.lower(item), r"[\s _-]+", " "))


def _combine(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first)


def block_gram(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper off-diagonal entries of XᵀX of a sparse binary block; ``rows`` ascending, ``items`` distinct and ascending within a row."""
    names, local = np.unique(items, return_inverse=True)
    width, made = len(names), []
    for distance in range(1, len(rows)):
        same = rows[distance:] == rows[:-distance]
        if not same.any():
            break
        made.append(local[:-distance][same].astype(np.int64) * width + local[distance:][same])
    if not made:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, n = np.unique(np.concatenate(made), return_counts=True)
    return names[code // width], names[code % width], n


def _grams(batches: Iterator[pa.RecordBatch], eligible: bytes | None, too_common: np.ndarray) -> Iterator[pa.RecordBatch]:
    bits = None if eligible is None else np.frombuffer(eligible, np.uint8)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out(parts):
        a, b, n = (np.concatenate(x) for x in zip(*parts))
        return _combine(a, b, n)

    def batch_of(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    for batch in batches:
        lists = batch.column(0)
        items = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        keep = ~np.isin(items, too_common)
        if bits is not None:
            slot = items.astype(np.uint64) % np.uint64(FILTER_BITS)
            keep &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        rows, items = rows[keep], items[keep]
        order = np.lexsort((items, rows))
        rows, items = rows[order], items[order]
        at = 0
        while at < len(rows):
            stop = min(at + BLOCK_ITEMS, len(rows))
            if stop < len(rows):
                whole = int(np.searchsorted(rows, rows[stop]))
                stop = whole if whole > at else int(np.searchsorted(rows, rows[at], side="right"))
            held.append(block_gram(rows[at:stop], items[at:stop]))
            size += len(held[-1][0])
            at = stop
            if size > HELD_PAIRS:
                merged = out(held)
                if len(merged[0]) > HELD_PAIRS // 2:
                    yield batch_of(*merged)
                    held, size = [], 0
                else:
                    held, size = [merged], len(merged[0])
    if held:
        yield batch_of(*out(held))


def _filter_bits(items: DataFrame) -> bytes:
    """A bit per hash slot held by some item: 2 MB whatever the number of items, ORed by words of 64."""
    slot = F.col("item").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    words = items.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def pair_counts(records: DataFrame, basket: str = "sample_id", lists: tuple[str, ...] = ("concepts", "keywords"), min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_baskets, expected, lift)`` of each pair of items held together, ``item_a < item_b``.

    With ``min_together`` or ``min_lift``, items that can't be part of such a pair are left out before the product
    (``n_ab ≤ n_a``; ``lift ≤ N / max(n_a, n_b)``): no pair asked for is lost.
    """
    ship(records.sparkSession)
    whole = F.concat(*[F.coalesce(F.col(x).cast("array<string>"), F.array().cast("array<string>")) for x in lists])
    named = records.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.array_distinct(F.transform(whole, compared)).alias("items"))
    entries = named.select("basket", F.explode("items").alias("name")).where("name is not null and name <> ''").select("basket", F.xxhash64("name").alias("item"), "name")
    baskets = cut(entries.groupBy("basket").agg(F.collect_set("item").alias("items")).select("items"))
    names = entries.groupBy("item").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    names = names.select("item", F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(F.raise_error(F.lit("two items share a 64-bit hash"))).alias("name"))
    counts = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = baskets.count()
    dictionary = cut(counts.join(names, "item"))

    eligible, too_common = None, np.zeros(0, np.int64)
    if min_together > 1:
        eligible = _filter_bits(dictionary.where(F.col("n") >= min_together))
    if min_lift > 1:
        # Each such item is in more than 1 / min_lift of the baskets: at most min_lift times the mean basket size of them.
        too_common = dictionary.where(F.col("n") * min_lift > total).select("item").toArrow().column(0).to_numpy().astype(np.int64)
    sums = baskets.mapInArrow(lambda batches: _grams(batches, eligible, too_common), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_together)
    left = dictionary.select(F.col("item").alias("a"), F.col("name").alias("name_a"), F.col("n").alias("first_n"))
    right = dictionary.select(F.col("item").alias("b"), F.col("name").alias("name_b"), F.col("n").alias("second_n"))
    both = sums.join(left, "a").join(right, "b")
    ordered = F.col("name_a") < F.col("name_b")
    expected = F.col("first_n").cast("double") * F.col("second_n") / F.lit(float(max(total, 1)))
    return both.where(F.col("n_ab") * F.lit(float(total)) >= F.lit(float(min_lift)) * F.col("first_n") * F.col("second_n")).select(
        F.when(ordered, F.col("name_a")).otherwise(F.col("name_b")).alias("item_a"), F.when(ordered, F.col("name_b")).otherwise(F.col("name_a")).alias("item_b"), "n_ab",
        F.when(ordered, F.col("first_n")).otherwise(F.col("second_n")).alias("n_a"), F.when(ordered, F.col("second_n")).otherwise(F.col("first_n")).alias("n_b"),
        F.lit(total).cast("long").alias("n_baskets"), F.round(expected, 6).alias("expected"), F.round(F.col("n_ab") / expected, 6).alias("lift"),
    )
