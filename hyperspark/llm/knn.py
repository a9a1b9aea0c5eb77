"""The most similar vectors of every vector, by learned partitions.

On a bounded sample a neighbour graph is made exactly and cut into balanced parts (recursive median splits,
then moves to the part most neighbours are in, within a capacity), and a small softmax classifier learns from a
vector the parts its neighbours lie in. Each part is cut again in the same way, into cells, with a classifier of
its own, from a fresh sample of the part's vectors. Every vector of the collection is routed to the cells that
are most probable by both levels, those of several parts competing; this is so at every size, only the numbers
of parts and cells grow, both as the square root of the collection. Vectors that share a cell are compared
exactly, block by block, and the best of all cells are kept. A cell that would hold too many vectors is spread
over tasks, one for each pair of its blocks, so all of it is compared.

Exact copies are one signature: they are routed and compared once and expanded at the end, so a large group
of copies costs no more than one vector.

Defined results: vectors that are null, of another length, not finite or all zero are replaced by their views
if these fit, else left out; ties are broken by the smaller id; a vector has fewer neighbours than ``k`` if
its cells hold fewer; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import below_share, cut, hash_sample, ship, skew_join

#: Rows of the sample the parts are learned from (a bound), vectors a cell should hold, cells a vector is routed to,
#: most cells (50 MB of classifiers), and sampled vectors for each cell.
SAMPLE_ROWS = 4096
PART_ROWS = 400
PROBES = 3
MAX_CELLS = 65_536
CELL_SAMPLE = 16
#: Rows of a block of a cell that is spread over tasks.
TASK_ROWS = 3600
TRAIN_SEED = 7
#: Precision in which unit vectors travel: 1 / SCALE, an error of a cosine of about 1e-5.
SCALE = 32_767
BLOCK = 1024
#: Bits of the number of a block in the key of a task.
BLOCK_BITS = 20
#: Up to so many ids are broadcast (8 MB), more are shuffled.
BROADCAST_IDS = 1_000_000


def usable(vec: list | np.ndarray | None, views: list | None, dim: int, n_views: int) -> np.ndarray | None:
    """The unit vector of a node: ``vec``, or its views end to end; None if neither can be used."""
    for values in (vec, None if views is None or len(views) != n_views or any(v is None or len(v) * n_views != dim for v in views) else [x for v in views for x in v]):
        if values is None or len(values) != dim:
            continue
        try:
            out = np.asarray(values, np.float64)
        except (TypeError, ValueError):
            continue
        if np.isfinite(out).all() and out.any():
            return (out / np.linalg.norm(out)).astype(np.float32)
    return None


def _unit_rows(batch: pa.RecordBatch, dim: int, n_views: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of ``(id, vec, views)``."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    vec, views = batch.column(1), batch.column(2)
    lengths = np.asarray(vec.value_lengths().fill_null(-1))
    right = lengths == dim
    flat = vec.filter(pa.array(right)).flatten()
    fast = np.zeros((int(right.sum()), dim))
    if len(fast):
        fast = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    fine = np.isfinite(fast).all(axis=1) & fast.any(axis=1)
    out = np.zeros((len(ids), dim), np.float32)
    good = np.zeros(len(ids), bool)
    rows = np.flatnonzero(right)
    out[rows[fine]] = fast[fine] / np.linalg.norm(fast[fine], axis=1, keepdims=True)
    good[rows[fine]] = True
    for i in np.flatnonzero(~good):
        one = usable(None, views[int(i)].as_py(), dim, n_views)
        if one is not None:
            out[i], good[i] = one, True
    return ids[good], out[good]


def pack(units: np.ndarray) -> list[bytes]:
    codes = np.rint(units * SCALE).astype("<i2")
    raw, width = codes.tobytes(), codes.shape[1] * 2
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def unpack(blobs, dim: int) -> np.ndarray:
    units = np.frombuffer(b"".join(blobs), "<i2").reshape(-1, dim).astype(np.float32)
    return units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)


def signatures(nodes: DataFrame, id_column: str, vector: str, views: str, dim: int, n_views: int) -> DataFrame:
    """``(id, code)``: the packed unit vector of every usable row."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = _unit_rows(batch, dim, n_views)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pack(units), pa.binary())], ["id", "code"])

    return nodes.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), F.col(vector).cast("array<float>"), F.col(views).cast("array<array<float>>")).mapInArrow(run, "id bigint, code binary")


def neighbour_graph(units: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours of each sampled vector."""
    n = len(units)
    k = min(k, n - 1)
    out = np.zeros((n, max(k, 0)), np.int32)
    for at in range(0, n if k > 0 else 0, BLOCK):
        sims = units[at : at + BLOCK] @ units.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        out[at : at + BLOCK] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(units: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 6) -> np.ndarray:
    """A cut of the neighbour graph into ``parts`` parts of nearly the same size."""
    n, rng = len(units), np.random.default_rng(TRAIN_SEED)
    label = np.zeros(n, np.int64)
    queue = [(np.arange(n), 0, parts)]
    while queue:
        rows, first, count = queue.pop()
        if count <= 1 or len(rows) < 2:
            label[rows] = first
            continue
        own = units[rows] - units[rows].mean(0)
        direction = rng.normal(size=own.shape[1])
        for _ in range(4):  # a few power steps towards the main direction
            direction = own.T @ (own @ direction)
            direction /= np.linalg.norm(direction) + 1e-12
        low = count // 2
        order = np.argsort(own @ direction, kind="stable")
        middle = len(rows) * low // count
        queue += [(rows[order[:middle]], first, low), (rows[order[middle:]], first + low, count - low)]
    if graph.shape[1]:
        capacity = max(1, int(np.ceil(1.15 * n / parts)))
        sizes = np.bincount(label, minlength=parts)
        for _ in range(sweeps):
            moved = 0
            for i in rng.permutation(n):
                near = np.bincount(label[graph[i]], minlength=1)
                to = int(near.argmax())
                a = label[i]
                if to != a and near[to] > (near[a] if a < len(near) else 0) and sizes[to] < capacity:
                    label[i] = to
                    sizes[a] -= 1
                    sizes[to] += 1
                    moved += 1
            if moved < n // 200:
                break
    return label


@dataclass
class Level:
    """A softmax classifier of vectors: ``x @ weights + bias``."""

    weights: np.ndarray
    bias: np.ndarray

    def scores(self, units: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes."""
        found = units @ self.weights.astype(np.float32) + self.bias
        found -= found.max(1, keepdims=True)
        return found - np.log(np.exp(found).sum(1, keepdims=True))


@dataclass
class Router:
    """Two levels of learned parts; ``cells`` has each part's classifier, its cells numbered from ``first`` on.

    ``blocks`` has the number of blocks of cells that are spread over tasks.
    """

    parts: Level
    cells: list[Level]
    first: np.ndarray
    blocks: dict[int, int]

    def route(self, units: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable cells of each vector (-1 where there are fewer): those of the most probable parts compete together."""
        of_part = self.parts.scores(units)
        wide = min(probes, of_part.shape[1])
        chosen = np.argpartition(-of_part, wide - 1, axis=1)[:, :wide]
        cells = np.full((len(units), wide * probes), -1, np.int64)
        value = np.full((len(units), wide * probes), -np.inf, np.float32)
        order = np.argsort(chosen, axis=None, kind="stable")
        part, row, column = chosen.ravel()[order], order // wide, order % wide
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        for start, stop in zip(edges[:-1], edges[1:]):
            p, rows = int(part[start]), row[start:stop]
            own = self.cells[p].scores(units[rows]) + of_part[rows, p][:, None]
            few = min(probes, own.shape[1])
            best = np.argpartition(-own, few - 1, axis=1)[:, :few]
            at = column[start:stop][:, None] * probes + np.arange(few)
            cells[rows[:, None], at] = self.first[p] + best
            value[rows[:, None], at] = np.take_along_axis(own, best, 1)
        best = np.argpartition(-value, probes - 1, axis=1)[:, :probes] if value.shape[1] > probes else np.tile(np.arange(value.shape[1]), (len(units), 1))
        return np.take_along_axis(cells, best, 1)

    def tasks(self, ids: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, key)`` of the tasks of each row: its cells, or all pairs of blocks of a cell that hold the row's block."""
        row, cell = np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel()
        row, cell = row[cell >= 0], cell[cell >= 0]
        count = np.ones(len(cell), np.int64)
        if self.blocks:
            sizes = np.ones(int(self.first[-1]), np.int64)
            sizes[list(self.blocks)] = list(self.blocks.values())
            count = sizes[cell]
        own = np.repeat(block_of(ids[row], count), count)
        other = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        row, cell = np.repeat(row, count), np.repeat(cell, count)
        return row, cell << 2 * BLOCK_BITS | np.minimum(own, other) << BLOCK_BITS | np.maximum(own, other)


def block_of(ids: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % count


def blocks_of(rows: float) -> int:
    """Blocks of a cell of so many rows: 1 up to twice a block's rows, so that no task holds more."""
    return 1 if rows <= 2 * TASK_ROWS else min(int(np.ceil(rows / TASK_ROWS)), (1 << BLOCK_BITS) - 1)


def train_level(units: np.ndarray, parts: int, epochs: int = 8) -> Level:
    """Learn balanced parts of the neighbour graph of sampled unit vectors, and the classifier that finds them."""
    n, dim = units.shape
    parts = max(1, min(parts, n // 4))
    if parts == 1:
        return Level(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(units, 10)
    label = balanced_parts(units, graph, parts)
    target = np.zeros((n, parts), np.float32)
    target[np.arange(n), label] += 1.0
    for column in range(graph.shape[1]):
        np.add.at(target, (np.arange(n), label[graph[:, column]]), 1.0 / graph.shape[1])
    target /= target.sum(1, keepdims=True)
    sizes = np.maximum(np.bincount(label, minlength=parts), 1)
    centres = np.zeros((parts, dim), np.float32)
    np.add.at(centres, label, units)
    weights = (centres / sizes[:, None]).T.astype(np.float32) * 12.0
    bias = np.zeros(parts, np.float32)
    rng, rate = np.random.default_rng(TRAIN_SEED), 2.0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            scores = units[rows] @ weights + bias
            scores -= scores.max(1, keepdims=True)
            np.exp(scores, out=scores)
            scores /= scores.sum(1, keepdims=True)
            slope = (scores - target[rows]) / len(rows)
            weights -= rate / (1 + epoch) * (units[rows].T @ slope) * parts**0.5
            bias -= 0.1 * rate / (1 + epoch) * slope.sum(0)
    return Level(weights, bias)


def train_router(coded: DataFrame, total: int, dim: int, probes: int, part_rows: int, sample_rows: int) -> Router:
    """Learn parts on the driver from at most ``sample_rows`` vectors, and each part's cells in a task of its own.

    Cells have ``part_rows`` vectors, up to ``MAX_CELLS`` of them; a part's cells are learned from its own vectors of
    a sample of ``CELL_SAMPLE`` for each cell. Samples are of different codes, so many copies count as one.
    """
    spark = coded.sparkSession
    wanted = int(min(MAX_CELLS, max(1, round(total / part_rows))))
    codes = coded.select("code")
    first = hash_sample(codes, "code", sample_rows, seed=3).toArrow()
    units = unpack([x.as_py() for x in first.column(0)], dim)
    parts = train_level(units, max(1, int(np.ceil(wanted**0.5))))
    n_parts = parts.bias.size
    per_part = -(-wanted // n_parts)
    coarse = spark.sparkContext.broadcast(parts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            if blobs:
                # Vectors near a border belong to both sides, as they will be looked for there.
                scores = coarse.value.scores(unpack(blobs, dim))
                near = np.argpartition(-scores, min(1, n_parts - 1), axis=1)[:, :2].ravel() if n_parts > 1 else np.zeros(len(blobs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0).take(pa.array(np.repeat(np.arange(len(blobs)), len(near) // len(blobs))))], ["part", "code"])

    def learn(frame: pa.Table) -> pa.Table:
        own = np.unique(unpack([x.as_py() for x in frame.column("code")], dim), axis=0)
        level = train_level(own, per_part)
        return pa.table([frame.column("part").slice(0, 1), pa.array([level.weights.astype(np.float16).tobytes()], pa.binary()), pa.array([level.bias.astype(np.float32).tobytes()], pa.binary())], names=["part", "weights", "bias"])

    sample_share = min(1.0, max(sample_rows, CELL_SAMPLE * wanted) / total)
    sample = cut(codes.where(below_share(sample_share, "code", seed=4)).distinct())
    blank = Level(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))
    cells = [blank] * n_parts
    if per_part > 1:
        for r in sample.mapInArrow(placed, "part int, code binary").groupBy("part").applyInArrow(learn, "part int, weights binary, bias binary").collect():
            bias = np.frombuffer(r["bias"], np.float32)
            cells[r["part"]] = Level(np.frombuffer(r["weights"], np.float16).reshape(dim, len(bias)), bias)
    router = Router(parts, cells, np.concatenate([[0], np.cumsum([c.bias.size for c in cells])]), {})
    model = spark.sparkContext.broadcast(router)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            if blobs:
                found = model.value.route(unpack(blobs, dim), probes)
                cell, n = np.unique(found[found >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    # Cells that would hold far more than the rest are compared in pairs of blocks; their sizes come from the sample.
    sizes = sample.mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    router.blocks |= {r["cell"]: count for r in sizes if (count := blocks_of(r["n"] / sample_share)) > 1}
    return router


def top_of_part(ids: np.ndarray, units: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, neighbour, similarity)`` of the ``k`` nearest within one part, of those with at least ``least``."""
    return top_between(ids, units, ids, units, k, least)


def top_between(ids: np.ndarray, units: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the rows ``ids`` among the rows ``base_ids``, which are the same rows or all others."""
    same = base_ids is ids
    order = np.argsort(ids, kind="stable")
    ids, units = ids[order], units[order]
    order = np.argsort(base_ids, kind="stable")
    base_ids, base = base_ids[order], base[order]
    found = []
    for at in range(0, len(ids), BLOCK):
        sims = units[at : at + BLOCK] @ base.T
        here = np.arange(len(sims))
        if same:
            sims[here, at + here] = -2
        take = min(k, len(base_ids) - same)
        if take < 1:
            break
        if least > -1:
            rows, columns = np.nonzero(sims >= least)
            values = sims[rows, columns]
            rank = np.lexsort((columns, -values, rows))
            rows, columns, values = rows[rank], columns[rank], values[rank]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < take
            rows, columns, values = rows[keep], columns[keep], values[keep]
        else:
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            rows, columns = np.repeat(here, take), best.ravel()
            values = sims[rows, columns]
        found.append((ids[at + rows], base_ids[columns], values))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(
    nodes: DataFrame, k: int = 5, id_column: str = "id", vector: str = "vec", views: str = "views", dim: int = 384, n_views: int = 3,
    least: float = -1.0, probes: int = PROBES, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: up to ``k`` most similar other rows of every usable row, from ``least`` on."""
    spark = nodes.sparkSession
    coded = signatures(nodes, id_column, vector, views, dim, n_views)
    # A node listed twice is one node; nodes with the same code are copies of the one with the smallest id.
    light = cut(coded.select("id", F.xxhash64("code").alias("h")))
    sizes = cut(light.groupBy("h").agg(F.min("id").alias("sig"), F.count(F.lit(1)).alias("rows")))
    total = sizes.count()
    if total == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity float, rank int")
    copies = cut(skew_join(light, sizes.where("rows > 1").select("h", "sig"), "h", salt_by="id").select("sig", "id").distinct())
    router = train_router(coded, total, dim, probes, part_rows, sample_rows)
    model = spark.sparkContext.broadcast(router)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            if not blobs:
                continue
            rows, keys = model.value.tasks(batch.column(0).to_numpy(), model.value.route(unpack(blobs, dim), probes))
            for at in range(0, len(rows), len(blobs) * probes):  # rows of spread parts are repeated often
                some = pa.array(rows[at : at + len(blobs) * probes])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + len(some)]), batch.column(0).take(some), batch.column(1).take(some)], ["part", "id", "code"])

    # Of copies only the one with the smallest id is compared; vectors are shuffled for that only if the others are many.
    others = copies.where("id <> sig").select("id")
    kept = coded.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "id", "left_anti")

    def within(frame: pa.Table) -> pa.Table:
        ids = frame.column("id").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        units = unpack([frame.column("code")[int(i)].as_py() for i in first], dim)
        key = frame.column("part")[0].as_py()
        low, high = key >> BLOCK_BITS & (1 << BLOCK_BITS) - 1, key & (1 << BLOCK_BITS) - 1
        if low == high:
            found = top_of_part(ids, units, k, least)
        else:
            a = block_of(ids, model.value.blocks[key >> 2 * BLOCK_BITS]) == low
            found = [np.concatenate(x) for x in zip(top_between(ids[a], units[a], ids[~a], units[~a], k, least), top_between(ids[~a], units[~a], ids[a], units[a], k, least))]
        return pa.table([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.float32))], names=["id", "neighbour", "similarity"])

    # Cells differ in size; twice the partitions even their tasks out.
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = kept.mapInArrow(routed, "part bigint, id bigint, code binary").repartition(tasks, "part").groupBy("part").applyInArrow(within, "id bigint, neighbour bigint, similarity float")
    # A row has at most ``k`` neighbours of each of its tasks: its parts, or the blocks of those that are spread.
    merged = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = merged.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "neighbour"))), 1, k).alias("near"))
    return _expanded(cut(best), copies, k)


def _expanded(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Give every copy its neighbours: the other copies first, then the neighbours of its signature with their copies."""
    from pyspark.sql import Window

    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("sig").orderBy("id"))).where(F.col("n") <= k + 1)
    few = first.groupBy("sig").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = best.select(F.col("id").alias("sig"), F.explode("near").alias("e")).select("sig", F.col("e.neighbour").alias("other"), (-F.col("e.d")).alias("similarity"))
    widened = skew_join(pairs, few.select(F.col("sig").alias("other"), "ids"), "other", "left", salt_by="sig").select("sig", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"), "similarity")
    own = few.where(F.size("ids") > 1).select("sig", F.explode("ids").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
    by_signature = cut(widened.union(own))
    # Many copies of one signature: its few neighbours are joined to the copies spread over tasks.
    of_copies = skew_join(copies, by_signature, "sig", salt_by="id").select("id", "neighbour", "similarity")
    of_others = by_signature.join(copies.select("sig").distinct(), "sig", "left_anti").select(F.col("sig").alias("id"), "neighbour", "similarity")
    owned = of_copies.union(of_others).where(F.col("id") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return owned.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_nearest(ids: np.ndarray, units: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force for the given query ids, to measure recall."""
    place = {int(x): i for i, x in enumerate(ids)}
    out = {}
    for q in queries:
        sims = units @ units[place[int(q)]]
        order = np.lexsort((ids, -sims))
        out[int(q)] = [(int(ids[i]), float(sims[i])) for i in order if ids[i] != q][:k]
    return out
