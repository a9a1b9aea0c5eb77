"""Sinks: snapshots, change log, graph and sample exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "hyperedges", "hyperedge_members", "calibration", "stats")


def csv_rows(samples: DataFrame) -> DataFrame:
    """Samples as flat rows for CSV: concepts joined by ``|``, the domain in lower case."""
    return samples.withColumn("concepts", F.array_join("concepts", "|")).withColumn("domain", F.lower(F.trim("domain")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_corpus(sentences: DataFrame, path: str, column: str = "sentence", least: int = 20) -> None:
    """One sentence a line, of at least ``least`` characters."""
    sentences.where(F.length(F.trim(column)) >= least).select(F.trim(column).alias("value")).write.mode("overwrite").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(kind, json)`` lines of a graph: a line of figures, live nodes with the first 32 numbers of their vectors and their view
    weights, pair edges with ``dst > src``, and the member pairs of hyperedges (at most 16 members each)."""
    live = nodes.where("type is null or type <> 'PRUNED'")
    weights = [F.transform("view_weights", lambda x: F.round(x, 4)).alias("view_weights")] if "view_weights" in nodes.columns else []
    figures = live.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("entropy_score"), 6).alias("mean_entropy")).withColumn("edges", edges.agg(F.count(F.lit(1))).scalar())
    s = figures.select(F.lit("stats").alias("kind"), F.to_json(F.struct("nodes", "edges", "mean_entropy")).alias("json"))
    n = live.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", "type", *weights, F.transform(F.slice("vec", 1, 32), lambda x: F.round(x.cast("double"), 4)).alias("vec"))).alias("json"))
    e = edges.where("dst > src").select(F.lit("edge"), F.to_json(F.struct("src", "dst", F.round("weight", 6).alias("weight"), "type")))
    a = members.where("pos <= 16").select("edge_id", F.col("pos").alias("pa"), F.col("node").alias("a"))
    b = members.where("pos <= 16").select("edge_id", F.col("pos").alias("pb"), F.col("node").alias("b"))
    h = a.join(b, "edge_id").where("pa < pb").select(F.lit("hyper"), F.to_json(F.struct("edge_id", "a", "b")))
    return s.union(n).union(e).union(h)


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> str:
    """Write a snapshot as Parquet tables under a version folder; the pointer file is written last, so a reader sees whole versions."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode("append").json(f"{path}/versions")
    return f"{path}/v{version}"


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest by default."""
    rows = spark.read.schema("version int, tables array<string>").json(f"{path}/versions")
    best = rows.where(F.lit(version is None) | (F.col("version") == (version or 0))).orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{path}/v{best['version']}/{name}") for name in best["tables"]}


def log_entries(changes: DataFrame) -> DataFrame:
    """Changes ``(seq, op, id_a, id_b, value, payload)`` with a checksum over all fields; payloads keep 256 characters."""
    cut = changes.withColumn("payload", F.substring("payload", 1, 256))
    return cut.withColumn("crc", checksum())


def checksum():
    return F.crc32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "op", "id_a", "id_b", "value", "payload")]))


def append_log(changes: DataFrame, path: str) -> None:
    log_entries(changes).write.mode("append").parquet(path)


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label)`` and edge weights ``(src, dst, weight)`` after all entries whose checksum holds, by the last entry of each key.

    ADD_NODE and PRUNE_NODE decide about a node, ADD_EDGE and UPDATE_WEIGHT about a weight; edges of pruned nodes are gone.
    """
    good = log.where(F.col("crc") == checksum())
    last = good.where("op in ('ADD_NODE', 'PRUNE_NODE')").groupBy(F.col("id_a").alias("id")).agg(F.max_by("op", "seq").alias("op"), F.max_by("payload", F.when(F.col("op") == "ADD_NODE", F.col("seq"))).alias("label"))
    nodes = last.where("op = 'ADD_NODE'").select("id", "label")
    weights = good.where("op in ('ADD_EDGE', 'UPDATE_WEIGHT')").groupBy(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).agg(F.max_by("value", "seq").alias("weight"))
    gone = last.where("op = 'PRUNE_NODE'").select("id")
    edges = weights.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "weight")
    return nodes, edges


#: Size of a log from which on it is folded into a snapshot.
LOG_BYTES = 512 * 1024 * 1024


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def log_size(spark: SparkSession, path: str) -> int:
    """Bytes of a log; 0 if there is none."""
    where, files = _files(spark, path)
    return int(files.getContentSummary(where).getLength()) if files.exists(where) else 0


def drop_log(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def folded(tables: dict[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """A snapshot's tables after the log: nodes and edges it adds or prunes, weights it sets; other columns and tables stay, new rows have nulls there.

    Nodes need ``id`` and ``label``, edges ``src``, ``dst`` and ``weight``.
    """
    good = log.where(F.col("crc") == checksum())
    added, weights = replay(log)
    gone = good.where("op in ('ADD_NODE', 'PRUNE_NODE')").groupBy(F.col("id_a").alias("id")).agg(F.max_by("op", "seq").alias("op")).where("op = 'PRUNE_NODE'").select("id")
    nodes = tables["nodes"].join(gone, "id", "left_anti")
    nodes = nodes.unionByName(added.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    held = tables.get("edges", weights.limit(0))
    old = held.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    changed = old.join(weights.withColumnRenamed("weight", "__new"), ["src", "dst"], "left").withColumn("weight", F.coalesce("__new", "weight")).drop("__new")
    edges = changed.unionByName(weights.join(old.select("src", "dst"), ["src", "dst"], "left_anti"), allowMissingColumns=True)
    return tables | {"nodes": nodes, "edges": edges}


def compact(spark: SparkSession, snapshot: str, log: str, version: int) -> str:
    """Fold the log into a new version of the snapshot, all its tables and columns kept, then drop the log; the first version is the log's alone."""
    where, files = _files(spark, f"{snapshot}/versions")
    entries = spark.read.parquet(log)
    if files.exists(where):
        tables = folded(load_snapshot(spark, snapshot), entries)
    else:
        nodes, edges = replay(entries)
        tables = {"nodes": nodes, "edges": edges}
    made = save_snapshot(tables, snapshot, version)
    drop_log(spark, log)
    return made


def rotate(spark: SparkSession, snapshot: str, log: str, version: int, limit: int = LOG_BYTES) -> str | None:
    """Compact the log if it has grown over ``limit`` bytes."""
    return compact(spark, snapshot, log, version) if log_size(spark, log) > limit else None


def recover(spark: SparkSession, snapshot: str, log: str) -> dict[str, DataFrame]:
    """The latest snapshot with what the log holds since."""
    tables = load_snapshot(spark, snapshot)
    return folded(tables, spark.read.parquet(log)) if log_size(spark, log) else tables


def training_history(steps: DataFrame) -> DataFrame:
    """The nine columns of a training history in order; ``steps`` holds them in any order, missing ones are null."""
    names = ("epoch", "sample", "loss", "confidence", "best_resonance", "accuracy", "nodes_added", "edges_added", "elapsed_ms")
    return steps.select(*[F.col(c) if c in steps.columns else F.lit(None).cast("double").alias(c) for c in names])


def samples_json(samples: DataFrame, domain: str, version: str = "4.0") -> DataFrame:
    """``json``: samples in one envelope for each document of at most 500 samples: version, domain, their number, and the samples in order."""
    fields = [c for c in ("query", "concepts", "causal_rule", "keywords", "domain", "lang", "difficulty", "source", "doc_id") if c in samples.columns]
    by = samples.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("samples"))
    return by.select("doc_id", F.to_json(F.struct(F.lit(version).alias("version"), F.lit(domain).alias("domain"), F.size("samples").alias("n_samples"), "samples")).alias("json"))
