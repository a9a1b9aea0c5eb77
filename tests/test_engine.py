"""Operators on small graphs, sources and sinks, streams, the facade, and the queries against SQL."""

import inspect
import math
import random
import zipfile
from collections import deque
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hyperspark.engine import Engine
from hyperspark.operators import activate, etl, graph, hyper, learn, memory, quality, rank, reason, topk
from hyperspark.plans.runtime import skew_join
from hyperspark.sources import sinks
from hyperspark.sources import text as sources
from hyperspark.streaming import ingest

EDGES = "src long, dst long, adj_idx int, weight double, type string, res double"


def test_spread_is_a_queue_search(spark):
    rng = random.Random(4)
    for trial in range(3):
        edges, place = [], {}
        for _ in range(60):
            a, b = rng.randrange(20), rng.randrange(20)
            if a != b and (a, b) not in {(e[0], e[1]) for e in edges}:
                place[a] = place.get(a, -1) + 1
                edges.append((a, b, place[a], rng.uniform(0.2, 1), rng.choice(["ASSOC", "INHIBITORY"]), rng.uniform(0, 1)))
        got = {(r["node"], r["depth"], round(r["spike"], 9)) for r in activate.spread(spark.createDataFrame([(1, 0, 1.0)], "q long, seed long, spike double"), spark.createDataFrame(edges, EDGES)).collect()}
        by = {}
        for e in edges:
            by.setdefault(e[0], []).append(e)
        seen, queue, want = {0}, deque([(0, 1.0, 0)]), set()
        while queue:
            node, spike, depth = queue.popleft()
            want.add((node, depth, round(spike, 9)))
            if spike < 0.03 or depth >= 12:
                continue
            for _, b, _, w, kind, res in sorted(by.get(node, []), key=lambda e: e[2]):
                s = 0.72 * spike * (0.45 * res + 0.45 * w + 0.1)
                s = abs(-0.3 * s) if kind == "INHIBITORY" else s
                if s >= 0.024 and b not in seen:
                    seen.add(b)
                    queue.append((b, s, depth + 1))
        assert got == want


def test_attention_sums_to_one_and_fires(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(3, 8)) + 2)], "node long, v array<double>")
    members = spark.createDataFrame([(1, i + 1, i) for i in range(3)], "edge_id long, pos int, node long")
    active = spark.createDataFrame([(0, 0.9), (1, 0.7), (2, 0.8)], "node long, activation double")
    edges = spark.createDataFrame([(1, 0.9)], "edge_id long, weight double")
    pairs = spark.createDataFrame([(a, b, 0, 0.8) for a in range(3) for b in range(3) if a != b], "src long, dst long, adj_idx int, weight double")
    got = hyper.attention(edges, members, active, vectors, pairs).collect()
    assert math.isclose(sum(r["attention"] for r in got), 1.0, abs_tol=1e-5) and all(r["fires"] for r in got) and got[0]["entropy"] > 0
    fired = spark.createDataFrame([(1, 0.8)], "edge_id long, activation double")
    out = {r["node"]: r["v"] for r in hyper.message_pass(fired, members, active, vectors).collect()}
    assert len(out) == 3 and all(math.isclose(np.linalg.norm(v), 1.0) for v in out.values())


def test_causal_paths_are_cheapest(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.uniform(0.05, 1), rng.choice(["CAUSES", "ASSOC", "INHIBITORY", "CONTRADICTS"])) for a in range(12) for b in rng.sample(range(12), 3) if a != b]
    got = {r["node"]: r["cost"] for r in reason.causal_paths(spark.createDataFrame([(0,)], "source long"), spark.createDataFrame(edges, "src long, dst long, weight double, type string")).collect()}
    best = {0: 0.0}
    for _ in range(15):
        for a, b, w, k in edges:
            if k != "CONTRADICTS" and a in best:
                c = best[a] + (1 - w) * {"CAUSES": 0.5, "INHIBITORY": 2.0}.get(k, 1.0)
                if c < best.get(b, 1e9) - 1e-12:
                    best[b] = c
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)


def test_causal_path_whole_goes_16_nodes_far(spark, sf):
    edges = graph.connect(spark.read.parquet(f"{sf}/edges.parquet"), spark.read.parquet(f"{sf}/nodes.parquet"))
    usable = [(r["src"], r["dst"], r["c"]) for r in edges.select("src", "dst", reason.causal_cost(F.col("weight"), F.col("type")).alias("c")).where("c is not null").collect()]
    got = {(r["source"], r["node"]): r["cost"] for r in entry.queries()["causal_path_whole"](spark, sf).collect()}
    want = {(s, s): 0.0 for s, _ in got}
    for _ in range(15):
        before = dict(want)
        for (s, node), cost in before.items():
            for a, b, c in usable:
                if a == node:
                    want[s, b] = min(want.get((s, b), 1e9), cost + c)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    bounded = {(r["source"], r["node"]): r["cost"] for r in entry.queries()["causal_path"](spark, sf).collect()}
    assert len(bounded) < len(got) or any(bounded[k] > got[k] + 1e-5 for k in bounded)


def test_connect_and_hyperedges(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    rows = [(0, 1, 0, 0.5, "A", None), (0, 1, 3, 2.0, "B", None), (1, 1, 0, 0.5, "A", None), (0, 9, 1, 0.5, "A", None), (2, 3, 0, None, "A", None)]
    got = graph.connect(spark.createDataFrame(rows, "src long, dst long, adj_idx int, weight double, type string, last_fired timestamp"), nodes).collect()
    assert [tuple(r)[:5] for r in got] == [(0, 1, 0, 1.0, "B")]
    long = spark.createDataFrame([(1, i % 20, 0.5) for i in range(40)] + [(2, 7, 0.3)], "e long, m long, w double")
    made = graph.hyperedges(long, "e", "m", F.col("w"), F.lit(False)).collect()
    assert len(made) == 1 and made[0]["members"] == list(range(16)) and made[0]["weight"] == 0.5


def test_pagerank_whole_runs_to_its_own_rule(spark, sf):
    nodes = spark.read.parquet(f"{sf}/nodes.parquet")
    edges = [tuple(r) for r in graph.connect(spark.read.parquet(f"{sf}/edges.parquet"), nodes).select("src", "dst", "weight").collect()]
    ids = [r["id"] for r in nodes.select("id").distinct().collect()]
    degree = {}
    for a, _, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    want = {i: 1 / len(ids) for i in ids}
    for _ in range(20):
        raw = {i: 0.15 / len(ids) for i in ids}
        for a, b, w in edges:
            raw[b] += 0.85 * want[a] * w / degree[a]
        fresh = {i: x / sum(raw.values()) for i, x in raw.items()}
        change, want = sum(abs(fresh[i] - want[i]) for i in ids), fresh
        if change < 1e-6:
            break
    got = {r["node"]: r["rank"] for r in entry.queries()["pagerank_whole"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - 1000 * want[i]) < 2e-6 for i in ids)


def test_spread_activation_goes_on_to_the_floor(spark, sf, tmp_path):
    nodes = spark.read.parquet(f"{sf}/nodes.parquet")
    one = nodes.where(F.col("id") == graph.valid_nodes(nodes).first()["id"]).limit(1)
    one.drop("id").crossJoin(spark.range(20, 34)).select(nodes.columns).write.parquet(str(tmp_path / "nodes.parquet"))
    edges = spark.read.parquet(f"{sf}/edges.parquet")
    row = edges.where("src is not null").limit(1).drop("src", "dst", "adj_idx", "weight", "type")
    chain = row.crossJoin(spark.range(20, 33).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("adj_idx"), F.lit(1.0).alias("weight"), F.lit("ASSOC").alias("type")))
    chain.select([F.col(c).cast(edges.schema[c].dataType) for c in edges.columns]).write.parquet(str(tmp_path / "edges.parquet"))
    found = {(r["node"], r["depth"]) for r in entry.queries()["spread_activation"](spark, str(tmp_path)).collect()}
    # .72 ** 11 is above the floor of an entry (.024), but below that of spreading (.03).
    assert found == {(20 + k, k) for k in range(12)}


def test_spectral_coords_has_all_axes(spark, sf, monkeypatch):
    asked = {}

    def coordinates(edges, degree, *args, **kwargs):
        bound = inspect.signature(whole).bind(edges, degree, *args, **kwargs)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return whole(edges, degree, asked["k"], 2)

    whole = rank.spectral_coordinates
    monkeypatch.setattr(rank, "spectral_coordinates", coordinates)
    found = entry.queries()["spectral_coords"](spark, sf).toPandas()
    assert (asked["k"], asked["rounds"]) == (8, 30) and set(found["axis"]) == set(range(8))
    wide = found.pivot(index="node", columns="axis", values="value").to_numpy()
    assert np.abs((wide**2).sum(0) - 1).max() < 1e-4


def test_add_nodes_numbers_once(spark):
    nodes = spark.createDataFrame([(0, "a"), (4, "b")], "id long, label string")
    got = graph.add_nodes(nodes, spark.createDataFrame([("b",), ("zeta",), ("zeta",), ("ab",), (" ",), (None,), ("za",)], "label string")).collect()
    assert sorted(tuple(r) for r in got) == [(0, "a"), (4, "b"), (5, "ab"), (6, "za"), (7, "zeta")]


def test_pagerank_and_spectrum(spark):
    hub = [(0, i, 0.8) for i in range(1, 6)] + [(i, i + 1, 0.5) for i in range(5, 11)]
    edges = spark.createDataFrame([(a, b, w) for a, b, w in hub] + [(b, a, w) for a, b, w in hub], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    ranks = {r["node"]: r for r in rank.pagerank(nodes, edges).collect()}
    assert math.isclose(sum(r["rank"] for r in ranks.values()), 1.0, abs_tol=1e-9) and ranks[0]["importance"] == 1.0
    a = np.zeros((12, 12))
    for x, y, w in hub:
        a[x, y] = a[y, x] = w
    assert abs(rank.spectral_norm(edges, nodes, 60) - np.abs(np.linalg.eigvalsh(a)).max()) < 1e-2
    degree = spark.createDataFrame([(i, float(d)) for i, d in enumerate(a.sum(1))], "node long, degree double")
    found = rank.spectral_coordinates(edges, degree, k=1, rounds=60).toPandas().sort_values("node")["value"].to_numpy()
    n = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    values, vectors = np.linalg.eigh(n)
    assert abs(abs(found @ vectors[:, -1]) - 1) < 1e-2
    assert rank.pagerank(nodes.limit(0), edges).count() == 0


def test_topk_join_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (None, [0.0] * 6), (501, [1.0])], "id long, v array<double>")
    got = {}
    for r in topk.topk_join(df.where("id % 20 = 0"), df, 3, block_rows=64).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q, near in got.items():
        if q < 200:
            s = x @ x[q]
            s[q] = -np.inf
            assert [i for _, i in sorted(near)] == np.lexsort((np.arange(200), -np.round(s, 9)))[:3].tolist()
    assert len([q for q in got if q < 200]) == 10


def test_calibration(spark):
    table = pd.DataFrame({"bucket": [0, 5, 6, 19], "positive": [10, 30, 5, 20], "n": [40, 40, 40, 20]})
    values = learn.isotonic(table)
    assert all(a <= b + 0.05 for a, b in zip(values[4:7], values[5:8])) and learn.isotonic(table.iloc[:1]) == [i / 20 for i in range(20)]
    got = spark.range(1).select(learn.calibrated(F.lit(0.525), [i / 20 for i in range(20)]).alias("x"), learn.pac_bayes_bound(F.lit(1.0), F.lit(5)).alias("b"), learn.evaluation_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(3)).alias("s")).first()
    assert math.isclose(got["x"], 0.525) and got["b"] == 0.5 and got["s"] == 1.0


def test_working_memory_fold(spark):
    rng = random.Random(5)
    rows = [(s, t, rng.randrange(40), round(rng.random(), 3)) for s in range(3) for t in range(30) for _ in range(5)]
    rows = list({r[:3]: r for r in rows}.values())
    got = {(r["session_id"], r["node"]): r["salience"] for r in memory.working_memory(spark.createDataFrame(rows, "session_id long, turn int, node long, salience double")).collect()}
    want = {}
    for s in range(3):
        held = {}
        for t in range(30):
            held = {n: v * 0.8 for n, v in held.items() if v * 0.8 > 0.05}
            for _, _, n, v in sorted((r for r in rows if r[0] == s and r[1] == t), key=lambda r: (-r[3], r[2])):
                if n in held:
                    held[n] = max(held[n], v)
                elif len(held) < 16:
                    held[n] = v
                else:
                    least = min(held, key=lambda x: (held[x], x))
                    if v > held[least]:
                        del held[least]
                        held[n] = v
        want |= {(s, n): v for n, v in held.items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_autoencoder_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 32))
    before, after = quality.train_autoencoder(x, 16, steps=0), quality.train_autoencoder(x, 16, steps=300)
    assert after.error(x).mean() < before.error(x).mean() and quality.train_autoencoder(x[:3]) is None
    model = quality.train_generator(x)
    made = quality.candidates(model, x.mean(0), 40)
    assert made.shape == (32, 32) and np.allclose(np.linalg.norm(made, axis=1), 1) and quality.train_generator(x[:5]) is None


def test_conversion_edge_cases(spark):
    text = "Heat causes expansion. The heat of metal causes expansion in metal bars! Cold metal shrinks."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n "), (5, "!!"), (6, text)], "doc_id long, text string").withColumn("term", F.lit("x"))
    c = etl.concepts(df.drop("term"), "doc_id", "text")
    got = {r["term"]: (r["tf"], r["df"]) for r in c.where("doc_id = 1").collect()}
    assert got["heat"] == (2, 2) and got["metal"] == (3, 2) and "the" not in got
    samples = etl.convert(df.drop("term"), "doc_id", "text").collect()
    assert {r["doc_id"] for r in samples} == {1, 6} and any(r["causal_rule"] == "heat → causes → expansion" for r in samples)
    assert etl.convert(df.drop("term").limit(0), "doc_id", "text").count() == 0


def test_snapshot_and_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "ADD_NODE", 1, None, None, "one"), (2, "ADD_NODE", 2, None, None, "two"), (3, "ADD_EDGE", 1, 2, 0.5, "CAUSES"), (4, "UPDATE_WEIGHT", 1, 2, 0.7, None), (5, "UPDATE_WEIGHT", 1, 2, 0.9, None), (6, "ADD_EDGE", 2, 3, 0.4, ""), (7, "ADD_NODE", 3, None, None, "three"), (8, "PRUNE_NODE", 3, None, None, None)], "seq long, op string, id_a long, id_b long, value double, payload string")
    sinks.append_log(log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log")).withColumn("crc", F.when(F.col("seq") == 5, F.lit(0)).otherwise(F.col("crc")))
    nodes, edges = sinks.replay(stored)
    assert sorted(map(tuple, nodes.collect())) == [(1, "one"), (2, "two")] and list(map(tuple, edges.collect())) == [(1, 2, 0.7)]
    sinks.save_snapshot({"nodes": nodes}, str(tmp_path / "snap"), 1)
    sinks.compact(spark, str(tmp_path / "snap"), str(tmp_path / "log"), 2)
    assert sinks.load_snapshot(spark, str(tmp_path / "snap"))["edges"].count() == 1 and set(sinks.load_snapshot(spark, str(tmp_path / "snap"), 1)) == {"nodes"}


def test_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("word 3 4\nbad 1\nworse x y\n")
    got = sources.parse_word_vectors(spark.read.text(str(tmp_path / "v.txt")), 2).collect()
    assert [(r["word"], r["v"]) for r in got] == [("word", [0.6, 0.8])]
    (tmp_path / "v.bin").write_bytes(b"2 3\n" + b"a " + np.array([3, 4, 0], "<f4").tobytes() + b"bb " + np.array([0, 0, 2], "<f4").tobytes())
    got = sources.read_binary_vectors(spark, str(tmp_path / "v.bin"), 3).collect()
    assert [(r["word"], np.round(r["v"], 6).tolist()) for r in got] == [("a", [0.6, 0.8, 0.0]), ("bb", [0.0, 0.0, 1.0])]
    (tmp_path / "merges.txt").write_text("#version\na b\nab c\n")
    assert sorted(map(tuple, sources.read_merges(spark, str(tmp_path / "merges.txt")).collect())) == [(0, "a", "b"), (1, "ab", "c")]
    (tmp_path / "vocab.json").write_text('{"a": 1, "b": 2}')
    assert dict(map(tuple, sources.read_vocabulary(spark, str(tmp_path / "vocab.json")).collect())) == {"a": 1, "b": 2}
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "a.html").write_text("<p>hello <b>there</b></p><script>no</script>")
    (docs / "b.md").write_text("# Title\n- **bold**")
    (docs / "c.bin").write_text("skipped")
    with zipfile.ZipFile(docs / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:t>from word</w:t>")
    with zipfile.ZipFile(docs / "e.epub", "w") as z:
        z.writestr("x.xhtml", "<p>from a book</p>")
    got = {Path(r["path"]).name: " ".join(r["text"].split()) for r in sources.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got == {"a.html": "hello there", "b.md": "Title bold", "d.docx": "from word", "e.epub": "from a book"}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text("a long enough line\nshort\n")
    assert sources.read_lines(spark, str(tmp_path / "lines")).count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(f"template number {'one' if i % 2 else 'two'} about gravity and motion" for i in range(400)))
    seen = []
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), progress=lambda n, rows: seen.append(rows)).awaitTermination()
    concepts, links = ingest.ingested(spark, str(tmp_path / "out"))
    assert concepts.count() == 2 and links.count() == 1 and seen == [2]


def test_engine_end_to_end(spark, tmp_path):
    labels = ["newton second law of motion force", "force equals mass times acceleration", "photosynthesis in green plants", "quantum entanglement of particles"]
    engine = Engine.from_labels(spark, labels, [(0, 1, 0.9, "CAUSES"), (1, 2, 0.2, "ASSOC")])
    rows = {r["q"]: r for r in engine.query(spark.createDataFrame([(1, "what is newton second law of motion"), (2, ""), (3, None)], "q long, text string")).collect()}
    r = rows[1]
    assert 0 <= r["lb"] <= r["confidence"] <= r["ub"] <= 1 and r["n_activated"] >= 2 and labels[0] in r["top_concepts"]
    assert rows[2]["confidence"] == 0.0 and rows[3]["confidence"] == 0.0
    assert engine.causal(0, 1).count() == 1 and engine.health() == {"status": "ok"}
    before = engine.stats()["n_nodes"]
    assert engine.ingest(spark.createDataFrame([("gravity bends light near stars",), (None,)], "text string")) > before
    engine.feedback(spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8)], "q long, node long, activation double"), spark.createDataFrame([(1, 0.9)], "q long, reward double"))
    assert engine.edges.where("src = 0 and dst = 1").first()["weight"] > 0.9
    assert engine.maintain(100) == ["pagerank", "prune"]
    engine.save(str(tmp_path / "graph"))
    assert Engine.load(spark, str(tmp_path / "graph")).stats()["n_edges"] == engine.stats()["n_edges"]


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}" if i % 5 else None) for i in range(2000)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(repr, map(tuple, left.join(right, "k", how).select("i").collect())))
        assert sorted(map(repr, map(tuple, skew_join(left, right, "k", how).select("i").collect()))) == want


def test_entry(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def canonical(rows):
    out = []
    for row in rows:
        values = [round(x, 5) + 0.0 if isinstance(x, float) else x for x in row]
        out.append(repr([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in values]))
    return sorted(out)


def test_causal_costs_are_those_of_paths_without_a_shuffle_of_pairs(spark, monkeypatch):
    def costs(df):
        return sorted(tuple(r) for r in df.select("source", "node", "cost").collect())

    rng = random.Random(5)
    kinds = ["CAUSES", "EDGE_CAUSAL", "INHIBITORY", "CONTRADICTS", "RELATED"]
    links = [(rng.randrange(60), rng.randrange(60), round(rng.random(), 2), rng.choice(kinds)) for _ in range(220)] + [(70 + i, 71 + i, 0.5, "CAUSES") for i in range(20)] + [(1, 2, None, "CAUSES")]
    edges = spark.createDataFrame(links, "src long, dst long, weight double, type string")
    starts = spark.createDataFrame([(i,) for i in (0, 7, 41, 70, 89, 90, 500, -1)], "source long")
    for most in (2, 16):
        want = costs(reason.causal_paths(starts, edges, most))
        assert costs(reason.causal_costs(starts, edges, most)) == want
    monkeypatch.setattr(reason, "HELD_COSTS", 500)
    monkeypatch.setattr(reason, "BATCH_ROWS", 7)
    assert costs(reason.causal_costs(starts, edges)) == want
    # Costs come from a graph that is sent, not from rounds of joins; a larger graph is joined.
    assert "Join" not in reason.causal_costs(starts, edges)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(reason, "SENT_EDGES", 10)
    assert costs(reason.causal_costs(starts, edges)) == want
    assert costs(reason.causal_costs(starts, edges.limit(0))) == sorted((r[0], r[0], 0.0) for r in starts.collect())


@pytest.mark.parametrize("name", sorted(n for m in entry.CORE for n in m.QUERIES))
def test_query_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    plain = [tuple(float(x) if hasattr(x, "quantize") else x for x in r) for r in want]
    assert canonical(rows) == canonical(plain)


# --- samples by hash


def test_hash_sample_is_bounded_and_the_same_in_any_layout(spark):
    from hyperspark.plans.runtime import below_share, hash_sample

    df = spark.range(4000).selectExpr("cast(id % 1000 as string) as k", "id as v").union(spark.sql("select cast(null as string), 1L"))
    once = {tuple(r) for r in hash_sample(df, "k", 50, seed=3).collect()}
    assert len(once) == 50 and all(v == int(k) for k, v in once)
    assert once == {tuple(r) for r in hash_sample(df.repartition(7, "v"), "k", 50, seed=3).collect()}
    assert hash_sample(df.where("k = '1'"), "k", 50).count() == 1 and hash_sample(df.limit(0), "k", 50).count() == 0
    # At 10¹¹ rows a sample of 6,000 has a share of 6e-8; so has it here, of a hash with 64 bits.
    assert abs(spark.range(50_000_000).where(below_share(6000 / 1e11, "id")).count() - 3) <= 7
    assert spark.range(1000).where(below_share(1.0, "id")).count() == 1000
