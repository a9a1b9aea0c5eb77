"""Small cases of the steps that advance the graph, of the engine's pipeline and of storage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperspark.config import EngineConfig
from hyperspark.engine import Engine, register
from hyperspark.functions import text as T
from hyperspark.operators import hyper, learn, quality, reason, steps
from hyperspark.sources import knowledge, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_prune_is_applied_with_blended_targets(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0], 2.0), (2, [0.0, 1.0], 1.0), (3, [0.0, 1.0], None), (4, [1.0, 0.0], 0.0)], "id long, v array<double>, usage double")
    actions = spark.createDataFrame([(1, "keep", None), (2, "merge", 1), (3, "merge", 1), (4, "drop", None)], "id long, action string, into long")
    out = {r["id"]: r for r in steps.apply_prune(nodes, actions).collect()}
    want = np.array([0.88**2, 0.12 * 0.88 + 0.12])
    assert np.allclose(out[1]["v"], want / np.linalg.norm(want)) and out[1]["usage"] == pytest.approx(2.35)
    assert [out[i]["pruned"] for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert steps.apply_prune(nodes.limit(0), actions.limit(0)).count() == 0


def test_node_feedback_adds_entries_and_promotes(spark):
    nodes = spark.createDataFrame([(1, 0.69, 0.0, False), (2, None, None, None), (3, 0.9, 1.0, True)], "id long, entropy_score double, usage_count double, in_fast_ring boolean")
    feedback = spark.createDataFrame([(1, 1.0, None, [1, 1, 3]), (2, -5.0, None, [2, None]), (3, None, None, [1]), (4, float("nan"), None, [1]), (5, 0.5, None, None)], "query_id long, reward double, ts timestamp, active_nodes array<long>")
    out = {r["id"]: r for r in steps.node_feedback(nodes, feedback).collect()}
    assert out[1]["entropy"] == pytest.approx(0.75) and out[1]["usage"] == 2.0 and out[1]["promoted"]
    assert out[2]["entropy"] == 0.0 and not out[2]["promoted"] and not out[3]["promoted"]


def test_session_vectors_fold_in_order(spark):
    turns = spark.createDataFrame([("a", 2, [0.0, 1.0]), ("a", 1, [2.0, 0.0]), ("b", 1, [0.0, 3.0]), (None, 1, [1.0, 0.0]), ("a", 3, None)], "session_id string, turn int, sig array<double>")
    out = {(r[0], r[1]): np.array(r[2]) for r in steps.session_vectors(turns).collect()}
    assert set(out) == {("a", 1), ("a", 2), ("b", 1)} and np.allclose(out["a", 1], [1, 0]) and np.allclose(out["b", 1], [0, 1])
    assert np.allclose(out["a", 2], np.array([0.85, 0.15]) / np.hypot(0.85, 0.15))


def test_vector_sums_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = spark.range(500).selectExpr("id % 3 as k", "array(double(id), 1D) as v", "0.5D as w").union(spark.sql("select null, array(1D, 1D), 1D")).union(spark.sql("select 1L, null, 1D"))
        out = {r["k"]: r["s"] for r in hyper.vector_sums(data, "k", "v", "w", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {k: [0.5 * sum(range(k, 500, 3)), 0.5 * len(range(k, 500, 3))] for k in range(3)}
    assert hyper.vector_sums(data.limit(0), "k", "v", "w", "s").count() == 0


def test_new_vectors_meet_known_ones_and_each_other(spark):
    known = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, v array<double>")
    fresh = spark.createDataFrame([(10, [0.99, 0.141, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [0.0, 0.999, 0.045]), (13, [0.0, 0.0, 1.0])], "id long, v array<double>")
    assert rows(steps.reused(fresh, known)) == [(10, 1), (11, 11), (12, 11), (13, 13)]


def test_growth_of_synonyms_and_answers(spark):
    terms = spark.createDataFrame([("Market",), (None,), ("x",)], "label string")
    lexicon = spark.createDataFrame([("market", ["bazaar", "Market", None, ""])], "word string, synonyms array<string>")
    assert rows(steps.synonym_links(terms, lexicon)) == [("market", "bazaar", 0.78, "SYNONYM")]
    answers = spark.createDataFrame([(1, "The copper bridge holds the copper bridge over water", 0.9, True), (2, "other words entirely", 0.4, True), (3, "other words", 0.9, False), (4, None, 0.9, True)], "q long, response string, confidence double, grounded boolean")
    assert rows(steps.answer_terms(answers, spark.createDataFrame([("Water",)], "label string")).select("place", "label", F.coalesce("before", F.lit("-")))) == [(1, "copper", "-"), (2, "bridge", "copper"), (3, "holds", "bridge"), (4, "over", "holds")]


def test_bytes_and_names(spark):
    raw = [(b"plain", True), ("café".encode(), True), (b"\xff\xfe", False), (b"\x80", False), (b"a\x00\xff", True), ("héllo".encode()[:2], False), (b"\xc0\x80", False), (None, False), (b"", True)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(raw)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(T.valid_utf8(F.col("b"))).collect()] == [y for _, y in raw]
    names = spark.createDataFrame([("EDGE_CAUSES",), ("part_of",), (None,), ("odd",)], "k string").select(T.edge_type_name(F.col("k"))).collect()
    assert [r[0] for r in names] == ["leads to", "part of", "unknown", "unknown"]
    forms = spark.createDataFrame([("ﬁne  ｔext",), ("plain",), (None,)], "t string").select(T.normalise_form(F.col("t"))).collect()
    assert [r[0] for r in forms] == ["fine text", "plain", None]


def test_causal_rule_keeps_accented_operands(spark):
    assert spark.sql("select 'Une énergie causes été chaud.' as s").select(T.causal_rule(F.col("s"))).first()[0] == "énergie → causes → été"


def test_causal_paths_name_their_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 0, 0.9, "CAUSES"), (2, 3, 0, 0.9, "CAUSES"), (1, 3, 1, 0.1, "ASSOC")], "src long, dst long, adj_idx int, weight double, type string")
    found = {r["node"]: r["path"] for r in reason.causal_paths(spark.createDataFrame([(1,)], "source long"), edges).collect()}
    assert found == {1: [1], 2: [1, 2], 3: [1, 2, 3]}


def test_isotonic_never_falls():
    import pandas as pd

    rng = np.random.default_rng(4)
    for _ in range(20):
        table = pd.DataFrame([(i, 0.0, int(rng.integers(0, 30)), 30) for i in rng.choice(20, 12, replace=False)], columns=["bucket", "total", "positive", "n"])
        values = learn.isotonic(table)
        assert len(values) == 20 and all(0 <= x <= 1 for x in values)
    one = learn.isotonic(pd.DataFrame([(0, 0, 40, 50), (1, 0, 0, 50)], columns=["bucket", "total", "positive", "n"]))
    # The two full buckets meet at their mean and take the empty ones after them, of weight 1, along.
    assert 0.36 < one[0] < 0.4 and one[0] <= one[1] + 0.01 and one[12] == 0.6


def test_training_plan_falls_to_its_floor():
    plan = steps.training_plan(100, 0.05)
    assert plan[0] == (0, 0.05) and plan[1][1] == pytest.approx(0.048) and plan[-1][1] == 0.005


def test_built_in_knowledge(spark):
    from hyperspark.engine import embed

    laws = knowledge.physics_nodes(spark)
    assert laws.count() == 28 and laws.where("units is null").count() == 0
    links = knowledge.physics_links(laws.select("id", embed("label").alias("v")))
    assert links.where("a = b or weight <= 0.28").count() == 0 and links.count() > 0
    ids = {r["id"] for r in knowledge.code_nodes(spark).collect()}
    assert len(ids) == 27 and all(r["a"] in ids and r["b"] in ids for r in knowledge.code_links(spark).collect())


def test_log_is_folded_with_all_columns_and_dropped(spark, tmp_path):
    snap, log = str(tmp_path / "snap"), str(tmp_path / "log")
    nodes = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6)], "id long, label string, importance double")
    edges = spark.createDataFrame([(1, 2, 0, 0.3, "ASSOC")], "src long, dst long, adj_idx int, weight double, type string")
    sinks.save_snapshot({"nodes": nodes, "edges": edges}, snap, 1)
    changes = spark.createDataFrame([(1, "ADD_NODE", 3, None, None, "c"), (2, "UPDATE_WEIGHT", 1, 2, 0.9, None), (3, "PRUNE_NODE", 4, None, None, None)], "seq long, op string, id_a long, id_b long, value double, payload string")
    sinks.append_log(changes, log)
    assert sinks.rotate(spark, snap, log, 2) is None and sinks.recover(spark, snap, log)["nodes"].count() == 3
    assert sinks.rotate(spark, snap, log, 2, limit=1) is not None and sinks.log_size(spark, log) == 0
    made = sinks.load_snapshot(spark, snap)
    assert rows(made["nodes"].select("id", "label", F.coalesce("importance", F.lit(-1.0)))) == [(1, "a", 0.5), (2, "b", 0.6), (3, "c", -1.0)]
    assert made["edges"].first()["weight"] == 0.9 and made["edges"].first()["type"] == "ASSOC"


def test_sample_vectors_are_bounded(spark):
    df = spark.range(3000).selectExpr("id", "array(double(id), 1D) as v")
    assert len(quality.sample_vectors(df, rows=100)) == 100 and len(quality.sample_vectors(df.limit(0))) == 0


def test_engine_advances_and_learns(spark, tmp_path):
    labels = ["newton second law of motion", "force equals mass times acceleration", "recipe for apple pie with butter"]
    hyperedges = spark.createDataFrame([(1, 0.9, 0.9, True, 0)], "edge_id long, weight double, causal_strength double, is_causal boolean, fire_count long")
    members = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "edge_id long, pos int, node long")
    lexicon = spark.createDataFrame([("motion", ["mtn"], ["movement"])], "word string, abbrevs array<string>, synonyms array<string>")
    engine = Engine.from_labels(spark, labels, [(0, 1, 0.9, "CAUSES")], hyperedges=hyperedges, members=members, lexicon=lexicon, answer=lambda text, context: f"about {text}: {context}", config=EngineConfig(use_vae=True))
    asked = spark.createDataFrame([(1, "newton second law of mtn"), (2, "zzqx wvvk"), (3, None)], "q long, text string")
    results = engine.query(asked).persist()
    by = {r["q"]: r for r in results.collect()}
    assert by[1]["best"] > 0.9 and by[1]["n_fired"] == 1 and 0 <= by[1]["lb"] <= by[1]["confidence"] <= by[1]["ub"] <= 1 and by[1]["msg_entropy"] >= 0
    assert "Confidence" in by[1]["response"] and by[3]["confidence"] == 0.0 and 0 < by[1]["compute_used"] < 1
    before = engine.stats()["n_nodes"]
    engine.advance(results)
    assert engine.seen == 3 and len(engine.context) == 2 and engine.working and engine.episodes.where("size(key_nodes) > 0").count() >= 1
    assert engine.stats()["n_nodes"] > before  # an unknown query leaves its words
    active = engine._active.select((-1 - F.col("q")).alias("q"), "node", "activation").where("q = 1")
    weight = engine.edges.where("src = 0 and dst = 1").first()["weight"]
    engine.feedback(active, spark.createDataFrame([(1, 0.9)], "q long, reward double"))
    assert engine.edges.where("src = 0 and dst = 1").first()["weight"] != weight and engine.score() == pytest.approx(0.45)
    assert engine.episodes.agg(F.max("reward")).first()[0] == pytest.approx(0.9)
    assert engine.causal("newton second law of motion", "force equals mass times acceleration").first()["path"] == [0, 1]
    assert {r["kind"] for r in engine.graph().select("kind").distinct().collect()} == {"stats", "node", "edge", "hyper"}
    assert "newton" in engine.pretty_query("newton second law")


def test_engine_trains_and_scores(spark):
    engine = Engine.from_labels(spark, ["gravity pulls mass", "light bends"], [])
    samples = spark.createDataFrame([("gravity pulls the mass", ["gravity", "mass", "orbit"], "gravity → causes → orbit", ["planet"], 0.2), ("bread needs yeast", ["bread", "yeast"], "", None, 0.2), (None, None, None, None, None)], "query string, concepts array<string>, causal_rule string, keywords array<string>, expected_confidence double")
    history = engine.train(samples.where("query is not null"), epochs=1).collect()
    assert len(history) == 1 and history[0]["nodes_added"] > 0 and len(history[0]) == 9 and 0 <= history[0]["loss"] <= 1
    assert engine.edges.where("type = 'CAUSES'").count() == 2
    scores = engine.benchmark(spark.createDataFrame([(1, "gravity pulls the mass", ["gravity"]), (2, "", None)], "q long, text string, expected array<string>"))
    by = {r["q"]: r["score"] for r in scores.collect()}
    assert by[1] >= 0.5 and 0 <= by[2] <= 0.1


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("select resonance_of(0.5D, 1L, 1L, 'LANG_ENGLISH', 'LANG_FRENCH') as a, tokenize('To be, or') as t, vector_dot(array(1D, 2D), array(3D, 4D)) as d, size(ngram_embed('abc')) as n").first()
    assert r["a"] == pytest.approx(0.41) and r["t"] == ["to", "be", ",", "or"] and r["d"] == 11.0 and r["n"] == 384


def test_document_links_match_brute_force_without_shuffling_pairs(spark):
    rng = random.Random(3)
    # Places with gaps and repeats, a document with one term, one without a key, terms without a node or place.
    held = [(d, p, rng.randrange(12)) for d in range(6) for p in rng.choices(range(1, 40), k=25)] + [(6, 1, 3), (None, 1, 1), (None, 2, 2), (0, None, 4), (1, 2, None)]
    vectors = {i: np.array([np.cos(i / 3), np.sin(i / 3)]) for i in range(11)}
    made = steps.document_links(spark.createDataFrame(held, "d long, place int, node long"), spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>"), "d")
    met = {(a, b) for d, p, a in held for e, q, b in held if None not in (d, p, a, q, b) and d == e and 1 <= p - q <= 8 and a != b and a in vectors and b in vectors}
    want = {(a, b): round(0.7 * round(min(1.0, float(vectors[a] @ vectors[b])), 9), 6) for a, b in met if vectors[a] @ vectors[b] > 0.25}
    assert {(r["a"], r["b"]): round(r["weight"], 6) for r in made.collect()} == want
    # The joins are those of distinct pairs with their two vectors.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
