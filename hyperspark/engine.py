"""The engine's facade: batches of queries against an immutable graph snapshot, and explicit steps that advance it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from hyperspark.config import DEFAULT, EngineConfig
from hyperspark.functions import text as T
from hyperspark.functions import vector as V
from hyperspark.operators import activate, answer, graph, grow, hyper, learn, quality, rank, reason, steps, topk
from hyperspark.plans.runtime import cut, ship
from hyperspark.sources import sinks, text


@F.pandas_udf(ArrayType(DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """Unit n-gram vectors of texts; equal texts of a batch are worked out once."""
    once = texts.unique()
    table = dict(zip(once, V.unit_rows(V.ngram_vectors(list(once)))))
    return texts.map(table)


#: Columns of a node besides ``id``, ``label`` and ``v``, with what stands where they are missing.
NODE_DEFAULTS = {
    "hash": "0L", "lang": "'LANG_UNKNOWN'", "type": "'CONCEPT'", "formula": "cast(null as string)", "usage_count": "0D", "entropy_score": "0.5D", "importance": "0D", "activation": "0D", "last_active": "0D",
    "in_fast_ring": "false", "auto_created": "false", "view_weights": "array(1D/3, 1D/3, 1D/3)",
}
HYPER = "edge_id long, weight double, causal_strength double, is_causal boolean, fire_count long"
MEMBERS = "edge_id long, pos int, node long"


def complete(nodes: DataFrame) -> DataFrame:
    """Nodes with all their columns."""
    return nodes.select("id", "label", "v", *[F.coalesce(F.col(c), F.expr(x)).alias(c) if c in nodes.columns else F.expr(x).alias(c) for c, x in NODE_DEFAULTS.items()])


class Engine:
    """A graph of ``nodes (id, label, v, hash, lang, …)``, ``edges (src, dst, adj_idx, weight, type)`` and hyperedges.

    ``answer`` turns a text and its context into a reply; by default a template does. ``lexicon (word, abbrevs, synonyms)`` serves
    abbreviations and growth. Every query of a batch sees the same snapshot, the same context and the same working memory;
    learning and growth happen in ``advance``, ``feedback``, ``ingest``, ``train`` and ``maintain``. The flags of the
    configuration switch the steps of a query on and off. What the engine remembers between batches is bounded: 64
    vectors of turns, 16 slots of working memory, 512 rewards; episodes are a table of the newest 10,000.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: EngineConfig = DEFAULT, answer: Callable[[str, str], str] | None = None, hyperedges: DataFrame | None = None, members: DataFrame | None = None, lexicon: DataFrame | None = None):
        ship(spark)
        self.spark, self.config, self.answer, self.lexicon = spark, config, answer, lexicon
        self.nodes, self.edges = cut(complete(nodes)), cut(edges)
        self.hyperedges = hyperedges if hyperedges is not None else spark.createDataFrame([], HYPER)
        self.members = members if members is not None else spark.createDataFrame([], MEMBERS)
        self.episodes: DataFrame | None = None
        self.coordinates: DataFrame | None = None
        self.calibration: list[float] | None = None
        self.context: list[list[float]] = []
        self.session: list[float] | None = None
        self.working: dict[int, float] = {}
        self.rewards: list[float] = []
        self.outcomes: list[tuple[float, bool]] = []
        self.history: list[dict] = []
        self.seen, self.sigma, self.last_confidence = 0, 0.0, 0.0
        self._resonant: DataFrame | None = None
        self._active: DataFrame | None = None

    @classmethod
    def from_labels(cls, spark: SparkSession, labels: list[str], edges: list[tuple[int, int, float, str]] = (), **options) -> Engine:
        """A graph of labelled concepts; each connection is listed in both directions."""
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id long, label string")
        nodes = rows.select("id", "label", embed("label").alias("v"), T.fnv1a(F.col("label")).alias("hash"), T.detect_lang(F.col("label")).alias("lang"))
        both, place = [], {}
        for a, b, w, kind in edges:
            for src, dst in ((a, b), (b, a)):
                place[src] = place.get(src, -1) + 1
                both.append((src, dst, place[src], w, kind))
        return cls(spark, nodes, spark.createDataFrame(both, "src long, dst long, adj_idx int, weight double, type string"), **options)

    # --- queries -----------------------------------------------------------------------------------------------------

    def resonant_edges(self) -> DataFrame:
        """Edges with the resonance of their ends, worked out once for a snapshot; of several views if the flag is set."""
        if self._resonant is None:
            ends = self.nodes.select("id", "v", "hash", "lang", "view_weights")
            if self.config.use_multiview:
                ends = cut(ends.withColumn("views", V.orthogonal_views(F.col("v"))))
            a, b = (ends.select(*[F.col(c).alias(c + side) for c in ends.columns]) for side in "ab")
            pairs = self.edges.join(a, F.col("src") == F.col("ida")).join(b, F.col("dst") == F.col("idb"))
            single = V.resonance(F.col("va"), F.col("vb"), F.col("hasha"), F.col("hashb"), F.col("langa"), F.col("langb"))
            if self.config.use_multiview:
                single = V.multiview_resonance(F.col("viewsa"), F.col("viewsb"), F.col("view_weightsa"), F.col("view_weightsb"), single, V.hashes_near(F.col("hasha"), F.col("hashb")))
            self._resonant = cut(pairs.select(*self.edges.columns, F.round(single, 9).alias("res")))
        return self._resonant

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Queries with their vectors: abbreviations expanded, blended with the last turns and the session."""
        rows = queries.select((-1 - F.col("q")).alias("q"), "text")
        read = rows.withColumn("read", F.coalesce("text", F.lit("")))
        if self.lexicon is not None:
            expanded = grow.expand_abbreviations(rows, "q", "text", self.lexicon)
            read = rows.join(expanded, "q", "left").withColumn("read", F.coalesce("expanded", F.lit(""))).drop("expanded")
        # Vectors are written before they are blended; a function of Python can't stand within the blend.
        read = cut(read.select("q", "text", embed("read").alias("v")))
        v = F.col("v")
        for alpha, before in zip((0.25, 0.125, 0.0625, 0.03125), reversed(self.context[-4:])):
            v = V.blend(v, F.lit(before), alpha)
        if self.session is not None:
            v = V.blend(v, F.lit(self.session), 0.08)
        return read.select("q", "text", v.alias("v"))

    def _seeds(self, asked: DataFrame) -> DataFrame:
        """``(q, seed, sim, spike)``: the nearest nodes of each query; nodes of the fast ring start 1.15 times as strong."""
        c = self.config
        near = topk.topk_join(asked.select(F.col("q").alias("id"), "v"), self.nodes.select("id", "v"), c.seeds, c.resonance_threshold).select("q", F.col("id").alias("seed"), "sim", "rank")
        if c.use_spectral and self.coordinates is not None:
            scored = rank.rescore_seeds(near.select("q", F.col("seed").alias("node"), (1 - F.col("sim")).alias("dist"), F.col("rank").alias("place")), self.coordinates, c.seeds)
            near = near.join(scored.select("q", F.col("node").alias("seed"), "combined"), ["q", "seed"])
        fast = self.nodes.where("in_fast_ring").select(F.col("id").alias("seed"), F.lit(c.fast_ring_boost).alias("boost"))
        return near.join(fast, "seed", "left").select("q", "seed", "sim", V.clamp(F.col("sim") * F.coalesce("boost", F.lit(1.0))).alias("spike"))

    def _hyper(self, active: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(q, n_fired, max_attention)`` and ``(q, msg_entropy)``: hyperedges of each query's active nodes; keys of a query are told apart by its number."""
        c = self.config
        key = lambda x: F.concat_ws("|", F.col("q"), x)
        touched = self.members.join(active.select("q", "node"), "node").select("q", "edge_id").distinct()
        members = touched.join(self.members, "edge_id").select("q", key("edge_id").alias("edge_id"), key("node").alias("node"))
        edges = touched.join(self.hyperedges, "edge_id").select(key("edge_id").alias("edge_id"), "weight", "causal_strength", "is_causal")
        own = active.select("q", "node", "activation")
        strength = own.select(key("node").alias("node"), "activation")
        vectors = own.join(self.nodes.select(F.col("id").alias("node"), "v"), "node").select(key("node").alias("node"), "v")
        if c.use_attention:
            adjacency = own.join(self.edges.withColumnRenamed("src", "node"), "node").select(key("node").alias("src"), key("dst").alias("dst"), "adj_idx", F.col("weight"))
            found = cut(hyper.attention(edges, members.select("edge_id", "node"), strength, vectors, adjacency, c))
        else:
            found = cut(hyper.evaluate(edges, members.select("edge_id", "node"), strength).withColumn("attention", F.lit(0.0)).withColumn("entropy", F.lit(0.0)))
        q = F.split("edge_id", r"\|")[0].cast("long").alias("q")
        fired = found.where("fires").groupBy(q).agg(F.count_distinct("edge_id").alias("n_fired"), F.max("attention").alias("max_attention"))
        entropy = found.where("fires").select("edge_id", "entropy").distinct().groupBy(q).agg(F.avg("entropy").alias("msg_entropy"))
        return fired, entropy

    def query(self, queries: DataFrame) -> DataFrame:
        """One row for each of ``queries (q long, text string)``; empty texts get confidence 0.

        ``(q, text, confidence, lb, ub, best, n_activated, n_chains, n_contradictions, n_fired, max_attention, msg_entropy, compute_used,
        hops_taken, top_concepts, chains, context, response, grounded)``.
        """
        c = self.config
        # Negative ids keep queries apart from the nodes they are compared with.
        asked = self._asked(queries)
        seeds = cut(self._seeds(asked.where("trim(text) <> ''")))
        edges = self.resonant_edges()
        reached = cut(activate.spread(seeds.select("q", "seed", "spike"), edges, config=c))
        bonus = None
        if self.working:
            slots = self.spark.createDataFrame(list(self.working.items()), "node long, salience double")
            bonus = asked.select("q").join(F.broadcast(slots))  # at most 16 slots
        first = reached.groupBy("q", "node").agg(F.min(F.col("depth") * 1000000 + F.col("rank")).alias("arrival"))
        ranks = self.nodes.where("importance > 0").select(F.col("id").alias("node"), F.col("importance").alias("pr"))
        active = cut(activate.activations(reached, bonus, ranks, c).join(first, ["q", "node"]))
        self._active = active
        ends = active.where("activation >= 0.2").join(self.nodes.select(F.col("id").alias("node"), "label", "type", "formula"), "node")
        ends = cut(activate.first_concepts(ends, 16, faithful=c.faithful))
        pairs = ends.select("q", F.col("node").alias("a"), "place").join(ends.select("q", F.col("node").alias("b"), F.col("place").alias("pb")), "q").where("place < pb").select("a", "b").distinct()
        vectors = self.nodes.select("id", "v", "hash", "lang")
        pairs = pairs.join(vectors.toDF("a", "va", "ha", "la"), "a").join(vectors.toDF("b", "vb", "hb", "lb"), "b").select("a", "b", V.resonance(F.col("va"), F.col("vb"), F.col("ha"), F.col("hb"), F.col("la"), F.col("lb")).alias("res"))
        found = cut(reason.chains(ends, edges, pairs, c.max_chains))
        opposed = reason.contradictions(ends, edges).groupBy("q").agg(F.count(F.lit(1)).alias("n_contradictions"))
        labels = self.nodes.select("id", "label")
        named = found.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").select("q", "chain", F.concat_ws(" ", "label_a", T.edge_type_name(F.col("relation")), "label_b").alias("text"))
        named = named.groupBy("q").agg(F.count(F.lit(1)).alias("n_chains"), F.transform(F.array_sort(F.collect_list(F.struct("chain", "text"))), lambda e: e["text"]).alias("chains"))
        per_query = active.groupBy("q").agg(F.count(F.lit(1)).alias("n_activated"), F.sum("hits").alias("hops_taken"))
        tops = ends.where("place <= 8").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda e: e["label"]).alias("top_concepts"))
        laws = ends.where("type = 'PHYSICS' and formula is not null").groupBy("q").agg(F.min_by(F.struct("formula", "activation"), "place").alias("law"))
        best = seeds.groupBy("q").agg(F.max("sim").alias("best"))
        rows = asked.select("q", "text")
        for part in (per_query, named, opposed, tops, laws, best, *self._hyper(active)):
            rows = rows.join(part, "q", "left")
        rows = rows.na.fill(0, ["n_activated", "hops_taken", "n_chains", "n_contradictions", "n_fired"]).na.fill(0.0, ["best", "max_attention", "msg_entropy"])
        raw = learn.raw_confidence(F.col("best"), F.col("n_activated"), F.col("n_chains"))
        confidence = learn.calibrated(raw, self.calibration) if self.calibration else raw
        bound = learn.pac_bayes_bound(F.lit(self.complexity()), F.lit(len(self.rewards))) if c.use_pacbayes else F.lit(0.0)
        concepts, none = F.coalesce("top_concepts", F.array().cast("array<string>")), F.lit(None).cast("string")
        chains = F.coalesce("chains", F.array().cast("array<string>"))
        context = answer.context_text(F.when(F.size(concepts) > 0, F.array_join(concepts, ", ")), F.when(F.size(chains) > 0, F.array_join(F.slice(chains, 1, 3), "; ")), F.when(F.col("n_contradictions") > 0, F.col("n_contradictions").cast("string")), F.round(confidence, 2))
        reply = F.when(F.size(concepts) == 0, F.lit("No related concepts.")).otherwise(F.concat(F.lit("Related concepts: "), F.array_join(F.slice(concepts, 1, 5), ", "), F.lit(".")))
        rows = rows.withColumn("confidence", confidence).withColumn("context", context).withColumn("response", reply)
        if self.answer is not None:
            given = self.answer

            @F.pandas_udf("string")
            def replied(texts: pd.Series, contexts: pd.Series) -> pd.Series:
                return pd.Series([given(t, x) for t, x in zip(texts, contexts)])

            rows = rows.withColumn("response", replied("text", "context"))
        response, grounded = answer.ground(F.col("response"), F.col("n_contradictions") > 0, F.coalesce(F.col("law.formula"), none), F.coalesce(F.col("law.activation"), F.lit(0.0)))
        return rows.select(
            (-1 - F.col("q")).alias("q"), "text", "confidence", V.clamp(F.col("confidence") - bound).alias("lb"), V.clamp(F.col("confidence") + bound).alias("ub"), "best", "n_activated", "n_chains", "n_contradictions", "n_fired", "max_attention", "msg_entropy",
            (F.col("n_activated") / (self.nodes.count() + 1)).alias("compute_used"), "hops_taken", concepts.alias("top_concepts"), chains.alias("chains"), "context", response.alias("response"), grounded.alias("grounded"),
        )

    def complexity(self) -> float | None:
        """``σ ln(density + 1)`` of the hyperedges; None before the norm was worked out."""
        if self.sigma <= 0:
            return None
        return hyper.complexity(self.members, self.nodes.count(), self.sigma).first()["complexity"]

    def advance(self, results: DataFrame) -> list[str]:
        """What the last batch of queries leaves behind: decayed and new activations, context, working memory, episodes, growth, maintenance that is due.

        ``results`` are the rows of :meth:`query`; turns count in order of ``q``. Returns what maintenance ran.
        """
        c = self.config
        rows = results.where("trim(text) <> ''").orderBy(F.desc("q")).limit(c.context_history)
        turns = [r for r in reversed(rows.select("q", "text", "confidence", embed("text").alias("v")).collect())]
        for r in turns:
            self.context = [*self.context, list(r["v"])][-c.context_history :]
            held = np.array(r["v"]) if self.session is None else (1 - steps.SESSION_BLEND) * np.array(self.session) + steps.SESSION_BLEND * np.array(r["v"])
            self.session = V.unit_rows(held[None])[0].tolist()
            self.last_confidence = r["confidence"]
        active = self._active.withColumn("q", -1 - F.col("q"))
        inserts = steps.working_inserts(active).join(rows.select("q"), "q", "left_semi")
        for _, own in inserts.toPandas().sort_values(["q", "salience"], ascending=[True, False]).groupby("q"):  # at most 4 nodes of each of the last turns
            self.working = {n: s * 0.8 for n, s in self.working.items() if s * 0.8 > 0.05}
            for r in own.itertuples():
                full = len(self.working) >= c.working_memory_slots and r.node not in self.working
                least = min(self.working, key=lambda n: (self.working[n], n)) if full else None
                if least is None or r.salience > self.working[least]:
                    self.working.pop(least, None)
                    self.working[int(r.node)] = max(self.working.get(int(r.node), 0.0), float(r.salience))
        stored = steps.episodes(results.select("q", F.col("text").alias("query"), "response", "confidence"), active).withColumn("seq", F.lit(self.seen).cast("long") + F.col("q")).withColumn("reward", F.lit(0.0))
        stored = stored if self.episodes is None else self.episodes.unionByName(stored)
        self.episodes = cut(stored.orderBy(F.desc("seq"), F.desc("q")).limit(c.episodic_cap))
        total = active.groupBy(F.col("node").alias("id")).agg(F.sum("activation").alias("fresh"), F.sum("hits").alias("hits"))
        decayed = F.when(0.2 * F.col("activation") >= 0.01, 0.2 * F.col("activation")).otherwise(0.0)
        n = results.count()
        self.nodes = cut(
            self.nodes.join(total, "id", "left").withColumn("activation", V.clamp(decayed + F.coalesce("fresh", F.lit(0.0)))).withColumn("usage_count", F.col("usage_count") + F.coalesce("hits", F.lit(0)))
            .withColumn("last_active", F.when(F.col("hits") > 0, F.lit(float(self.seen + n))).otherwise(F.col("last_active"))).drop("fresh", "hits")
        )
        if c.use_messages and not self.hyperedges.isEmpty():
            felt = cut(active.groupBy("node").agg(F.max("activation").alias("activation"), F.sum("hits").alias("hits")))
            vectors = self.nodes.select(F.col("id").alias("node"), "v")
            fired = hyper.attention(self.hyperedges, self.members, felt.select("node", "activation"), vectors, self.edges, c).where("fires").select("edge_id", "activation").distinct()
            sent = cut(hyper.message_pass(cut(fired), self.members, felt, vectors, c).withColumnRenamed("v", "heard"))
            self.nodes = cut(self.nodes.join(sent.withColumnRenamed("node", "id"), "id", "left").withColumn("v", F.coalesce("heard", "v")).drop("heard"))
            self._resonant = None
        unknown = results.where(F.col("best") <= c.selfgrow_threshold)
        self._grow(grow.token_chains(unknown, "q", "text"))
        grown = steps.answer_terms(results.select("q", "response", "confidence", "grounded"), self.nodes).where("before is not null").select(F.col("before").alias("a"), F.col("label").alias("b"), F.lit(1).alias("n"), F.lit(0.35).alias("weight")) if self.answer is not None else None
        if grown is not None:
            self._grow(grown)
        before, self.seen = self.seen, self.seen + n
        return self.maintain(self.seen, before)

    # --- growth and learning -------------------------------------------------------------------------------------------

    def _grow(self, links: DataFrame) -> None:
        """Add the terms of ``links (a, b, weight)`` that no node stands for, and the links."""
        links = cut(links.select("a", "b", "weight"))
        if links.isEmpty():
            return
        terms = links.select(F.col("a").alias("label")).union(links.select("b")).distinct()
        ids = self.add(terms)
        if self.lexicon is not None and "synonyms" in self.lexicon.columns:
            more = cut(steps.synonym_links(terms, self.lexicon).select("a", "b", "weight"))
            ids = ids.union(self.add(more.select(F.col("b").alias("label")).distinct()))
            links = links.union(more)
        ids = cut(ids.groupBy("label").agg(F.min("node").alias("node")))
        self.link(links.join(ids.toDF("a", "na"), "a").join(ids.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight"))

    def add(self, labels: DataFrame, near: float = 0.78) -> DataFrame:
        """Add ``labels (label)``; returns ``(label, node)``: a new node, or a known or new one nearer than ``near`` that stands for it."""
        wanted = cut(labels.where("trim(label) <> ''").distinct())
        known = wanted.join(self.nodes.select("label", "id"), "label").groupBy("label").agg(F.min("id").alias("node"))
        numbered = graph.add_nodes(self.nodes.select("id", "label"), wanted).join(self.nodes.select("id"), "id", "left_anti")
        fresh = cut(numbered.select("id", "label", embed("label").alias("v")))
        stands = cut(steps.reused(fresh.select("id", "v"), self.nodes.select("id", "v"), near))
        added = fresh.join(stands.where("id = node").select("id"), "id", "left_semi")
        made = complete(added.withColumn("hash", T.fnv1a(F.col("label"))).withColumn("lang", T.detect_lang(F.col("label"))).withColumn("entropy_score", F.lit(0.3)).withColumn("auto_created", F.lit(True)))
        used = stands.where("id <> node").groupBy(F.col("node").alias("id")).agg((0.5 * F.count(F.lit(1))).alias("more"))
        self.nodes = cut(self.nodes.unionByName(made).join(used, "id", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("more", F.lit(0.0))).drop("more"))
        self._resonant = None
        return cut(known.select("label", "node").union(fresh.join(stands, "id").select("label", "node")))

    def link(self, links: DataFrame, kind: str = "ASSOC") -> None:
        """Connect ``links (a, b, weight)`` in both directions; a pair that is connected already takes the new weight and type and keeps its place."""
        best = links.where("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight"))
        both = best.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(best.select("b", "a", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        last = self.edges.groupBy("src").agg(F.max("adj_idx").alias("last"))
        fresh = both.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti").join(last, "src", "left")
        placed = fresh.withColumn("adj_idx", (F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("src").orderBy("dst"))).cast("int"))
        kept = self.edges.join(both.withColumnRenamed("weight", "new"), ["src", "dst"], "left").withColumn("type", F.when(F.col("new").isNotNull(), F.lit(kind)).otherwise(F.col("type"))).withColumn("weight", F.coalesce(V.clamp(F.col("new"), 0.001, 1.0), "weight")).drop("new")
        made = placed.select("src", "dst", "adj_idx", V.clamp(F.col("weight"), 0.001, 1.0).alias("weight"), F.lit(kind).alias("type"))
        self.edges = cut(kept.select("src", "dst", "adj_idx", "weight", "type").unionByName(made))
        self._resonant = None

    def ingest(self, texts: DataFrame) -> int:
        """Read ``texts (text)``: terms not near a known node become nodes, terms met within eight of one another are linked; returns the number of nodes."""
        rows = cut(texts.where("trim(text) <> ''").select(F.xxhash64("text").alias("doc"), "text").dropDuplicates(["doc"]))
        terms = cut(steps.document_terms(rows, "doc", "text"))
        ids = self.add(terms.select("label"), 0.88).groupBy("label").agg(F.min("node").alias("node"))
        self.link(steps.document_links(terms.join(ids, "label").select("doc", "place", "node"), self.nodes.select("id", "v"), "doc"))
        return self.nodes.count()

    def ingest_file(self, path: str) -> int:
        """Read a text file line by line; lines under ten characters are skipped."""
        return self.ingest(text.read_lines(self.spark, path).select(F.col("value").alias("text")))

    def feedback(self, active: DataFrame, rewards: DataFrame) -> None:
        """Apply rewards ``(q, reward)`` to the active nodes ``(q, node, activation)``; the updates of several queries are averaged.

        Edges and hyperedges learn, vectors move towards or away from the last turn's, entropy and usage follow, nodes are promoted, the
        outcome is kept for calibration, view weights learn, and the last episode takes the last reward.
        """
        c = self.config
        updates = learn.hebbian(self.edges, active, rewards, c).groupBy("src", "dst").agg(F.avg("weight").alias("new"))
        self.edges = cut(self.edges.join(updates, ["src", "dst"], "left").withColumn("weight", F.coalesce("new", "weight")).drop("new"))
        given = [float(np.clip(r["reward"], -1, 1)) for r in rewards.where("reward is not null").orderBy(F.desc("q")).limit(c.feedback_ring).collect()][::-1]
        if not given:
            return
        self.rewards = [*self.rewards, *given][-c.feedback_ring :]
        self.outcomes = [*self.outcomes, *((self.last_confidence, r > 0.2) for r in given)][-c.feedback_ring :]
        if not self.hyperedges.isEmpty():
            changed = learn.hebbian_hyperedges(self.hyperedges, self.members, active.select("node").distinct(), float(np.mean(given)), c).withColumnRenamed("causal_strength", "new")
            self.hyperedges = cut(self.hyperedges.join(changed, "edge_id", "left").withColumn("causal_strength", F.coalesce("new", "causal_strength")).drop("new"))
        entries = active.groupBy("q").agg(F.collect_set("node").alias("active_nodes")).join(rewards.groupBy("q").agg(F.avg("reward").alias("reward")), "q").select(F.col("q").alias("query_id"), "reward", F.lit(None).cast("timestamp").alias("ts"), "active_nodes")
        changed = steps.node_feedback(self.nodes, entries)
        mean = active.join(rewards, "q").groupBy(F.col("node").alias("id")).agg(F.avg("reward").alias("reward"), F.avg(F.col("activation")).alias("felt"))
        rows = self.nodes.join(changed, "id", "left").join(mean, "id", "left")
        rows = rows.withColumn("entropy_score", F.coalesce("entropy", "entropy_score")).withColumn("usage_count", F.coalesce("usage", "usage_count")).withColumn("in_fast_ring", F.col("in_fast_ring") | F.coalesce("promoted", F.lit(False)))
        if self.context:
            last = F.lit(self.context[-1])
            rows = learn.contrastive(rows.withColumn("context", last), activation="felt")
            if c.use_multiview:
                touched = rows.where("reward is not null").select("id", V.orthogonal_views(F.col("v")).alias("views"), F.col("view_weights").alias("weights"), "reward")
                views = steps.view_feedback(touched, V.orthogonal_views(last), F.col("reward"))
                rows = rows.join(views, "id", "left").withColumn("view_weights", F.coalesce("weights", "view_weights")).drop("weights")
        self.nodes = cut(rows.select(*self.nodes.columns))
        self._resonant = None
        if self.episodes is not None:
            newest = self.episodes.agg(F.max("seq")).first()[0]
            self.episodes = cut(self.episodes.withColumn("reward", F.when(F.col("seq") == newest, F.lit(given[-1])).otherwise(F.col("reward"))))
        if len(self.outcomes) >= 50:
            table = self.spark.createDataFrame(self.outcomes, "p double, hit boolean")
            self.calibration = learn.isotonic(learn.calibration_buckets(table, F.col("p"), F.col("hit")).toPandas())

    def score(self) -> float:
        """Sum of the last sixteen rewards over their number plus one."""
        last = self.rewards[-16:]
        return sum(last) / (len(last) + 1)

    def train(self, samples: DataFrame, epochs: int = 1, rate: float = 0.05) -> DataFrame:
        """Train on ``samples (query, concepts, causal_rule, keywords, expected_confidence)``; returns the history, a row for each epoch.

        An epoch is one batch: concepts enter or are reused above .80, those of a sample are linked, rules give causal links, keywords
        grow, the queries run on that snapshot, and what they activate is rewarded by 15 times the rate or punished by 5 times.
        """
        rows = cut(samples.withColumn("q", F.xxhash64("query").bitwiseAND(F.lit(0x7FFFFFFF))).dropDuplicates(["q"]))
        for epoch, now in steps.training_plan(epochs, rate):
            weights, before = steps.training_weights(now), (self.nodes.count(), self.edges.count())
            held = F.slice(F.filter(F.transform("concepts", lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2), 1, 12)
            lists = cut(rows.select("q", F.coalesce("causal_rule", F.lit("")).alias("rule"), held.alias("c")))
            ids = self.add(lists.select(F.explode("c").alias("label")), 0.80)
            pairs = grow.training_edges(lists, "q", "c", now).join(ids.toDF("a", "na"), "a").join(ids.toDF("b", "nb"), "b")
            self.link(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b"), F.lit(weights["dense"]).alias("weight")))
            causes = lists.where("rule <> '' and size(c) >= 2").select(F.element_at("c", 1).alias("a"), F.element_at("c", -1).alias("b"))
            self.link(causes.join(ids.toDF("a", "na"), "a").join(ids.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), F.lit(weights["causes"]).alias("weight")), "CAUSES")
            if "keywords" in rows.columns:
                self.add(rows.select(F.explode("keywords").alias("label")).where("length(label) > 2"))
            results = cut(self.query(rows.select("q", F.col("query").alias("text"))))
            right = F.col("confidence") > F.coalesce("expected_confidence", F.lit(0.25))
            judged = results.join(rows.select("q", "expected_confidence"), "q").select("q", F.when(right, weights["right"]).otherwise(weights["wrong"]).alias("reward"))
            self.feedback(self._active.select((-1 - F.col("q")).alias("q"), "node", "activation"), cut(judged))
            figures = results.join(judged, "q").agg(F.avg(1 - F.col("best")).alias("loss"), F.avg("confidence").alias("confidence"), F.avg("best").alias("best"), F.avg((F.col("reward") > 0).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).first()
            self.history.append({"epoch": epoch, "sample": int(figures["n"]), "loss": figures["loss"], "confidence": figures["confidence"], "best_resonance": figures["best"], "accuracy": figures["accuracy"], "nodes_added": self.nodes.count() - before[0], "edges_added": self.edges.count() - before[1]})
            self.advance(results)
        return sinks.training_history(self.spark.createDataFrame(self.history, "epoch int, sample int, loss double, confidence double, best_resonance double, accuracy double, nodes_added int, edges_added int"))

    def benchmark(self, queries: DataFrame) -> DataFrame:
        """``(q, score)`` of ``queries (q, text, expected array<string>)``: hits are expected words in activated labels."""
        results = cut(self.query(queries.select("q", "text")))
        labels = self._active.join(self.nodes.select(F.col("id").alias("node"), F.lower("label").alias("label")), "node").select((-1 - F.col("q")).alias("q"), "label")
        wanted = queries.select("q", F.explode(F.filter("expected", lambda x: F.trim(x) != "")).alias("word"))
        hit = wanted.join(labels, "q", "left").groupBy("q", "word").agg(F.max(F.coalesce(F.contains("label", F.lower("word")), F.lit(False)).cast("int")).alias("hit")).groupBy("q").agg(F.avg("hit").alias("hits"))
        return results.join(hit, "q", "left").select("q", learn.evaluation_score(F.col("best"), F.col("hits"), F.col("confidence"), F.col("n_chains")).alias("score"))

    # --- maintenance and views of the graph -------------------------------------------------------------------------------

    def maintain(self, queries_seen: int, before: int | None = None) -> list[str]:
        """Run the maintenance that is due after so many queries, or has come due since ``before``; returns what ran."""
        c, done = self.config, []
        due = lambda every: queries_seen and (queries_seen % every == 0 if before is None else queries_seen // every > before // every)
        if due(c.pagerank_every):
            ranks = rank.pagerank(self.nodes, self.edges, config=c).select(F.col("node").alias("id"), F.col("importance").alias("new"))
            self.nodes = cut(self.nodes.join(ranks, "id", "left").withColumn("importance", F.coalesce("new", "importance")).withColumn("in_fast_ring", F.col("in_fast_ring") | (F.col("importance") > 0.6)).drop("new"))
            done.append("pagerank")
        if due(c.prune_every):
            actions = cut(graph.prune_pass(self.nodes, self.resonant_edges(), float(self.seen)))
            state = steps.apply_prune(self.nodes.select("id", "v", F.col("usage_count").alias("usage")), actions)
            gone = cut(state.where("pruned").select("id"))
            rows = self.nodes.drop("v", "usage_count").join(state.where("not pruned").select("id", "v", F.col("usage").alias("usage_count")), "id").join(actions.select("id", "entropy"), "id").withColumn("entropy_score", V.clamp(F.col("entropy")))
            self.nodes = cut(rows.select(*self.nodes.columns))
            self.edges = cut(self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*self.edges.columns))
            self.hyperedges = steps.drop_unfired(self.hyperedges, float(self.seen))
            done.append("prune")
        if c.use_autoencoder and due(c.ae_every):
            model = quality.train_autoencoder(quality.sample_vectors(self.nodes))
            if model is not None:
                scored = self.nodes.join(quality.reconstruction_errors(self.nodes, model), "id")
                entropy, promote = quality.gate(F.col("error"), F.col("usage_count"), F.col("auto_created"), F.col("entropy_score"))
                self.nodes = cut(scored.withColumn("__e", entropy).withColumn("in_fast_ring", F.col("in_fast_ring") | promote).withColumn("entropy_score", F.col("__e")).select(*self.nodes.columns))
                done.append("autoencoder")
        if c.use_pacbayes and due(c.pacbayes_every):
            self.sigma = rank.spectral_norm(self.edges, self.nodes)
            done.append("pacbayes")
        if c.use_spectral and due(c.spectral_every):
            self.coordinates = rank.spectral_coordinates(self.edges, hyper.weighted_degree(self.members, self.hyperedges, self.edges))
            done.append("spectral")
        if done:
            ring = cut(graph.fast_ring(self.nodes.where("in_fast_ring"), c.fast_ring_cap).select("id", F.lit(True).alias("kept")))
            self.nodes = cut(self.nodes.join(ring, "id", "left").withColumn("in_fast_ring", F.coalesce("kept", F.lit(False))).drop("kept"))
            self._resonant = None
        return done

    def generate(self, hint: str = "", n: int = 32) -> DataFrame:
        """``(candidate, nearest, label, novelty)``: new vectors around the nodes whose labels hold ``hint``, those of .15 novelty and more; needs the flag."""
        model = quality.train_generator(quality.sample_vectors(self.nodes)) if self.config.use_vae else None
        held = self.nodes.where(F.contains(F.lower("label"), F.lit(hint.lower()))).select(F.lit(0).alias("k"), "v", F.lit(1.0).alias("one"))
        centre = hyper.vector_sums(held, "k", "v", "one", "v").first() if model is not None else None
        made = quality.candidates(model, V.unit_rows(np.array([centre["v"]]))[0], n) if centre is not None else np.zeros((0, 1))
        self.candidates = self.spark.createDataFrame([(-1 - i, v) for i, v in enumerate(made.tolist())], "id long, v array<double>")
        near = topk.topk_join(self.candidates, self.nodes.select("id", "v"), 1).where(1 - F.col("sim") >= 0.15)
        return near.join(self.nodes.select("id", "label"), "id").select(F.col("q").alias("candidate"), F.col("id").alias("nearest"), "label", (1 - F.col("sim")).alias("novelty"))

    def accept(self, candidate: int, label: str) -> None:
        """Make a node of a generated candidate, with entropy .20; candidates not accepted are simply forgotten."""
        start = self.nodes.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        made = self.candidates.where(F.col("id") == candidate).select(F.lit(start + 1).cast("long").alias("id"), F.lit(label).alias("label"), "v", F.lit(0.20).alias("entropy_score"), F.lit(True).alias("auto_created"))
        self.nodes = cut(self.nodes.unionByName(complete(made)))
        self._resonant = None

    def nearest(self, words: str) -> int | None:
        """The node a text resonates most with."""
        asked = self.spark.createDataFrame([(-1, words)], "id long, text string").select("id", embed("text").alias("v"))
        found = topk.topk_join(asked, self.nodes.select("id", "v"), 1).first()
        return None if found is None else int(found["id"])

    def causal(self, source: int | str, target: int | str, now: str | None = None) -> DataFrame:
        """The cheapest causal path between two nodes, given by id or by text: ``(source, node, cost, strength, hops, path)``; no row if there is none.

        With ``now``, weights of edges that have fired decay up to then; the stored weights stay.
        """
        a, b = (self.nearest(x) if isinstance(x, str) else x for x in (source, target))
        edges = self.edges
        if self.config.use_temporal and now is not None and "last_fired" in edges.columns:
            edges = edges.withColumn("weight", V.temporal_weight(F.col("weight"), F.col("last_fired").cast("timestamp"), F.lit(now).cast("timestamp"), self.config.temporal_lambda))
        return reason.causal_paths(self.spark.createDataFrame([(a,)], "source long"), edges).where(F.col("node") == b)

    def stats(self) -> dict:
        row = self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("entropy_score").alias("entropy"), F.avg("importance").alias("importance"), F.count_if("in_fast_ring").alias("fast"), F.count_if("auto_created").alias("auto")).first()
        return row.asDict() | {"n_edges": self.edges.count(), "n_hyperedges": self.hyperedges.count(), "queries": self.seen, "score": self.score()}

    def graph(self) -> DataFrame:
        """The graph as lines of JSON."""
        return sinks.graph_json(self.nodes.withColumnRenamed("v", "vec"), self.edges, self.members)

    def export(self, path: str) -> None:
        self.graph().select(F.col("json").alias("value")).write.mode("overwrite").text(path)

    def pretty_query(self, words: str) -> str:
        """One query's answer as text."""
        r = self.query(self.spark.createDataFrame([(0, words)], "q long, text string")).first()
        return "\n".join([f"{r['response']} ({r['confidence']:.2f}, {r['lb']:.2f} to {r['ub']:.2f})", *r["chains"][:3]])

    def health(self) -> dict:
        return {"status": "ok"}

    def save(self, path: str, version: int = 1) -> str:
        return sinks.save_snapshot({"nodes": self.nodes, "edges": self.edges, "hyperedges": self.hyperedges, "hyperedge_members": self.members}, path, version)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None, log: str | None = None, **options) -> Engine:
        """A saved graph, with what a change log holds since."""
        tables = sinks.load_snapshot(spark, path, version)
        if log is not None and sinks.log_size(spark, log):
            tables = sinks.folded(tables, spark.read.parquet(log))
            fresh = tables["nodes"].where("v is null and label is not null").select("id", embed("label").alias("fresh"))
            tables["nodes"] = tables["nodes"].join(fresh, "id", "left").withColumn("v", F.coalesce("v", "fresh")).drop("fresh")
        return cls(spark, tables["nodes"], tables["edges"], hyperedges=tables.get("hyperedges"), members=tables.get("hyperedge_members"), **options)


def register(spark: SparkSession) -> None:
    """Register ``ngram_embed(text)``, ``vector_dot(a, b)`` and, as SQL functions that stay in the plan, ``resonance_of(dot, hash_a, hash_b, lang_a, lang_b)`` and ``tokenize(text)``."""
    spark.udf.register("ngram_embed", embed)

    @F.pandas_udf("double")
    def dots(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(x, y)) if x is not None and y is not None and len(x) == len(y) else None for x, y in zip(a, b)])

    spark.udf.register("vector_dot", dots)
    vague = "('LANG_UNKNOWN', 'LANG_MIXED')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION resonance_of(d DOUBLE, ha BIGINT, hb BIGINT, la STRING, lb STRING) RETURNS DOUBLE RETURN CASE WHEN bit_count(ha ^ hb) > 28 THEN 0D ELSE greatest(least(d * CASE WHEN la IS NULL OR lb IS NULL "
        f"OR la IN {vague} OR lb IN {vague} OR la = lb THEN 1D WHEN (la = 'LANG_CODE') <> (lb = 'LANG_CODE') THEN 0.9D ELSE 0.82D END, 1D), 0D) END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), '([\\\\p{Alnum}_]+|[^\\\\s])', 1)")
