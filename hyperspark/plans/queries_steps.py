"""Queries of the steps that advance the graph, of built-in knowledge and of small functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.functions import vector as V
from hyperspark.operators import activate, etl, graph, hyper, learn, reason, steps
from hyperspark.plans import oracles as O
from hyperspark.plans.queries_graph import _ACT, _ENDS, _SPREAD, _TURNS, _edges, _levels, _members, _nodes, _resonant, _spread, _turns
from hyperspark.plans.runtime import cut, table
from hyperspark.sources import knowledge

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# --- prune, rewards, memory ------------------------------------------------------------------------------------------

_TIME = 90.0
_PRUNE = f"""{O.VN}, {O.CE}, {O.ER}, sc AS (SELECT *, {_TIME} - coalesce(last_active, 0) AS idle, coalesce(usage_count, 0) AS usage FROM vn),
 en AS (SELECT *, 0.5 * usage / ({_TIME} + 1) + 0.3 * exp(-0.06 * idle) + 0.2 * coalesce(importance, 0) AS ent FROM sc), nb AS (SELECT src AS id, dst AS target, row_number() OVER (PARTITION BY src ORDER BY res DESC, dst) AS k FROM er WHERE res > 0.40),
 ac AS (SELECT en.*, nb.target, CASE WHEN coalesce(in_fast_ring, false) THEN 'keep' WHEN coalesce(auto_created, false) AND usage < 0.5 AND idle > 10 THEN 'drop' WHEN ent < 0.08 AND usage < 3 AND nb.target IS NOT NULL THEN 'merge' ELSE 'keep' END AS act FROM en LEFT JOIN nb ON nb.id = en.id AND nb.k = 1)"""


@query(f"""WITH {_PRUNE}, mg AS (SELECT target, id, v, usage, row_number() OVER (PARTITION BY target ORDER BY id) AS n, count(*) OVER (PARTITION BY target) AS m FROM ac WHERE act = 'merge'),
 pt AS (SELECT target AS id, v, 0.12 * power(0.88, m - n) AS w, 0.35 * usage AS gain FROM mg UNION ALL SELECT id, v, power(0.88, m) AS w, 0.0 AS gain FROM ac JOIN (SELECT DISTINCT target, m FROM mg) t ON t.target = ac.id),
 lg AS (SELECT id, unnest(v) * w AS x, generate_subscripts(v, 1) AS d FROM pt), ad AS (SELECT id, d, sum(x) AS x FROM lg GROUP BY id, d), sm AS (SELECT id, list(x ORDER BY d) AS s FROM ad GROUP BY id), gn AS (SELECT id, sum(gain) AS gain FROM pt GROUP BY id)
 SELECT ac.id, act <> 'keep' AS pruned, round(usage + coalesce(gain, 0), 6) AS usage, round(coalesce(s[1] / sqrt(list_dot_product(s, s)), v[1]), 6) + 0.0 AS first FROM ac LEFT JOIN sm USING (id) LEFT JOIN gn USING (id)""")
def prune_apply(spark, sf_dir):
    """All nodes after a prune pass at time 90: what is gone, usage and vectors of those that took others in."""
    nodes = cut(graph.valid_nodes(_nodes(spark, sf_dir)))
    actions = cut(graph.prune_pass(nodes, _resonant(spark, sf_dir), _TIME))
    out = steps.apply_prune(nodes.select("id", "v", F.col("usage_count").alias("usage")), actions)
    return out.select("id", "pruned", F.round("usage", 6).alias("usage"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("""WITH f AS (SELECT least(greatest(reward, -1.0), 1.0) AS r, list_sort(list_distinct(list_filter(active_nodes, lambda x: x IS NOT NULL)))[1:128] AS held FROM feedback WHERE reward IS NOT NULL AND isfinite(reward)), l AS (SELECT unnest(held) AS id, r FROM f), s AS (SELECT id, sum(r) AS r, sum(greatest(r, 0)) AS g FROM l GROUP BY id),
 o AS (SELECT n.id, least(greatest(coalesce(entropy_score, 0) + 0.06 * coalesce(r, 0), 0), 1) AS e, coalesce(usage_count, 0) + 2 * coalesce(g, 0) AS u, coalesce(g, 0) AS g, coalesce(in_fast_ring, false) AS fast FROM nodes n LEFT JOIN s USING (id)) SELECT id, round(e, 6) AS entropy, round(u, 6) AS usage, g > 0 AND e > 0.70 AND NOT fast AS promoted FROM o""")
def apply_feedback(spark, sf_dir):
    out = steps.node_feedback(_nodes(spark, sf_dir), table(spark, sf_dir, "feedback"))
    return out.select("id", F.round("entropy", 6).alias("entropy"), F.round("usage", 6).alias("usage"), "promoted")


@query(f"""WITH {O.VN}, {O.CE}, {O.ER}, {_levels(3)}, {_SPREAD}, {_ACT}, f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY arrival, node) AS k FROM av WHERE activation > 0.3), ky AS (SELECT q, list(node ORDER BY k) AS key_nodes FROM f WHERE k <= 16 GROUP BY q)
 SELECT id AS q, left(label, 511) AS query, array_to_string(coalesce(key_nodes, []), ',') AS key_nodes FROM vn LEFT JOIN ky ON ky.q = id WHERE id % 20 = 0""")
def episode_store(spark, sf_dir):
    """What each query of the spread would store as an episode; its label stands for its text."""
    rows = cut(_spread(spark, sf_dir))
    first = rows.groupBy("q", "node").agg(F.min(F.col("depth") * 1000000 + F.col("rank")).alias("arrival"))
    asked = graph.valid_nodes(_nodes(spark, sf_dir)).where("id % 20 = 0").select(F.col("id").alias("q"), F.col("label").alias("query"), F.lit("").alias("response"), F.lit(0.0).alias("confidence"))
    return steps.episodes(asked, activate.activations(rows).join(first, ["q", "node"])).select("q", "query", F.array_join(F.transform("key_nodes", lambda x: x.cast("string")), ",").alias("key_nodes"))


@query(f"""WITH RECURSIVE {_TURNS}, tn AS (SELECT session_id, event_id, sig, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS k FROM tv), s AS (SELECT session_id, event_id, k, list_transform(sig, lambda x: x / sqrt(list_dot_product(sig, sig))) AS v FROM tn WHERE k = 1 UNION ALL
  SELECT m.session_id, m.event_id, m.k, list_transform(m.m, lambda x: x / sqrt(list_dot_product(m.m, m.m))) AS v FROM (SELECT tn.session_id, tn.event_id, tn.k, list_transform(list_zip(s.v, tn.sig), lambda z: 0.85 * z[1] + 0.15 * z[2]) AS m FROM s JOIN tn ON tn.session_id = s.session_id AND tn.k = s.k + 1) m)
 SELECT event_id, round(v[1], 6) AS first, round(v[64], 6) AS last FROM s""")
def ctx_update(spark, sf_dir):
    """The session's vector after every turn."""
    turns = _turns(spark, sf_dir).select("session_id", F.struct("turn", "event_id").alias("at"), "sig")
    out = steps.session_vectors(turns, "session_id", "at")
    return out.select(F.col("at.event_id").alias("event_id"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


# --- the query's figures ---------------------------------------------------------------------------------------------


_CHAINS = f"""{_ENDS}, pr AS (SELECT a.q, a.activation AS act, round({O.resonance('va', 'vb')}, 9) AS res, d.weight AS w FROM en a JOIN en b ON a.q = b.q AND a.place < b.place JOIN vn va ON va.id = a.node JOIN vn vb ON vb.id = b.node LEFT JOIN er d ON d.src = a.node AND d.dst = b.node),
 ch AS (SELECT q, least(count(*), 8) AS n FROM pr WHERE CASE WHEN w IS NOT NULL THEN 0.5 * res + 0.5 * w WHEN act >= 0.35 THEN 0.6 * res END >= 0.15 GROUP BY q), {O.HM.split('ac AS')[0].rstrip().rstrip(',')},
 cx AS (SELECT 1.5 * ln(count(*)::DOUBLE / (SELECT count(*) FROM nodes) + 1) AS c FROM m16), fb AS (SELECT count(*) AS n FROM feedback)"""


@query(f"""{_CHAINS}, al AS (SELECT q, count(*) AS n FROM av GROUP BY q), ax AS (SELECT q, count(*) AS hits FROM sp WHERE spike >= 0.03 GROUP BY q),
 r AS (SELECT al.q, al.n AS n_activated, coalesce(ch.n, 0) AS n_chains, hits AS hops_taken, least(0.65 * 0.9 + 0.25 + CASE WHEN coalesce(ch.n, 0) > 0 THEN 0.10 ELSE 0 END, 1.0) AS c, (SELECT CASE WHEN fb.n < 10 THEN 0.5 ELSE sqrt((cx.c + ln(1 / 0.05)) / (2 * fb.n)) END FROM cx, fb) AS b FROM al JOIN ax USING (q) LEFT JOIN ch USING (q))
 SELECT q, n_activated, n_chains, hops_taken, round(n_activated / ((SELECT count(*) FROM nodes) + 1), 6) AS compute_used, round(c, 6) AS confidence, round(greatest(c - b, 0), 6) AS lb, round(least(c + b, 1), 6) AS ub FROM r""")
def query_pipeline(spark, sf_dir):
    """Figures of each query: activated nodes, chains, raw confidence from a best resonance of .9, and its interval by samples seen and complexity."""
    rows = cut(_spread(spark, sf_dir))
    active = cut(activate.activations(rows))
    ends = cut(active.withColumn("activation", F.round("activation", 9)).where("activation >= 0.2").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("activation"), "node"))).where("place <= 16"))
    n = graph.valid_nodes(_nodes(spark, sf_dir)).select("id", "v", "hash", "lang")
    wanted = ends.select("q", F.col("node").alias("a"), F.col("place").alias("p")).join(ends.select("q", F.col("node").alias("b"), F.col("place").alias("r")), "q").where("p < r").select("a", "b").distinct()
    left = n.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("hash").alias("ha"), F.col("lang").alias("la"))
    right = n.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("hash").alias("hb"), F.col("lang").alias("lb"))
    res = wanted.join(left, "a").join(right, "b").select("a", "b", F.round(V.resonance(F.col("va"), F.col("vb"), F.col("ha"), F.col("hb"), F.col("la"), F.col("lb")), 9).alias("res"))
    chains = reason.chains(ends, cut(_resonant(spark, sf_dir)), res).groupBy("q").agg(F.count(F.lit(1)).alias("n_chains"))
    total, seen = _nodes(spark, sf_dir).count(), table(spark, sf_dir, "feedback").count()
    complexity = hyper.complexity(_members(spark, sf_dir), total, 1.5).first()["complexity"]
    by = active.groupBy("q").agg(F.count(F.lit(1)).alias("n_activated"), F.sum("hits").alias("hops_taken")).join(chains, "q", "left").na.fill({"n_chains": 0})
    c, b = learn.raw_confidence(F.lit(0.9), F.col("n_activated"), F.col("n_chains")), learn.pac_bayes_bound(F.lit(complexity), F.lit(seen))
    return by.select("q", "n_activated", "n_chains", "hops_taken", F.round(F.col("n_activated") / (total + 1), 6).alias("compute_used"), F.round(c, 6).alias("confidence"), F.round(V.clamp(c - b), 6).alias("lb"), F.round(V.clamp(c + b), 6).alias("ub"))


# --- growth ----------------------------------------------------------------------------------------------------------

_SYN = (("market", ["bazaar", "trade"]), ("bridge", ["span"]), ("castle", ["fort", "Castle"]))


@query("""WITH t AS (SELECT DISTINCT lower(label) AS a FROM nodes), x(a, b) AS (VALUES ('market', 'bazaar'), ('market', 'trade'), ('bridge', 'span'), ('castle', 'fort'), ('castle', 'castle')) SELECT DISTINCT a, b, 0.78::DOUBLE AS weight, 'SYNONYM' AS type FROM t JOIN x USING (a) WHERE a <> b""")
def synonym_growth(spark, sf_dir):
    return steps.synonym_links(_nodes(spark, sf_dir), spark.createDataFrame(_SYN, "word string, synonyms array<string>"))


@query(f"""WITH a AS (SELECT sample_id AS q, max(query) AS response, max(expected_confidence) AS c FROM samples GROUP BY sample_id), t AS (SELECT q, unnest(l) AS label, generate_subscripts(l, 1) AS i FROM (SELECT q, list_slice({O.tokens('response')}, 1, 64) AS l FROM a WHERE c >= 0.5 AND response IS NOT NULL)),
 f AS (SELECT q, label, min(i) AS i FROM t WHERE length(label) >= 4 AND label NOT IN {O.values(steps.ANSWER_STOPWORDS)} GROUP BY q, label), g AS (SELECT * FROM f WHERE label NOT IN (SELECT lower(label) FROM nodes WHERE label IS NOT NULL)),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY i) AS place, lag(label) OVER (PARTITION BY q ORDER BY i) AS before FROM g) SELECT q, place, label, before FROM k WHERE place <= 6""")
def answer_growth(spark, sf_dir):
    """New terms of answers; the samples' texts stand for answers."""
    answers = table(spark, sf_dir, "samples").groupBy(F.col("sample_id").alias("q")).agg(F.max("query").alias("response"), F.max("expected_confidence").alias("confidence")).withColumn("grounded", F.lit(True))
    return steps.answer_terms(answers, _nodes(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(l) AS label, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_slice({O.tokens('text')}, 1, 128) AS l FROM d)),
 w AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM t WHERE length(label) >= 4 AND label NOT IN {O.values(steps.DOCUMENT_SKIPPED)}), n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 k AS (SELECT doc_id, place, (strlen(label) * 7 + ascii(label) * 37 + ascii(substr(label, 3, 1)) * 11) % 500 AS node FROM w), p AS (SELECT DISTINCT x.node AS a, y.node AS b FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.place BETWEEN x.place - 8 AND x.place - 1 WHERE x.node <> y.node),
 s AS (SELECT a, b, round(least(greatest(list_dot_product(x.v, y.v), 0), 1), 9) AS sim FROM p JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b) SELECT a, b, round(0.7 * sim, 6) AS weight FROM s WHERE sim > 0.25""")
def ingest_document(spark, sf_dir):
    """Links of the terms of all documents; a term's node is told by its letters, so that the vectors of the table can be used."""
    terms = steps.document_terms(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("node", ((F.octet_length("label") * 7 + F.ascii("label") * 37 + F.ascii(F.substring("label", 3, 1)) * 11) % 500).cast("long"))
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))
    return steps.document_links(terms, nodes, "doc_id").withColumn("weight", F.round("weight", 6))


# --- training --------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT 0 AS epoch, 0.05::DOUBLE AS rate UNION ALL SELECT i, greatest(0.05 * power(0.96, i), 0.005) FROM range(1, 80) t(i)) SELECT epoch, round(rate, 9) AS rate, round(least(0.65 + rate, 0.97), 9) AS dense, round(least(0.78 + 0.5 * rate, 0.97), 9) AS causes, round(least(0.80 + 0.5 * rate, 0.97), 9) AS hyperedge, round(least(15 * rate, 1.0), 9) AS good, round(-5 * rate, 9) AS bad FROM r""")
def training_schedule(spark, sf_dir):
    rows = [(n, round(x, 9), *(round(w[k], 9) for k in ("dense", "causes", "hyperedge", "right", "wrong"))) for n, x in steps.training_plan(80, 0.05) for w in (steps.training_weights(x),)]
    return spark.createDataFrame(rows, "epoch int, rate double, dense double, causes double, hyperedge double, good double, bad double")


@query("""WITH s AS (SELECT DISTINCT sample_id, concepts, causal_rule FROM samples), c AS (SELECT sample_id, causal_rule, list_filter(list_transform(concepts, lambda x: lower(trim(x))), lambda x: length(x) >= 2)[1:12] AS c FROM s)
 SELECT c[1] AS first, c[-1] AS last, count(*) AS n, 0.805::DOUBLE AS weight FROM c WHERE len(c) >= 2 AND causal_rule <> '' GROUP BY 1, 2""")
def training_causes(spark, sf_dir):
    """Causal links of a training step at a rate of .05: from the first to the last concept of each sample with a rule."""
    rows = table(spark, sf_dir, "samples").select("sample_id", "concepts", "causal_rule").distinct().where("causal_rule <> ''")
    c = F.slice(F.filter(F.transform("concepts", lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2), 1, 12)
    held = rows.select(c.alias("c")).where("size(c) >= 2")
    return held.groupBy(F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last")).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(round(steps.training_weights(0.05)["causes"], 9)))


@query("""WITH s AS (SELECT lower(trim(domain)) AS domain, sample_id, max(expected_confidence) AS c FROM samples WHERE expected_confidence IS NOT NULL GROUP BY 1, 2), k AS (SELECT domain, least(greatest(0.5 * c + 0.5 * c + 0.04 * 2, 0), 1) AS score FROM s) SELECT domain, count(*) AS n, round(avg(score), 6) AS score, avg(score) >= 0.5 AS passed FROM k GROUP BY domain""")
def benchmark_average(spark, sf_dir):
    rows = table(spark, sf_dir, "samples").where("expected_confidence is not null").groupBy(F.lower(F.trim("domain")).alias("domain"), "sample_id").agg(F.max("expected_confidence").alias("c"))
    score = learn.evaluation_score(F.col("c"), F.lit(None).cast("double"), F.col("c"), F.lit(2))
    by = rows.select("domain", score.alias("score")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return by.select("domain", "n", F.round("mean", 6).alias("score"), (F.col("mean") >= 0.5).alias("passed"))


# --- knowledge -------------------------------------------------------------------------------------------------------


def _literal(x) -> str:
    return O.q(x) if isinstance(x, str) else "NULL" if x is None else str(x)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(n + ': ' + knowledge.MEANING[i])}, 'PHYSICS', {_literal(f)}, {_literal(u)}, {knowledge.IMPORTANCE[i]}::DOUBLE)" for i, (n, f, _, u) in enumerate(knowledge.LAWS)) + ") t(id, label, type, formula, units, importance)")
def physics_nodes(spark, sf_dir):
    return knowledge.physics_nodes(spark).select("id", "label", "type", "formula", "units", "importance")


@query("SELECT c.a, c.b, c.weight, n.label AS from_label FROM (VALUES " + ", ".join(f"({a}, {b}, {w}::DOUBLE)" for a, b, w in knowledge.CODE_LINKS) + ") c(a, b, weight) JOIN (VALUES " + ", ".join(f"({i}, {_literal(x)})" for i, x in enumerate(knowledge.CODE)) + ") n(id, label) ON n.id = c.a")
def code_links(spark, sf_dir):
    labels = knowledge.code_nodes(spark).select(F.col("id").alias("a"), F.col("label").alias("from_label"))
    return knowledge.code_links(spark).join(labels, "a").select("a", "b", "weight", "from_label")


# --- small functions -------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT type, coalesce(CASE regexp_replace(upper(type), '^EDGE_', '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(T.EDGE_TYPES, T.EDGE_PROSE)) + " END, 'unknown') AS prose, coalesce(CASE regexp_replace(upper(type), '^EDGE_', '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(T.EDGE_TYPES, T.EDGE_EXPORT)) + " END, 'unknown') AS export FROM edges")
def edge_type_names(spark, sf_dir):
    return table(spark, sf_dir, "edges").select("type", T.edge_type_name(F.col("type")).alias("prose"), T.edge_type_name(F.col("type"), prose=False).alias("export")).distinct()


@query(f"SELECT doc_id, strlen(text) <= 37 OR ({O.byte_list('text')})[38] & 192 <> 128 AS valid FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def utf8_validity(spark, sf_dir):
    """Whether the first 37 bytes of each text end between two characters."""
    rows = table(spark, sf_dir, "documents").where("text is not null and not contains(text, char(0))")
    return rows.select("doc_id", T.valid_utf8(F.substring(F.encode("text", "UTF-8"), 1, 37)).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id * 900000 + 7 <= 4294967295 THEN event_id * 900000 + 7 ELSE -1 END AS added, CASE WHEN (event_id + 1)::HUGEINT * 1000000000000000 <= 9223372036854775807 THEN ((event_id + 1)::HUGEINT * 1000000000000000)::BIGINT ELSE -1 END AS multiplied FROM events")
def safe_arithmetic(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(-1).cast("long")
    return e.select("event_id", F.coalesce(V.safe_add_u32(F.col("event_id") * 900000, F.lit(7)), none).alias("added"), F.coalesce(V.safe_multiply(F.col("event_id") + 1, F.lit(1000000000000000)), none).alias("multiplied"))


@query(f"WITH {O.VN} SELECT id, round(CASE lang WHEN 'LANG_HINDI' THEN 1.15 WHEN 'LANG_ARABIC' THEN 1.15 WHEN 'LANG_CODE' THEN 0.92 WHEN 'LANG_MIXED' THEN 0.95 ELSE 1.0 END * v[1], 6) + 0.0 AS scaled, round(v[1], 6) + 0.0 AS unit FROM vn")
def language_scaling(spark, sf_dir):
    """The first number of each vector scaled by its language, and after normalising, which cancels the scale."""
    n = cut(graph.valid_nodes(_nodes(spark, sf_dir)).select("id", V.scale(F.col("v"), V.language_scale(F.col("lang"))).alias("s")))
    return n.select("id", F.round(F.get("s", F.lit(0)), 6).alias("scaled"), F.round(F.get(V.normalise(F.col("s")), F.lit(0)), 6).alias("unit"))


@query(f"WITH {O.CE} SELECT ce.src, ce.dst, CASE WHEN (ce.src + ce.dst) % 3 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE l.last_fired END AS last_fired FROM ce JOIN (SELECT src, dst, arg_max(last_fired, (adj_idx, weight, type)) AS x, last(last_fired ORDER BY adj_idx, weight, type) AS last_fired FROM edges WHERE weight IS NOT NULL GROUP BY src, dst) l USING (src, dst)")
def edge_firing(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    fired = edges.where("(src + dst) % 3 = 0").select("src", "dst")
    return steps.fire_edges(edges, fired, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).select("src", "dst", F.col("last_fired").cast("timestamp_ntz").alias("last_fired"))


@query(f"""WITH c AS (SELECT doc_id, {O.clean('text')} AS t FROM documents), w AS (SELECT doc_id, t FROM c WHERE t <> ''), s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS sn FROM (SELECT doc_id, {O.sentences('t')} AS l FROM w)),
 x AS (SELECT doc_id, sn, unnest({O.concept_words('sentence')}) AS term FROM s), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), k AS (SELECT doc_id, term, count(*) AS tf, count(DISTINCT sn) AS df FROM x WHERE term NOT IN {O.values(T.DOCUMENT_STOPWORDS)} GROUP BY doc_id, term),
 r AS (SELECT doc_id, term, tf, round(tf * ln(n / df + 1), 9) AS score FROM k JOIN n USING (doc_id)) SELECT doc_id, term, tf, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id, term LIMIT 15""")
def conversion_top(spark, sf_dir):
    """The fifteen concepts with the highest scores over all documents."""
    found = etl.concepts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.orderBy(F.desc("score"), "doc_id", "term").limit(15).select("doc_id", "term", "tf", F.round("score", 6).alias("score"))
