"""Queries of growth, answers and training exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.functions import vector as V
from hyperspark.operators import answer, grow
from hyperspark.plans import oracles as O
from hyperspark.plans.queries_graph import _embeddings
from hyperspark.plans.runtime import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_LEXICON = (("maintenance", ["maint", "mtn"]), ("comparison", ["vs", "versus", "relation"]), ("market", ["mkt", "bank"]))
_LEX_SQL = "(VALUES ('maint', 'maintenance'), ('mtn', 'maintenance'), ('vs', 'comparison'), ('versus', 'comparison'), ('relation', 'comparison'), ('mkt', 'market'), ('bank', 'market')) lx(token, word)"


@query(f"""WITH q AS (SELECT DISTINCT query FROM samples WHERE query IS NOT NULL), t AS (SELECT query, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT query, {O.tokens('query')} AS l FROM q)),
 e AS (SELECT query, string_agg(coalesce(lx.word, t.token), ' ' ORDER BY i) AS expanded FROM t LEFT JOIN {_LEX_SQL} ON lx.token = t.token GROUP BY query) SELECT query, coalesce(expanded, '') AS expanded FROM q LEFT JOIN e USING (query)""")
def abbreviation_expand(spark, sf_dir):
    queries = table(spark, sf_dir, "samples").select("query").where("query is not null").distinct()
    return grow.expand_abbreviations(queries, "query", "query", spark.createDataFrame(_LEXICON, "word string, abbrevs array<string>"))


_BEST = "b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT x.vec_id AS id, y.vec_id AS near, round(list_dot_product(x.v, y.v), 9) AS sim FROM b x JOIN b y ON y.vec_id % 2 = 0 WHERE x.vec_id % 2 = 1), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, near) AS k FROM s) WHERE k = 1)"


@query(f"WITH {_BEST} SELECT id, CASE WHEN sim > 0.78 THEN 'reuse' WHEN sim > 0.15 THEN 'link' ELSE 'add' END AS action, CASE WHEN sim > 0.15 THEN near END AS nearest, round(CASE WHEN sim > 0.15 AND sim <= 0.78 THEN sim END, 6) AS weight FROM m")
def selfgrow_actions(spark, sf_dir):
    e = cut(_embeddings(spark, sf_dir).select("id", "v"))
    return grow.grow_actions(e.where("id % 2 = 1"), e.where("id % 2 = 0")).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_BEST} SELECT id AS q, round(1 - sim, 6) AS loss FROM m")
def training_loss(spark, sf_dir):
    e = cut(_embeddings(spark, sf_dir).select("id", "v"))
    return grow.query_loss(e.where("id % 2 = 1"), e.where("id % 2 = 0")).withColumn("loss", F.round("loss", 6))


@query(f"""WITH q AS (SELECT DISTINCT query FROM samples WHERE query IS NOT NULL), t AS (SELECT query, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT query, list_slice({O.tokens('query')}, 1, 32) AS l FROM q)),
 k AS (SELECT query, token AS b, lag(token) OVER (PARTITION BY query ORDER BY i) AS a FROM t WHERE length(token) >= 3 AND token NOT IN {O.values(T.GROW_STOPWORDS)}) SELECT a, b, count(*) AS n, 0.55::DOUBLE AS weight FROM k WHERE a IS NOT NULL AND a <> b GROUP BY a, b""")
def query_chains(spark, sf_dir):
    queries = table(spark, sf_dir, "samples").select("query").where("query is not null").distinct()
    return grow.token_chains(queries, "query", "query")


@query("""WITH s AS (SELECT DISTINCT sample_id, concepts FROM samples), c AS (SELECT sample_id, unnest(concepts) AS x, generate_subscripts(concepts, 1) AS i FROM (SELECT *, row_number() OVER () AS rid FROM s)), d AS (SELECT rid, x, min(i) AS i FROM (SELECT rid, lower(trim(unnest(concepts))) AS x, generate_subscripts(concepts, 1) AS i FROM (SELECT *, row_number() OVER () AS rid FROM s)) WHERE x <> '' GROUP BY rid, x),
 f AS (SELECT rid, x FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS k FROM d) WHERE k <= 8) SELECT p.x AS a, q.x AS b, count(*) AS n, 0.7::DOUBLE AS weight FROM f p JOIN f q ON p.rid = q.rid AND p.x < q.x GROUP BY p.x, q.x""")
def training_edges(spark, sf_dir):
    return grow.training_edges(table(spark, sf_dir, "samples").select("sample_id", "concepts").distinct(), "sample_id", "concepts").withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT doc_id, sample_id, max(causal_rule) AS rule, max(expected_confidence) AS c FROM samples WHERE trim(doc_id) <> '' GROUP BY doc_id, sample_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sample_id) AS k FROM s WHERE rule <> ''),
 t AS (SELECT doc_id, string_agg(rule, '; ' ORDER BY k) AS text FROM r WHERE k <= 3 GROUP BY doc_id), a AS (SELECT doc_id, round(avg(c), 6) AS c FROM s GROUP BY doc_id) SELECT doc_id, concat_ws(chr(10), CASE WHEN text <> '' THEN 'Chains: ' || text END, 'Confidence: ' || printf('%.2f', round(coalesce(c, 0) + 1e-9, 2))) AS context FROM a LEFT JOIN t USING (doc_id)""")
def context_text(spark, sf_dir):
    rows = table(spark, sf_dir, "samples").where("trim(doc_id) <> ''").groupBy("doc_id", "sample_id").agg(F.max("causal_rule").alias("rule"), F.max("expected_confidence").alias("c"))
    chains = answer.ordered_text(rows.where("rule <> ''"), "doc_id", "sample_id", "rule", 3, "; ")
    means = rows.groupBy("doc_id").agg(F.round(F.avg("c"), 6).alias("c"))
    none = F.lit(None).cast("string")
    return means.join(chains, "doc_id", "left").select("doc_id", answer.context_text(none, F.col("text"), none, F.round(F.coalesce("c", F.lit(0.0)) + 1e-9, 2)).alias("context"))


@query("""SELECT id, CASE WHEN adds THEN noted || ' [' || formula || ']' ELSE noted END AS answer, NOT c AS grounded FROM (SELECT id, formula, c, CASE WHEN c THEN a || ' Note: the sources conflict.' ELSE a END AS noted, formula IS NOT NULL AND activation >= 0.5 AND NOT contains(a, formula) AS adds FROM
 (SELECT id, formula, activation, coalesce(entropy_score > 0.6, false) AS c, 'About ' || coalesce(label, '') || '.' AS a FROM nodes))""")
def grounded_answers(spark, sf_dir):
    a = F.concat(F.lit("About "), F.coalesce("label", F.lit("")), F.lit("."))
    text, fine = answer.ground(a, F.coalesce(F.col("entropy_score") > 0.6, F.lit(False)), F.col("formula"), F.col("activation"))
    return table(spark, sf_dir, "nodes").select("id", text.alias("answer"), fine.alias("grounded"))


@query("""SELECT domain, n, round(accuracy, 6) AS accuracy FROM (SELECT lower(trim(domain)) AS domain, count(DISTINCT sample_id) AS n, count(DISTINCT sample_id) FILTER (expected_confidence > 0.25)::DOUBLE / count(DISTINCT sample_id) AS accuracy FROM samples GROUP BY 1)""")
def training_summary(spark, sf_dir):
    by = table(spark, sf_dir, "samples").groupBy(F.lower(F.trim("domain")).alias("domain"))
    return by.agg(F.count_distinct("sample_id").alias("n"), F.round(F.count_distinct(F.when(F.col("expected_confidence") > 0.25, F.col("sample_id"))) / F.count_distinct("sample_id"), 6).alias("accuracy"))


@query("""WITH l AS (SELECT vec_id, 'w' || vec_id AS word, embedding::DOUBLE[] AS v FROM embeddings) SELECT word, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 5) AS last FROM l""")
def word_vector_lines(spark, sf_dir):
    """All vectors written as text lines and read back."""
    from hyperspark.sources.text import parse_word_vectors

    lines = table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.transform("embedding", lambda x: x.cast("double").cast("string"))).alias("value"))
    v = parse_word_vectors(lines, 64)
    return v.select("word", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"))
