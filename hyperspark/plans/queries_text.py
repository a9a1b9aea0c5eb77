"""Queries of text functions and of document conversion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.operators import etl
from hyperspark.plans import oracles as O
from hyperspark.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, t[1] AS first_token, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens(spark, sf_dir):
    t = documents(spark, sf_dir).where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.md5(F.array_join("t", " ")).alias("digest"))


_WORDS = f"SELECT DISTINCT unnest({O.tokens('text')}) AS token FROM documents WHERE text IS NOT NULL"


def _distinct_tokens(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()


@query(f"SELECT token, list_reduce(list_prepend(2166136261::BIGINT, {O.byte_list('token')}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS fnv, list_reduce(list_prepend(5381::BIGINT, {O.byte_list('token')}), lambda h, b: xor((h * 33) & 4294967295, b)) AS djb FROM ({_WORDS})")
def word_hashes(spark, sf_dir):
    return _distinct_tokens(spark, sf_dir).select("token", T.fnv1a(F.col("token")).alias("fnv"), T.djb2(F.col("token")).alias("djb"))


@query(f"SELECT doc_id, {O.detect_lang('text')} AS lang FROM (SELECT doc_id, text, substr(text, 1, 512) AS head, lower(substr(text, 1, 511)) AS low FROM documents)")
def lang_detect(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.detect_lang(F.col("text")).alias("lang"))


@query(f"SELECT doc_id, {O.words_language()} AS lang FROM (SELECT doc_id, substr(text, 1, 2000) AS head, regexp_extract_all({O.plain_words('lower(substr(text, 1, 2000))')}, '\\b[a-z]+\\b') AS words FROM documents WHERE text IS NOT NULL)")
def document_language(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.detect_language_by_words(F.col("text")).alias("lang"))


@query(f"SELECT doc_id, {O.domain('text')} AS domain FROM documents WHERE text IS NOT NULL")
def domain_detect(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.detect_domain(F.col("text")).alias("domain"))


@query("""SELECT id, CASE WHEN label IS NULL THEN '' WHEN s = '' THEN 'unknown' ELSE s END AS label FROM
 (SELECT id, label, regexp_replace(substr(regexp_replace(label, '[\\x00-\\x08\\x0a-\\x1f\\x7f]', '', 'g'), 1, 127), '[ \\t]+$', '') AS s FROM nodes)""")
def label_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "nodes").select("id", T.sanitise_label(F.col("label")).alias("label"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({O.tokens('text')}) AS token FROM documents WHERE text IS NOT NULL) WHERE length(token) BETWEEN 3 AND 50 AND lower(token) NOT IN {O.values(T.STOPWORDS)} AND regexp_matches(token, '[A-Za-z]') GROUP BY token")
def significant_tokens(spark, sf_dir):
    words = documents(spark, sf_dir).where("text is not null").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.where(T.is_significant(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(text || ' <|IM_end|>[inst]', '[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{202A}-\\x{202F}]', '', 'g'), '(?i)<\\|im_start\\|>|<\\|im_end\\|>|\\[INST\\]|\\[/INST\\]|<<SYS>>', '', 'g') AS p FROM documents WHERE text IS NOT NULL)""")
def prompt_sanitise(spark, sf_dir):
    p = documents(spark, sf_dir).where("text is not null").select("doc_id", T.sanitise_prompt(F.concat("text", F.lit(" <|IM_end|>[inst]"))).alias("p"))
    return p.select("doc_id", F.length("p").alias("n"), F.md5("p").alias("digest"))


@query("""SELECT conv_id, md5(CASE WHEN length(t) <= 200 THEN t ELSE (CASE WHEN contains(h, chr(10)) THEN regexp_replace(h, '\\n[^\\n]*$', '') ELSE h END) || chr(10) || '[...]' || chr(10) || (CASE WHEN contains(e, chr(10)) THEN regexp_replace(e, '^[^\\n]*\\n', '') ELSE e END) END) AS digest
 FROM (SELECT DISTINCT conv_id, plain_text AS t, substr(plain_text, 1, 100) AS h, right(plain_text, 100) AS e FROM conversions WHERE plain_text IS NOT NULL)""")
def context_truncate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversions").where("plain_text is not null").select("conv_id", "plain_text").distinct()
    return rows.select("conv_id", F.md5(T.truncate_context(F.col("plain_text"), 200)).alias("digest"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_number(F.col("props"), "k").alias("k"))


@query("SELECT conv_id, line_no, line FROM (SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT DISTINCT conv_id, string_split(regexp_replace(plain_text, '\\r', '', 'g'), chr(10)) AS l FROM conversions WHERE plain_text IS NOT NULL)) WHERE length(line) >= 10")
def text_lines(spark, sf_dir):
    from hyperspark.sources.text import ingest_lines

    rows = table(spark, sf_dir, "conversions").where("plain_text is not null").select("conv_id", "plain_text").distinct()
    return ingest_lines(rows, "conv_id", "plain_text")


_HTML = "'<html><head><STYLE type=\"x\">p {color: red}</STYLE><script>if (a < b) { go(); }</script></head><body><p>' || text || '</p>&nbsp;<b>end</b></body></html>'"


@query(f"SELECT doc_id, md5({O.clean('regexp_replace(regexp_replace(regexp_replace(regexp_replace(' + _HTML + ', $$(?is)<script[^>]*>.*?</script>$$, $$ $$, $$g$$), $$(?is)<style[^>]*>.*?</style>$$, $$ $$, $$g$$), $$<[^>]+>$$, $$ $$, $$g$$), $$&[a-z]+;$$, $$ $$, $$g$$)')}) AS digest FROM documents WHERE text IS NOT NULL")
def html_extract(spark, sf_dir):
    page = F.concat(F.lit('<html><head><STYLE type="x">p {color: red}</STYLE><script>if (a < b) { go(); }</script></head><body><p>'), "text", F.lit("</p>&nbsp;<b>end</b></body></html>"))
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5(T.html_text(page)).alias("digest"))


_MD_STEPS = (("(?s)```.*?```", " "), ("`[^`]+`", " "), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), ("#+[ \\t\\n\\x0b\\f\\r]*", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), ("(?m)^[ \\t\\n\\x0b\\f\\r]*[-*+][ \\t\\n\\x0b\\f\\r]+", ""))


def _markdown_sql() -> str:
    out = "'# Title' || chr(10) || '- **b** and *i* `x` [link](http://a.b) ```c``` ' || text"
    for pattern, by in _MD_STEPS:
        out = f"regexp_replace({out}, {O.q(pattern)}, {O.q(by)}, 'g')"
    return out


@query(f"SELECT doc_id, md5({_markdown_sql()}) AS digest FROM documents WHERE text IS NOT NULL")
def markdown_extract(spark, sf_dir):
    text = F.concat(F.lit("# Title\n- **b** and *i* `x` [link](http://a.b) ```c``` "), "text")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5(T.markdown_text(text)).alias("digest"))


@query(f"SELECT doc_id, substr(md5(substr({O.clean('text')}, 1, 1000)), 1, 8) AS sample_doc FROM documents WHERE text IS NOT NULL")
def doc_md5(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.document_id(T.normalise_space(F.col("text"))).alias("sample_doc"))


@query(f"SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars FROM (SELECT doc_id, unnest({O.sentences(O.clean('text'))}) AS s FROM documents WHERE {O.clean('text')} <> '') WHERE length(s) BETWEEN 10 AND 500 GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    s = etl.numbered_sentences(documents(spark, sf_dir), "doc_id", "text").where(F.length("sentence").between(10, 500))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query(f"SELECT rule, count(*) AS n FROM (SELECT {O.causal('s')} AS rule FROM (SELECT doc_id, unnest({O.sentences(O.clean('text'))}) AS s FROM documents WHERE {O.clean('text')} <> '')) GROUP BY rule")
def causal_rules(spark, sf_dir):
    s = etl.numbered_sentences(documents(spark, sf_dir), "doc_id", "text")
    return s.groupBy(T.causal_rule(F.col("sentence")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


_S = f"""s AS (SELECT doc_id, len(l) AS n_sentences, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_no FROM (SELECT doc_id, {O.sentences(O.clean('text'))} AS l FROM documents WHERE {O.clean('text')} <> '')),
w0 AS (SELECT doc_id, n_sentences, sent_no, {O.concept_words('sentence')} AS l FROM s),
w1 AS (SELECT doc_id, n_sentences, sent_no, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS i FROM w0),
w2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no, i) - 1 AS pos FROM w1),
tm AS (SELECT doc_id, term, count(*) AS tf, count(DISTINCT sent_no) AS df, max(n_sentences) AS n_sentences, list_slice(list(pos ORDER BY pos), 1, 5) AS positions FROM w2 WHERE term NOT IN {O.values(T.DOCUMENT_STOPWORDS)} GROUP BY doc_id, term),
cm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, positions[1]) AS f FROM tm),
cr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f) AS concept_rank FROM (SELECT *, round(tf * ln(n_sentences / df + 1), 9) AS score FROM cm WHERE f <= 500)),
con AS (SELECT doc_id, term, tf, df, score, positions, concept_rank FROM cr WHERE concept_rank <= 200)"""


@query(f"WITH {_S} SELECT doc_id, term, tf, df, round(score, 6) AS score, positions[1] AS first_pos, concept_rank FROM con")
def tfidf_concepts(spark, sf_dir):
    c = etl.concepts(documents(spark, sf_dir), "doc_id", "text")
    return c.select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"), F.col("positions")[0].alias("first_pos"), "concept_rank")


_SS = f"""st AS (SELECT doc_id, sent_no, trim(sentence) AS sentence FROM s WHERE length(trim(sentence)) BETWEEN 10 AND 500),
sw AS (SELECT doc_id, sent_no, term, min(i) AS i FROM w1 GROUP BY doc_id, sent_no, term),
sh AS (SELECT sw.doc_id, sw.sent_no, list({{'i': sw.i, 'term': sw.term, 'score': con.score}} ORDER BY sw.i) AS c FROM sw JOIN con USING (doc_id, term) JOIN st USING (doc_id, sent_no) WHERE con.concept_rank <= 50 GROUP BY sw.doc_id, sw.sent_no HAVING count(*) >= 2),
ss AS (SELECT sh.doc_id, sh.sent_no, substr(st.sentence, 1, 255) AS query, list_transform(list_slice(c, 1, 8), lambda e: e.term) AS concepts,
 list_transform(list_slice(list_sort(list_transform(list_slice(c, 1, 8), lambda e: {{'s': -e.score, 'i': e.i, 'term': e.term}})), 1, 4), lambda e: e.term) AS keywords, {O.causal('st.sentence')} AS causal_rule,
 round(least(0.3::DOUBLE + (list_sum(list_transform(c, lambda e: length(e.term)))::DOUBLE / len(c)) / 40.0::DOUBLE + len(c)::DOUBLE / 20.0::DOUBLE, 0.9::DOUBLE), 1) AS difficulty,
 row_number() OVER (PARTITION BY sh.doc_id ORDER BY sh.sent_no) AS n FROM sh JOIN st USING (doc_id, sent_no))"""


@query(f"WITH {_S}, {_SS} SELECT doc_id, sent_no, query, array_to_string(concepts, '|') AS concepts, array_to_string(keywords, '|') AS keywords, causal_rule, difficulty FROM ss WHERE n <= 500")
def sentence_samples(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = etl.sentence_samples(d, etl.concepts(d, "doc_id", "text"), "doc_id", "text")
    return s.select("doc_id", "sent_no", "query", F.array_join("concepts", "|").alias("concepts"), F.array_join("keywords", "|").alias("keywords"), "causal_rule", "difficulty")


_PS = """ps AS (SELECT a.doc_id, a.concept_rank AS rank_a, b.concept_rank AS rank_b, 'what is the relationship between ' || a.term || ' and ' || b.term AS query, a.term || ' ↔ ' || b.term AS causal_rule,
 row_number() OVER (PARTITION BY a.doc_id ORDER BY a.concept_rank, b.concept_rank) AS n FROM con a JOIN con b ON a.doc_id = b.doc_id AND b.concept_rank BETWEEN a.concept_rank + 1 AND a.concept_rank + 5
 WHERE a.concept_rank <= 40 AND b.concept_rank <= 40 AND abs(a.positions[1] - b.positions[1]) <= 500)"""


@query(f"WITH {_S}, {_PS} SELECT doc_id, rank_a, rank_b, query, causal_rule FROM ps WHERE n <= 100")
def concept_pairs(spark, sf_dir):
    return etl.pair_samples(etl.concepts(documents(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "rank_a", "rank_b", "query", "causal_rule")


@query(f"""WITH {_S}, {_SS}, {_PS}, un AS (SELECT doc_id, 0 AS kind, sent_no AS n1, 0 AS n2, query, causal_rule FROM ss WHERE n <= 500 UNION ALL SELECT doc_id, 1, rank_a, rank_b, query, causal_rule FROM ps WHERE n <= 100)
 SELECT doc_id, kind, n1, n2, query, causal_rule, domain, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(query, 1, 80)) ORDER BY kind, n1, n2) AS k FROM un)
 JOIN (SELECT doc_id, {O.domain('t')} AS domain, {O.words_language()} AS lang FROM (SELECT doc_id, {O.clean('text')} AS t, substr({O.clean('text')}, 1, 2000) AS head, regexp_extract_all({O.plain_words('lower(substr(' + O.clean('text') + ', 1, 2000))')}, '\\b[a-z]+\\b') AS words FROM documents WHERE {O.clean('text')} <> '')) USING (doc_id) WHERE k = 1""")
def converted_samples(spark, sf_dir):
    return etl.convert(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "kind", "n1", "n2", "query", "causal_rule", "domain", "lang")


@query(f"SELECT count(*) AS n_documents, sum(len(string_split({O.clean('text')}, ' ')))::BIGINT AS n_words, sum(len({O.sentences(O.clean('text'))}))::BIGINT AS n_sentences FROM documents WHERE {O.clean('text')} <> ''")
def conversion_summary(spark, sf_dir):
    return etl.summary(documents(spark, sf_dir), "doc_id", "text")


@query(f"""WITH t AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {O.tokens('text')} AS l FROM documents WHERE text IS NOT NULL)),
 g AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM t WHERE length(token) >= 4 AND regexp_matches(token, '[A-Za-z]') AND token NOT IN {O.values(T.INGEST_STOPWORDS)})
 SELECT a.token AS a, b.token AS b, count(*) AS n FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 8 WHERE a.token <> b.token GROUP BY a.token, b.token""")
def cooccurrence_edges(spark, sf_dir):
    t = documents(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "token"))
    words = t.where((F.length("token") >= 4) & F.col("token").rlike("[A-Za-z]") & ~F.col("token").isin(T.INGEST_STOPWORDS))
    return etl.cooccurrence(words, "doc_id", "i", "token")


@query("SELECT sample_id, query, CASE WHEN concepts IS NOT NULL THEN coalesce(array_to_string(concepts, '|'), '') END AS concepts, causal_rule, lower(trim(domain)) AS domain, difficulty FROM (SELECT DISTINCT sample_id, query, concepts, causal_rule, domain, difficulty FROM samples)")
def samples_csv(spark, sf_dir):
    from hyperspark.sources.sinks import csv_rows

    return csv_rows(table(spark, sf_dir, "samples").select("sample_id", "query", "concepts", "causal_rule", "domain", "difficulty").distinct())


@query("SELECT DISTINCT conv_id, chunk_no, substr(plain_text, (chunk_no * 2000 + 1)::INT, 2000) AS chunk FROM (SELECT conv_id, plain_text, unnest(range(0, ((length(plain_text) + 1999) // 2000))) AS chunk_no FROM conversions WHERE length(plain_text) > 0)")
def text_chunks(spark, sf_dir):
    from hyperspark.sources.text import chunks

    return chunks(table(spark, sf_dir, "conversions").select("conv_id", "plain_text"), "conv_id", "plain_text", 2000).distinct()
