"""Documents to training samples: concepts, sentence and pair samples, deduplication, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperspark.functions import text as T


def numbered_sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n_sentences, sent_no, sentence)`` of documents with a text; sentences are numbered from 0."""
    rows = documents.where(T.normalise_space(F.col(text)) != "").select(key, T.sentences(T.normalise_space(F.col(text))).alias("__s"))
    return rows.select(key, F.size("__s").alias("n_sentences"), F.posexplode("__s").alias("sent_no", "sentence"))


def concepts(documents: DataFrame, key: str, text: str, most_frequent: int = 500, keep: int = 200) -> DataFrame:
    """``(key, term, tf, df, score, positions, concept_rank)``: a document's terms by ``tf · ln(N/df + 1)``.

    N and df count sentences of the document; only its ``most_frequent`` terms are scored (ties: first met) and ``keep`` of them
    returned; positions are the first five word numbers. Texts without words give no rows.
    """
    # Documents are placed by key once; word numbers are facts of a row, and all that follows stays in place.
    placed = documents.where(T.normalise_space(F.col(text)) != "").select(key, text).repartition(key).select(key, T.sentences(T.normalise_space(F.col(text))).alias("__s"))
    split = placed.select(key, F.size("__s").alias("n_sentences"), F.transform("__s", T.concept_words).alias("__w"))
    numbered = F.flatten(F.transform("__w", lambda words, n: F.transform(words, lambda w: F.struct(n.alias("sent_no"), w.alias("term")))))
    words = split.select(key, "n_sentences", F.posexplode(numbered).alias("pos", "e")).select(key, "n_sentences", "pos", "e.*").where(~F.col("term").isin(T.DOCUMENT_STOPWORDS))
    terms = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.size(F.collect_set("sent_no")).alias("df"), F.max("n_sentences").alias("n_sentences"), F.slice(F.sort_array(F.collect_list("pos")), 1, 5).alias("positions"))
    common = terms.withColumn("__f", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tf"), F.col("positions")[0]))).where(F.col("__f") <= most_frequent)
    scored = common.withColumn("score", F.round(F.col("tf") * F.log(F.col("n_sentences") / F.col("df") + 1), 9))
    ranked = scored.withColumn("concept_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "__f"))).where(F.col("concept_rank") <= keep)
    return ranked.select(key, "term", "tf", "df", "score", "positions", "concept_rank")


def sentence_samples(documents: DataFrame, found: DataFrame, key: str, text: str, top: int = 50, per_document: int = 500) -> DataFrame:
    """``(key, sent_no, query, concepts, keywords, causal_rule, difficulty)``: a sample of each sentence with two or more of the document's top concepts.

    Sentences of 10 to 500 characters count; at most 8 concepts in order, 4 keywords by score, the first ``per_document``
    samples of a document.
    """
    sentences = numbered_sentences(documents, key, text).select(key, "sent_no", F.trim("sentence").alias("sentence")).where(F.length("sentence").between(10, 500))
    words = sentences.select(key, "sent_no", F.posexplode(T.concept_words(F.col("sentence"))).alias("i", "term")).groupBy(key, "sent_no", "term").agg(F.min("i").alias("i"))
    best = found.where(F.col("concept_rank") <= top).select(key, "term", "score")
    held = words.join(best, [key, "term"]).groupBy(key, "sent_no").agg(F.array_sort(F.collect_list(F.struct("i", "term", "score"))).alias("c")).where(F.size("c") >= 2)
    first = F.slice("c", 1, 8)
    by_score = F.array_sort(F.transform(first, lambda e: F.struct((-e["score"]).alias("s"), e["i"].alias("i"), e["term"].alias("term"))))
    average = F.aggregate("c", F.lit(0), lambda n, e: n + F.length(e["term"])) / F.size("c")
    rows = held.join(sentences, [key, "sent_no"]).select(
        key, "sent_no", F.substring("sentence", 1, 255).alias("query"), F.transform(first, lambda e: e["term"]).alias("concepts"), F.transform(F.slice(by_score, 1, 4), lambda e: e["term"]).alias("keywords"),
        T.causal_rule(F.col("sentence")).alias("causal_rule"), F.round(F.least(0.3 + average / 40.0 + F.size("c") / 20.0, F.lit(0.9)), 1).alias("difficulty"),
    )
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("sent_no"))).where(F.col("__n") <= per_document).drop("__n")


def pair_samples(found: DataFrame, key: str, top: int = 40, ahead: int = 5, apart: int = 500, per_document: int = 100) -> DataFrame:
    """``(key, rank_a, rank_b, query, concepts, causal_rule, difficulty)``: each top concept with the next five whose first positions are near."""
    a = found.where(F.col("concept_rank") <= top).select(key, F.col("concept_rank").alias("rank_a"), F.col("term").alias("a"), F.col("positions")[0].alias("pos_a"))
    after = F.explode(F.sequence(F.col("rank_a") + 1, F.col("rank_a") + ahead)).alias("rank_b")
    b = a.select(key, F.col("rank_a").alias("rank_b"), F.col("a").alias("b"), F.col("pos_a").alias("pos_b"))
    pairs = a.select("*", after).join(b, [key, "rank_b"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= apart)
    kept = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("rank_a", "rank_b"))).where(F.col("__n") <= per_document)
    return kept.select(key, "rank_a", "rank_b", F.concat(F.lit("what is the relationship between "), "a", F.lit(" and "), "b").alias("query"), F.array("a", "b").alias("concepts"), F.concat("a", F.lit(" ↔ "), "b").alias("causal_rule"), F.lit(0.4).alias("difficulty"))


def dedup_samples(samples: DataFrame, key: str, order: list[str], query: str = "query") -> DataFrame:
    """The first sample of each document with the same first 80 characters in lower case."""
    w = Window.partitionBy(key, F.lower(F.substring(query, 1, 80))).orderBy(*order)
    return samples.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def convert(documents: DataFrame, key: str, text: str) -> DataFrame:
    """All samples of all documents ``(key, kind, n1, n2, query, concepts, keywords, causal_rule, domain, lang, difficulty, sample_doc)``."""
    found = concepts(documents, key, text)
    clean = T.normalise_space(F.col(text))
    about = documents.where(clean != "").select(key, T.detect_domain(clean).alias("domain"), T.detect_language_by_words(clean).alias("lang"), T.document_id(clean).alias("sample_doc"))
    one = sentence_samples(documents, found, key, text).select(key, F.lit(0).alias("kind"), F.col("sent_no").alias("n1"), F.lit(0).alias("n2"), "query", "concepts", "keywords", "causal_rule", "difficulty")
    two = pair_samples(found, key).select(key, F.lit(1).alias("kind"), F.col("rank_a").alias("n1"), F.col("rank_b").alias("n2"), "query", "concepts", F.col("concepts").alias("keywords"), "causal_rule", "difficulty")
    return dedup_samples(one.union(two), key, ["kind", "n1", "n2"]).join(about, key)


def summary(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(n_documents, n_words, n_sentences)`` of documents with a text."""
    clean = T.normalise_space(F.col(text))
    rows = documents.where(clean != "").select(F.size(F.split(clean, " ")).alias("w"), F.size(T.sentences(clean)).alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("w").alias("n_words"), F.sum("s").alias("n_sentences"))


def cooccurrence(tokens: DataFrame, key: str, order: str, token: str, width: int = 8) -> DataFrame:
    """``(a, b, n)``: how often ``b`` stands within the next ``width`` tokens after ``a`` in the same text, ``a <> b``."""
    near = Window.partitionBy(key).orderBy(order).rowsBetween(-width, -1)
    seen = tokens.select(F.col(token).alias("b"), F.collect_list(token).over(near).alias("before"))
    pairs = seen.select("b", F.explode("before").alias("a")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
