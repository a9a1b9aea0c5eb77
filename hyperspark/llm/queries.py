"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperspark.llm import cooccur, knn, language, mixing, reading, splits, subjects, tokenise, truncation
from hyperspark.llm.sql import SQL
from hyperspark.plans.runtime import table

__all__ = ["QUERIES", "SQL"]


def _splits(spark: SparkSession, sf_dir: str) -> splits.Splits:
    return splits.split_records(table(spark, sf_dir, "samples"), table(spark, sf_dir, "split_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _splits(spark, sf_dir).ids
    return ids.where(F.col("id") != F.col("group")).select(F.col("group").alias("group_doc_id"), F.col("id").alias("doc_id"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).ids.select(F.col("id").alias("doc_id"), F.col("group").alias("group_doc_id"), "split_name")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).shares


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "samples"), table(spark, sf_dir, "conversions")).where("damaged").select("sample_id")


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.damage_by_source(table(spark, sf_dir, "samples"), table(spark, sf_dir, "conversions"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversions, samples = table(spark, sf_dir, "conversions"), table(spark, sf_dir, "samples")
    return conversions.select(F.col("conv_id").alias("record_id"), F.lit("conversions").alias("record_kind"), F.col("plain_text").alias("text"), F.col("lang_detected").alias("stated")).union(
        samples.select("sample_id", F.lit("samples"), F.regexp_replace("query", "\n", " "), "lang")
    )


def _segments(spark: SparkSession, sf_dir: str, only_doubtful: bool = False) -> DataFrame:
    codes, names, code = language.language_names(table(spark, sf_dir, "languages"))
    labelled = table(spark, sf_dir, "samples").select(F.col("query").alias("text"), "lang")
    prose = table(spark, sf_dir, "conversions").select(F.col("plain_text").alias("text"))
    return language.segments(_texts(spark, sf_dir), language.train_on(labelled, prose, names, len(codes), code), codes, names, only_doubtful)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _segments(spark, sf_dir, only_doubtful=True)
    enough = F.when(F.col("main_lang") == "LANG_CHINESE", F.col("text_chars") >= 14).otherwise(F.col("text_words") >= 6)
    lines = found.where("record_kind = 'conversions'").select("record_kind", "record_id", "line_no", "lang_code")
    samples = found.where("record_kind = 'samples'").where((F.col("lang_code") == F.col("main_lang")) & enough)
    return lines.union(samples.select("record_kind", "record_id", "line_no", "lang_code")).distinct()


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).drop("main_lang", "doubtful", "text_words", "text_chars").distinct()


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.record_labels(_segments(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.pair_counts(table(spark, sf_dir, "samples"), min_together=6, min_lift=30.0).select("item_a", "item_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.pair_counts(table(spark, sf_dir, "samples"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_shares(table(spark, sf_dir, "conversions"), table(spark, sf_dir, "domains"), table(spark, sf_dir, "subject_labels"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).where("n_words >= 30 and share >= 0.25").select("conv_id", "subject").distinct()


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir)


def p5_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the corpus by subject."""
    by = _shares(spark, sf_dir).groupBy("subject").agg(F.round(F.sum(F.col("share") * F.col("n_sentences"))).cast("long").alias("n_sentences"), F.count_if(F.col("share") >= 0.25).alias("n_documents"))
    return by.select("subject", "n_documents", "n_sentences", F.round(F.col("n_sentences") / by.agg(F.sum("n_sentences")).scalar(), 6).alias("share"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.nearest(table(spark, sf_dir, "nodes"), k=5, least=0.7)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "nodes"), k=5)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares.where("not reachable").select("source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).documents


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p2_found, p2_sources, p3_found, p3_segments, p3_labels, p4_found, p4_pairs, p5_found, p5_shares, p5_makeup, p6_found, p6_nearest, p7_ids, p8_found, p8_shares, p8_mix, p9_found, p9_levels)}
