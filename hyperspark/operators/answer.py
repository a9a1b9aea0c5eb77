"""Context texts, template answers and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(rows: DataFrame, key: str, order: str, text: str, limit: int, glue: str) -> DataFrame:
    """``(key, text)``: the first ``limit`` texts of a key in order (a report), joined."""
    from pyspark.sql import Window

    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= limit)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t")))), lambda e: e["t"]), glue).alias("text"))


def context_text(concepts: Column, chains: Column, conflicts: Column, confidence: Column) -> Column:
    """Lines of a query's context; parts that are null are left out."""
    line = lambda name, part: F.when(part.isNotNull() & (part != ""), F.concat(F.lit(name + ": "), part))
    return F.concat_ws("\n", line("Concepts", concepts), line("Chains", chains), line("Conflicts", conflicts), F.concat(F.lit("Confidence: "), F.format_number(confidence, 2)))


def ground(answer: Column, conflict: Column, formula: Column, activation: Column) -> tuple[Column, Column]:
    """The answer and whether it is grounded: a conflict is noted and unsettles it; the formula of a strongly active law is added if it isn't there."""
    noted = F.when(conflict, F.concat(answer, F.lit(" Note: the sources conflict."))).otherwise(answer)
    adds = formula.isNotNull() & (activation >= 0.5) & ~F.contains(answer, formula)
    return F.when(adds, F.concat(noted, F.lit(" ["), formula, F.lit("]"))).otherwise(noted), ~F.coalesce(conflict, F.lit(False))
