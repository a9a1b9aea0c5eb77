"""Word-level byte-pair encoding with merge ranks, as an Arrow function with a per-worker cache."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from hyperspark.plans.runtime import ship

END = "</w>"


def fnv(token: str) -> int:
    h = 2166136261
    for b in token.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def split_word(word: str, ranks: dict[tuple[str, str], int]) -> tuple[str, ...]:
    """Symbols of one word after all merges; the last one carries the word end."""
    parts = [*word[:-1], word[-1] + END] if word else []
    while len(parts) > 1:
        rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        left, right, out, i = parts[at], parts[at + 1], [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (left, right):
                out.append(left + right)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return tuple(parts)


def encode(df: DataFrame, text: str, merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``df`` with ``bpe_ids``: ids of the words' symbols, words after the first with a leading blank; unknown symbols get ``fnv % 65280 + 256``.

    ``merges (rank, left, right)`` and ``vocabulary (token, id)`` are a tokenizer's tables, bounded by its vocabulary. Null texts give null.
    """
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    ranks = context.broadcast({(r["left"], r["right"]): r["rank"] for r in merges.collect()})
    ids = context.broadcast({r["token"]: r["id"] for r in vocabulary.collect()})

    @F.pandas_udf(ArrayType(LongType()))
    def encoded(texts: pd.Series) -> pd.Series:
        @lru_cache(100_000)
        def of(word: str) -> tuple[int, ...]:
            return tuple(ids.value.get(p, fnv(p) % 65280 + 256) for p in split_word(word, ranks.value))

        return pd.Series([None if t is None else [i for n, w in enumerate(t.split()) for i in of(w if n == 0 else " " + w)] for t in texts])

    return df.withColumn("bpe_ids", encoded(F.col(text)))


def decode(ids: Column, vocabulary: dict[int, str]) -> Column:
    """Text of ids by a vocabulary ``id → token``: word ends become blanks, the result is trimmed; unknown ids are dropped."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    tokens = F.filter(F.transform(ids, lambda i: F.element_at(table, i)), lambda t: t.isNotNull())
    return F.trim(F.regexp_replace(F.replace(F.array_join(tokens, ""), F.lit(END), F.lit(" ")), " +", " "))
