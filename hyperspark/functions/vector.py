"""Vector functions on ``array`` columns, computed in double precision and in order of the elements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, left to right; null elements (uneven lengths) give null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once a row, not once an element, where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    return let(doubles(v), lambda w: let(norm(w), lambda n: F.when(n > 1e-12, F.transform(w, lambda x: x / n)).otherwise(w)))


def scale(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def blend(a: Column, b: Column, alpha: float | Column) -> Column:
    """``normalise((1 − alpha) · a + alpha · b)``."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return normalise(let(alpha, lambda k: F.zip_with(doubles(a), doubles(b), lambda x, y: (1 - k) * x + k * y)))


def language_cross(a: Column, b: Column) -> Column:
    """1 for one language or unknown or mixed ones, .90 if exactly one is code, else .82."""
    vague = a.isin("LANG_UNKNOWN", "LANG_MIXED") | b.isin("LANG_UNKNOWN", "LANG_MIXED") | a.isNull() | b.isNull()
    return F.when(vague | (a == b), 1.0).when((a == "LANG_CODE") != (b == "LANG_CODE"), 0.90).otherwise(0.82)


def hashes_near(a: Column, b: Column) -> Column:
    """Whether two 32-bit hashes differ in at most 28 bits."""
    return F.bit_count(a.bitwiseXOR(b)) <= 28


def resonance(vec_a: Column, vec_b: Column, hash_a: Column, hash_b: Column, lang_a: Column, lang_b: Column) -> Column:
    """Clamped dot product weighted by the languages; 0 where the hashes are too far apart."""
    return F.when(hashes_near(hash_a, hash_b), clamp(dot(vec_a, vec_b) * language_cross(lang_a, lang_b))).otherwise(0.0)


def _without(v: Column, other: Column) -> Column:
    """``v`` without its part along the unit vector ``other``."""
    return let(dot(v, other), lambda part: F.zip_with(v, other, lambda x, y: x - part * y))


def _unit(v: Column) -> Column:
    return let(norm(v) + 1e-8, lambda length: F.transform(v, lambda x: x / length))


def orthogonal_views(vec: Column) -> Column:
    """Three equal slices of a vector made orthogonal to each other in order, each of unit length."""
    size = (F.size(vec) / 3).cast("int")
    part = [F.slice(doubles(vec), F.lit(k) * size + 1, size) for k in range(3)]

    def third(first: Column, second: Column) -> Column:
        return let(_without(part[2], first), lambda w: let(_without(w, second), lambda u: F.array(first, second, _unit(u))))

    return let(_unit(part[0]), lambda first: let(_without(part[1], first), lambda w: let(_unit(w), lambda second: third(first, second))))


def multiview_resonance(views_a: Column, views_b: Column, weights_a: Column, weights_b: Column, single: Column, near: Column, n: int = 3) -> Column:
    """``.7 ·`` weighted mean of the clamped view products ``+ .3 ·`` resonance; weights are √(wa · wb) from .01 on."""
    total, sums = F.lit(0.0), F.lit(0.0)
    for k in range(n):
        w = F.sqrt(F.get(weights_a, F.lit(k)) * F.get(weights_b, F.lit(k)))
        w = F.when(w >= 0.01, w).otherwise(0.0)
        total = total + w
        sums = sums + w * clamp(dot(F.get(views_a, F.lit(k)), F.get(views_b, F.lit(k))))
    mixed = clamp(sums / total)
    return F.when(~near, 0.0).when(total <= 0, single).otherwise(0.7 * mixed + 0.3 * single)


def learn_view_weights(weights: Column, products: Column, reward: Column, rate: float) -> Column:
    """The best view's weight moves by ``rate · reward`` (clamped to [.05, .9]); weights are made to sum to 1."""
    step = F.array_position(products, F.array_max(products))

    def moved(best: Column) -> Column:
        return F.transform(doubles(weights), lambda w, i: F.when(i + 1 == best, clamp(w + rate * reward, 0.05, 0.9)).otherwise(w))

    return let(let(step, moved), lambda m: let(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(m, lambda w: w / total)))


def temporal_weight(weight: Column, last_fired: Column, now: Column, rate: float = DEFAULT.temporal_lambda) -> Column:
    """``w · e^(−λ Δt)`` with Δt in seconds; never fired or fired later leaves ``w``."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_fired.cast("timestamp"))) / 1e6
    return F.when(last_fired.isNull() | (seconds <= 0), weight).otherwise(weight * F.exp(-rate * seconds))


def entropy(p: Column) -> Column:
    """Shannon entropy in bits; terms up to 1e-6 are dropped."""
    return F.aggregate(F.transform(doubles(p), lambda x: F.when(x > 1e-6, -x * F.log2(x)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def ngram_vectors(texts: list[str | None], dim: int = DEFAULT.embed_dim) -> np.ndarray:
    """Hashed trigram, bigram and word features of texts (rows × dim, not normalised); null and empty give zeros."""
    out = np.zeros((len(texts), dim))
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    for row, text in enumerate(texts):
        raw = (text or "").encode().translate(lower)
        if not raw:
            continue
        c = np.frombuffer(raw, np.uint8).astype(np.uint64)
        padded = np.concatenate([c, np.zeros(2, np.uint64)])
        h = (padded[:-2] << np.uint64(16)) | (padded[1:-1] << np.uint64(8)) | padded[2:]
        mask = np.uint64(0xFFFFFFFF)
        h ^= np.uint64(0x811C9DC5)
        for _ in range(2):
            h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x45D9F3B)) & mask
        h ^= h >> np.uint64(16)
        place, phase = (h % np.uint64(dim)).astype(int), (h & np.uint64(0xFFFF)).astype(float) / 65535.0 * 6.28318
        pair = (((c[:-1] << np.uint64(8)) | c[1:]) * np.uint64(2654435761)) & mask
        pair ^= pair >> np.uint64(16)
        places, values = [place, (place + 1) % dim, (place + 17) % dim, (pair % np.uint64(dim)).astype(int)], [np.cos(phase), np.sin(phase), 0.5 * np.cos(2 * phase), np.full(len(pair), 1.5)]
        words = [w for w in raw[:511].translate(bytes.maketrans(b"\t\n\r,.!?;:\"'()[]{}", b" " * 17)).split(b" ") if w][:64]
        for i, word in enumerate(words):
            k = 5381
            for b in word:
                k = ((k * 33) & 0xFFFFFFFF) ^ b
            k %= dim
            places.append(np.array([k, (k + 8) % dim, (k + 32) % dim]))
            values.append(np.array([3.0, 1.5, 2.0 / (1.0 + i * 0.15)]))
        out[row] = np.bincount(np.concatenate(places), np.concatenate(values), dim)
    return out


def unit_rows(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=rows.copy(), where=lengths > 1e-12)


#: What a vector is scaled by for its language.
LANGUAGE_SCALE = {"LANG_HINDI": 1.15, "LANG_ARABIC": 1.15, "LANG_CODE": 0.92, "LANG_MIXED": 0.95}


def language_scale(lang: Column) -> Column:
    """Scale of a language, 1 for others; normalising afterwards cancels it."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_SCALE.items() for x in pair])
    return F.coalesce(F.element_at(table, lang), F.lit(1.0))


def safe_add_u32(a: Column, b: Column) -> Column:
    """Sum of two unsigned 32-bit numbers, null if it doesn't fit."""
    return F.when(a + b <= 0xFFFFFFFF, a + b)


def safe_multiply(a: Column, b: Column) -> Column:
    """Product of two numbers, null if it doesn't fit 64 bits."""
    return F.try_multiply(a.cast("long"), b.cast("long"))
