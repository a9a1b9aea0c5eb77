"""Text and vector functions on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperspark.functions import text as T
from hyperspark.functions import vector as V


def one(spark, column, **values):
    from pyspark.sql.types import _infer_type

    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(text):
    return F.lit(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Newton's second LAW", ["newton", "s", "second", "law"]), ("don't", ["don", "t"]), ("see http://A.b/C ok", ["see", "http://A.b/C", "ok"]), ("a->b x+=1; y", ["a", "->", "b", "x", "+=", "1", ";", "y"]),
        ("snake_case  'tis", ["snake_case", "'tis"]), ("", []), ("   ", []), ("café", ["caf", "é"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(lit(text))) == want


def test_tokens_of_null_and_limit(spark):
    assert one(spark, T.tokens(F.lit(None).cast("string"))) is None
    assert one(spark, T.tokens(lit("a b c"), 2)) == ["a", "b"]


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    for s in ("", "a", "concept", "naïve 北"):
        assert one(spark, T.fnv1a(lit(s))) == fnv(s)
    assert one(spark, T.djb2(lit("a"))) == ((5381 * 33) & 0xFFFFFFFF) ^ 97


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "LANG_UNKNOWN"), ("", "LANG_UNKNOWN"), ("plain words of a sentence", "LANG_ENGLISH"), ("这是一个句子", "LANG_CHINESE"), ("Это предложение", "LANG_RUSSIAN"), ("def f(x): return x -> y", "LANG_CODE"),
        ("creo que los dos son de una casa", "LANG_SPANISH"), ("c'est une maison et les enfants", "LANG_FRENCH"), ("ja, der Hund und die Katze", "LANG_GERMAN"), ("medicine energy", "LANG_ENGLISH"),
    ],
)
def test_detect_lang(spark, text, want):
    assert one(spark, T.detect_lang(F.lit(text).cast("string"))) == want


def test_document_language_and_domain(spark):
    assert one(spark, T.detect_language_by_words(lit("the cat is in the house"))) == "LANG_ENGLISH"
    assert one(spark, T.detect_language_by_words(lit("xyz"))) == "LANG_ENGLISH"
    assert one(spark, T.detect_language_by_words(lit("le chat est dans la maison et les enfants"))) == "LANG_FRENCH"
    assert one(spark, T.detect_domain(lit("the gene and the protein of a cell"))) == "biology"
    assert one(spark, T.detect_domain(lit("nothing"))) == "science"


def test_sanitising(spark):
    assert one(spark, T.sanitise_label(lit("a\x01b\tc \x7f "))) == "ab\tc"
    assert one(spark, T.sanitise_label(lit("\x01 "))) == "unknown"
    assert one(spark, T.sanitise_label(F.lit(None).cast("string"))) == ""
    assert one(spark, T.sanitise_prompt(lit("a<|IM_start|>b‮c\x02[/inst]"))) == "abc"
    assert one(spark, T.is_significant(lit("The"))) is False and one(spark, T.is_significant(lit("force"))) is True and one(spark, T.is_significant(lit("12345"))) is False


def test_context_truncation(spark):
    assert one(spark, T.truncate_context(lit("short"), 10)) == "short"
    out = one(spark, T.truncate_context(lit("\n".join(f"line {i}" for i in range(100))), 60))
    assert out.startswith("line 0\n") and out.endswith("line 99") and "[...]" in out


def test_causal_rules(spark):
    assert one(spark, T.causal_rule(lit("Heat causes expansion of gas"))) == "heat → causes → expansion"
    assert one(spark, T.causal_rule(lit("If rain then floods follow"))) == "if rain → then floods"
    assert one(spark, T.causal_rule(lit("it causes the effect; pressure leads to motion"))) == "pressure → leads to → motion"
    assert one(spark, T.causal_rule(lit("nothing here"))) == ""


def test_markup(spark):
    assert one(spark, T.html_text(lit("<p>a &amp; b</p><script>x</script> c"))) == "a b c"
    assert one(spark, T.markdown_text(lit("# T\n- **b** [l](u)"))).split() == ["T", "b", "l"]
    assert one(spark, T.json_escape(lit('a"b\n'))) == 'a\\"b\\n'


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    assert one(spark, V.dot(vec(1, 2), vec(3, 4))) == 11.0
    assert one(spark, V.normalise(vec(3, 4))) == [0.6, 0.8]
    assert one(spark, V.normalise(vec(0, 0))) == [0.0, 0.0]
    assert one(spark, V.entropy(vec(0.5, 0.5, 0.0))) == 1.0
    assert one(spark, V.clamp(F.lit(2.0))) == 1.0 and one(spark, V.relu(F.lit(-1.0))) == 0.0
    assert one(spark, V.dot(vec(1, 2), vec(1))) is None


def test_resonance_and_weights(spark):
    r = lambda la, lb, ha=1, hb=1: one(spark, V.resonance(vec(1, 0), vec(0.5, 0.1), F.lit(ha).cast("bigint"), F.lit(hb).cast("bigint"), F.lit(la), F.lit(lb)))
    assert r("LANG_ENGLISH", "LANG_ENGLISH") == 0.5 and r("LANG_ENGLISH", "LANG_CODE") == 0.45 and math.isclose(r("LANG_ENGLISH", "LANG_GERMAN"), 0.41) and r("LANG_ENGLISH", "LANG_MIXED") == 0.5
    assert r("LANG_ENGLISH", "LANG_ENGLISH", 0, 0xFFFFFFFF) == 0.0
    w = one(spark, V.learn_view_weights(vec(0.33, 0.33, 0.34), vec(0.1, 0.9, 0.3), F.lit(1.0), 0.1))
    assert math.isclose(sum(w), 1.0) and w[1] > w[0]


def test_orthogonal_views(spark):
    rng = np.random.default_rng(0)
    views = np.array(one(spark, V.orthogonal_views(vec(*rng.normal(size=30)))))
    assert np.allclose(views @ views.T, np.eye(3), atol=1e-6)


def test_temporal_weight(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert math.isclose(one(spark, V.temporal_weight(F.lit(0.8), at("2024-01-01 00:00:00"), at("2024-01-01 00:01:00"))), 0.8 * math.exp(-0.012))
    assert one(spark, V.temporal_weight(F.lit(0.8), F.lit(None).cast("timestamp"), at("2024-01-01 00:01:00"))) == 0.8
    assert one(spark, V.temporal_weight(F.lit(0.8), at("2024-01-02 00:00:00"), at("2024-01-01 00:01:00"))) == 0.8


def test_ngram_vectors_match_a_plain_version():
    def plain(text, dim=384):
        out, raw = np.zeros(dim), text.lower().encode()
        for i in range(len(raw)):
            c = [raw[i + k] if i + k < len(raw) else 0 for k in range(3)]
            h = (c[0] << 16 | c[1] << 8 | c[2]) ^ 0x811C9DC5
            for _ in range(2):
                h = ((h ^ h >> 16) * 0x45D9F3B) & 0xFFFFFFFF
            h ^= h >> 16
            phase = (h & 0xFFFF) / 65535 * 6.28318
            out[h % dim] += math.cos(phase)
            out[(h % dim + 1) % dim] += math.sin(phase)
            out[(h % dim + 17) % dim] += 0.5 * math.cos(2 * phase)
        for a, b in zip(raw, raw[1:]):
            h = ((a << 8 | b) * 2654435761) & 0xFFFFFFFF
            out[(h ^ h >> 16) % dim] += 1.5
        for i, w in enumerate(text.lower().replace(".", " ").split()):
            h = 5381
            for b in w.encode():
                h = ((h * 33) & 0xFFFFFFFF) ^ b
            out[h % dim] += 3
            out[(h % dim + 8) % dim] += 1.5
            out[(h % dim + 32) % dim] += 2 / (1 + i * 0.15)
        return out

    texts = ["Quantum mechanics.", "a", "Force equals mass times acceleration"]
    assert np.allclose(V.ngram_vectors(texts), [plain(t) for t in texts])
    assert not V.ngram_vectors(["", None]).any()
    near, far = V.unit_rows(V.ngram_vectors(["quantum mechanics theory", "quantum mechanics law", "banana bread recipe"])) @ V.unit_rows(V.ngram_vectors(["quantum mechanics theory"]))[0], None
    assert near[1] > near[2] and near[1] > 0.1


def test_word_bpe(spark):
    from hyperspark.functions import bpe

    merges = spark.createDataFrame([(0, "l", "o"), (1, "lo", "w</w>"), (2, " ", "lo")], "rank int, left string, right string")
    vocabulary = spark.createDataFrame([("low</w>", 7), ("lo", 8)], "token string, id long")
    df = spark.createDataFrame([("low lo",), (None,), ("",)], "t string")
    got = [r["bpe_ids"] for r in bpe.encode(df, "t", merges, vocabulary).collect()]
    assert got[0][0] == 7 and got[0][-1] == bpe.fnv("o</w>") % 65280 + 256 and got[1] is None and got[2] == []
    assert one(spark, bpe.decode(F.array(F.lit(7), F.lit(9), F.lit(7)), {7: "low</w>"})) == "low low"


def test_vocabulary_embedding(spark):
    from hyperspark.operators import grow

    words = spark.createDataFrame([("red", [1.0, 0.0]), ("car", [0.0, 1.0])], "word string, v array<double>")
    rows = spark.createDataFrame([(1, "Red car"), (2, "unknown"), (3, None)], "k long, t string")
    got = {r["k"]: r["v"] for r in grow.vocabulary_embed(rows, "k", "t", words).collect()}
    weights = np.array([1.1, 1.1 / 1.05])
    assert set(got) == {1} and np.allclose(got[1], weights / np.linalg.norm(weights))
    p = grow.random_projection(8, 2)
    assert np.allclose(np.linalg.norm(p, axis=1), 1) and grow.vocabulary_embed(rows, "k", "t", words, p).count() == 1
