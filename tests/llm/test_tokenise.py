import random

import pytest

from hyperspark.llm import tokenise as T

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    model = T.encoder(T.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


HARD = [
    "", " ", "  ", "\n", "a  b", "a \n b  ", "it's we'll 'tis they've I'd 's's 'll'll ''s !'s a's\n's \t'd", "don't  stop  now", "x\u0085y 'ſ",
    "café naïve 北京 हिन्दी मात्रा Привет ١٢٣ ½ Ⅷ", "<|endoftext|> a<|endoftext|>", "🙂🙂 👩‍👩‍👧 ​﻿", "a'", "'", "''", "a' s", "'re're'r", "   leading", "trailing   ", "tab\t\tend\t", "\r\n\r\n x",
    "x" * 5000, "ab" * 3000, " " * 3000 + "x", "!?" * 900, "é" * 1500,
]


def test_matches_the_public_library_on_hard_cases(exact):
    model = T.encoder(T.default_vocabulary())
    ids, sizes = model.encode_documents(HARD)
    at = 0
    for text, n in zip(HARD, sizes):
        assert ids[at : at + n].tolist() == exact.encode_ordinary(text), repr(text[:60])
        at += n


def test_matches_on_random_text_and_round_trips(exact):
    rng = random.Random(1)
    alphabet = list("aZ09 '\n\t.,!s t re ll 　é北हि🙂'’<|>") + ["'s", "'ll", "  ", "'re "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(3000)]
    model = T.encoder(T.default_vocabulary())
    ids, sizes = model.encode_documents(texts)
    at = 0
    for text, n in zip(texts, sizes):
        got = ids[at : at + n].tolist()
        assert got == exact.encode_ordinary(text), repr(text)
        assert T.decode(got) == text
        at += n


def test_dataframe_defines_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in T.encode(df).collect())
    assert got == [(1, [64, 275]), (2, []), (3, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(df).collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert T.encode(df.limit(0)).count() == 0
