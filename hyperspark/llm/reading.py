"""Reading level of documents by a familiar-word formula.

The formula has two kinds of terms: shares of words outside high-frequency lists, and the average sentence
length. A list holds the words that at least ``FAMILIAR_SHARE`` of its corpus' documents hold, so its size is
bounded by the mean number of different words over that share, at any size of the corpus. The plain formula
has one list for a language, from all its documents; it gives ``unfamiliar_share`` and ``plain_score``. Where
hard words are as frequent as easy ones one list can't tell levels apart, so the level comes from one list for
each level, with the level's documents as corpus: four shares and the sentence length, weighted by a softmax
regression on labelled documents (at most ``LABEL_ROWS``). Lists first come from the labelled documents; then
every document of the corpus is counted at the levels the first formula gives it.

Words are numbered by a 32-bit hash; a word that shares its number with a listed one (two in a million at
10,000 listed words) counts as that.

Defined results: null, empty and short texts and texts in other languages get no level; a document labelled
twice counts with each label; without labels no level is given; a document listed more than once gets one
level, that of its longest text, and each of its rows counts in the lists.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import cut, hash_sample, ship

#: The scale, easy to hard, and the languages it holds for.
LEVELS = ("primary", "secondary", "undergraduate", "expert")
LANGUAGES = ("en", "es", "fr", "de", "pt", "it")
#: Bounds of the labelled rows learned from: documents with levels, documents with stated languages.
LABEL_ROWS = 8000
LANGUAGE_ROWS = 3000
LEAST_WORDS = 40
#: The share of a corpus' documents that hold a familiar word.
FAMILIAR_SHARE = 0.05
#: The plain score: fixed weights of the share of unfamiliar words and of the sentence length, and what is added from which share on.
PLAIN_SHARE, PLAIN_LENGTH, PLAIN_ADDED, PLAIN_FROM = 15.79, 0.0496, 3.6365, 0.05
CACHE_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
STOP = re.compile(r"[.!?…]+(?:\s|$)|\n")
N_LEVELS = len(LEVELS)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("​", "").replace("­", ""))


def sentence_count(text: str) -> int:
    return max(1, sum(1 for s in STOP.split(text) if WORD.search(s)))


def number_of(word: str) -> int:
    return zlib.crc32(word.encode())


@dataclass
class Guess:
    """Language by words: log rates of words in each language."""

    rates: dict[str, np.ndarray] = field(default_factory=dict)
    names: tuple[str, ...] = ()


def learn_languages(rows: list[tuple[str, str]]) -> Guess:
    """From texts with stated languages, a few of them wrong; letters of other scripts are words of other languages."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        lang = lang.strip().lower()[:2]
        counts.setdefault(lang, Counter()).update(set(words_of(text)))
    names = tuple(sorted(n for n, c in counts.items() if sum(c.values()) >= 30))
    totals = np.array([sum(counts[n].values()) for n in names], float)
    rates = {}
    for word in {w for n in names for w, k in counts[n].items() if k >= 2}:
        rate = (np.array([counts[n][word] for n in names]) + 0.02) / (totals + 1.0)
        rates[word] = np.maximum(np.log(rate / rate.max()), -4.0).astype(np.float32)
    return Guess(rates, names)


class Reader:
    """Turns texts into word numbers and languages; keeps the numbers and rates of words it has met."""

    def __init__(self, guess: Guess):
        self.guess = guess
        self.place = np.array([LANGUAGES.index(n) if n in LANGUAGES else -1 for n in guess.names], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers = np.zeros(4096, np.int64)
        self.rates = np.zeros((4096, len(self.guess.names)), np.float32)
        self.told = np.zeros(4096, bool)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        for word in set(words).difference(self.known):
            i = self.known[word] = len(self.known)
            if i >= len(self.numbers):
                self.numbers, self.rates, self.told = (np.concatenate([x, np.zeros_like(x)]) for x in (self.numbers, self.rates, self.told))
            self.numbers[i] = number_of(word)
            rate = self.guess.rates.get(word)
            if rate is not None:
                self.rates[i], self.told[i] = rate, True
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the readable texts: their places, languages, numbers of words, and the numbers of their words end to end."""
        rows, lists = [], []
        for i, text in enumerate(texts):
            if text and len(text) >= LEAST_WORDS and len(text.split()) >= LEAST_WORDS and (words := words_of(text)):
                rows.append(i), lists.append(words)
        if not rows or not self.guess.names:
            return (np.zeros(0, np.int64),) * 4
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = self._ids([w for words in lists for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        lang = self.place[np.add.reduceat(self.rates[ids], starts, axis=0).argmax(1)]
        good = (lang >= 0) & np.logical_or.reduceat(self.told[ids], starts)
        return np.array(rows, np.int64)[good], lang[good], lengths[good], self.numbers[ids[np.repeat(good, lengths)]]


@dataclass
class Formula:
    """Words of the lists (``language << 32 | number``, ascending) with the bits of the lists they are in, and the weights of the terms.

    Bits 0 … 3 are the lists of the levels, bit 4 that of the whole language.
    """

    words: np.ndarray
    bits: np.ndarray
    weights: np.ndarray | None = None
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None

    def outside(self, lang: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Shares of the words of each text outside each list (texts × lists)."""
        if not len(lengths) or not len(self.words):
            return np.ones((len(lengths), N_LEVELS + 1))
        codes = np.repeat(lang, lengths) << 32 | numbers
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        bits = np.where(self.words[at] == codes, self.bits[at], 0)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return 1.0 - np.stack([np.add.reduceat(bits >> b & 1, starts) / lengths for b in range(N_LEVELS + 1)], 1)

    def judge(self, terms: np.ndarray) -> np.ndarray:
        """Probabilities of the levels."""
        scores = np.hstack([(terms - self.middle) / self.spread, np.ones((len(terms), 1))]) @ self.weights
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, terms: np.ndarray, levels: np.ndarray, rounds: int = 1500) -> None:
        """Weights of the terms by softmax regression."""
        self.middle, self.spread = terms.mean(0), terms.std(0) + 1e-6
        x = np.hstack([(terms - self.middle) / self.spread, np.ones((len(terms), 1))])
        weights = np.zeros((x.shape[1], N_LEVELS))
        truth = np.eye(N_LEVELS)[levels]
        for _ in range(rounds):
            scores = x @ weights
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weights -= x.T @ (p - truth) / len(x) + 2e-3 * weights
        self.weights = weights


def terms_of(outside: np.ndarray, lengths: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """The terms of the formula: shares outside the levels' lists, and the sentence length."""
    return np.hstack([outside[:, :N_LEVELS], np.log(lengths / sentences + 1)[:, None]])


def frequencies(lang: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document frequencies of words at each level: codes and (words × levels); ``level`` has the levels' probabilities of each text."""
    codes = np.repeat(lang, lengths) << 32 | numbers
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    words, place = np.unique(codes[first], return_inverse=True)
    return words, np.stack([np.bincount(place, level[owner[first], i], len(words)) for i in range(N_LEVELS)], 1)


def lists_of(words: np.ndarray, held: np.ndarray, documents: np.ndarray) -> Formula:
    """The lists of words ``held`` by so many documents at each level, of ``documents`` (languages × levels)."""
    own = documents[words >> 32]
    familiar = np.hstack([held >= FAMILIAR_SHARE * own, (held.sum(1) >= FAMILIAR_SHARE * own.sum(1))[:, None]]) & np.hstack([held > 0, held.sum(1, keepdims=True) > 0])
    bits = (familiar << np.arange(N_LEVELS + 1)).sum(1)
    order = np.argsort(words[bits > 0])
    return Formula(words[bits > 0][order], bits[bits > 0][order])


@dataclass
class Labelled:
    """Labelled documents as :meth:`Reader.read` gives them, with sentence counts and levels."""

    lang: np.ndarray
    lengths: np.ndarray
    numbers: np.ndarray
    sentences: np.ndarray
    levels: np.ndarray

    def part(self, keep: np.ndarray) -> Labelled:
        return Labelled(self.lang[keep], self.lengths[keep], self.numbers[np.repeat(keep, self.lengths)], self.sentences[keep], self.levels[keep])

    def terms(self, formula: Formula) -> np.ndarray:
        return terms_of(formula.outside(self.lang, self.lengths, self.numbers), self.lengths, self.sentences)

    def lists(self) -> Formula:
        level = np.eye(N_LEVELS)[self.levels]
        documents = np.zeros((len(LANGUAGES), N_LEVELS))
        np.add.at(documents, (self.lang, self.levels), 1.0)
        return lists_of(*frequencies(self.lang, self.lengths, self.numbers, level), documents)


def first_formula(labelled: Labelled) -> Formula:
    """Lists and weights from labelled documents; weights are fitted across two halves."""
    whole, halves = labelled.lists(), np.arange(len(labelled.lang)) % 2
    terms = np.zeros((len(halves), N_LEVELS + 1))
    for half in (0, 1):
        terms[halves == half] = labelled.part(halves == half).terms(labelled.part(halves != half).lists())
    whole.fit(terms, labelled.levels)
    return whole


def _read(batches: Iterator[pa.RecordBatch], guess) -> Iterator[pa.RecordBatch]:
    """``(key, lang, sentences, words)`` of the readable texts; ``words`` has the numbers of their words."""
    reader = Reader(guess.value)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        rows, lang, lengths, numbers = reader.read(texts)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers.astype(np.uint32).view(np.int32)))
        sentences = pa.array([sentence_count(texts[i]) for i in rows.tolist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(lang.astype(np.int32)), sentences, words], ["key", "lang", "sentences", "words"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = batch.column(3)
    numbers = words.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.int64)
    return batch.column(1).to_numpy().astype(np.int64), np.asarray(words.value_lengths(), np.int64), batch.column(2).to_numpy().astype(np.int64), numbers


def _counted(batches: Iterator[pa.RecordBatch], formula) -> Iterator[pa.RecordBatch]:
    """``(word, l0 … l3)``: document frequencies of words at each level, by the first formula; the word ``-1 - language`` counts documents."""
    for batch in batches:
        lang, lengths, sentences, numbers = _columns(batch)
        if not len(lang):
            continue
        level = formula.value.judge(terms_of(formula.value.outside(lang, lengths, numbers), lengths, sentences))
        words, held = frequencies(lang, lengths, numbers, level)
        documents = np.stack([np.bincount(lang, level[:, i], len(LANGUAGES)) for i in range(N_LEVELS)], 1)
        words, held = np.concatenate([words, -1 - np.arange(len(LANGUAGES))]), np.concatenate([held, documents])
        yield pa.RecordBatch.from_arrays([pa.array(words), *[pa.array(held[:, i]) for i in range(N_LEVELS)]], ["word", *[f"l{i}" for i in range(N_LEVELS)]])


def _levels(batches: Iterator[pa.RecordBatch], formula) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, lengths, sentences, numbers = _columns(batch)
        outside = formula.value.outside(lang, lengths, numbers)
        p = formula.value.judge(terms_of(outside, lengths, sentences))
        per_sentence, share = lengths / np.maximum(sentences, 1), outside[:, N_LEVELS]
        score = PLAIN_SHARE * share + PLAIN_LENGTH * per_sentence + PLAIN_ADDED * (share > PLAIN_FROM)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([LANGUAGES[i] for i in lang], pa.string()), pa.array(lengths), pa.array(np.round(per_sentence, 4)), pa.array(np.round(share, 6)), pa.array(np.round(score, 4)),
                pa.array([LEVELS[i] for i in p.argmax(1)], pa.string()), pa.array(np.round(p.max(1), 4)),
            ],
            ["key", "lang", "n_words", "sentence_length", "unfamiliar_share", "plain_score", "reading_level", "confidence"],
        )


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "reading_level") -> DataFrame:
    """``(key, lang, n_words, sentence_length, unfamiliar_share, plain_score, reading_level, confidence)`` of every readable document."""
    spark = documents.sparkSession
    ship(spark)
    out = "key bigint, lang string, n_words bigint, sentence_length double, unfamiliar_share double, plain_score double, reading_level string, confidence double"
    rows = documents.where(F.col(key).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    wanted = labels.where(F.lower(F.trim(label)).isin(*LEVELS)).groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_set(F.lower(F.trim(label))).alias("levels"))
    # At most LABEL_ROWS keys with at most four levels each.
    chosen = hash_sample(wanted, "key", LABEL_ROWS, seed=1)
    labelled_rows = sorted({(r["key"], r["text"], level) for r in rows.select("key", "text").join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("text").alias("text"), F.first("levels").alias("levels")).collect() for level in r["levels"]})
    stated = hash_sample(rows.where("trim(lang) <> ''").select("key", "text", "lang"), "key", LANGUAGE_ROWS, seed=2).collect()
    guess = learn_languages(sorted((r["text"], r["lang"]) for r in stated))
    found, own_lang, lengths, numbers = Reader(guess).read([t for _, t, _ in labelled_rows])
    if not len(found):
        return spark.createDataFrame([], out).withColumnRenamed("key", key)
    sentences = np.array([sentence_count(labelled_rows[i][1]) for i in found])
    labelled = Labelled(own_lang, lengths, numbers, sentences, np.array([LEVELS.index(labelled_rows[i][2]) for i in found]))
    context = spark.sparkContext
    guessed, first = context.broadcast(guess), context.broadcast(first_formula(labelled))
    read = cut(rows.select("key", "text").mapInArrow(lambda batches: _read(batches, guessed), "key bigint, lang int, sentences int, words array<int>"))
    counts = read.mapInArrow(lambda batches: _counted(batches, first), "word bigint, l0 double, l1 double, l2 double, l3 double")
    sums = cut(counts.groupBy("word").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(N_LEVELS)]))
    totals = np.zeros((len(LANGUAGES), N_LEVELS))
    for r in sums.where("word < 0").collect():
        totals[-1 - r["word"]] = [r[f"l{i}"] for i in range(N_LEVELS)]
    # Only words of some list reach the driver: at most five lists a language of mean distinct words / FAMILIAR_SHARE words each.
    least = [F.element_at(F.array(*[F.lit(float(x)) for x in FAMILIAR_SHARE * totals[:, i]]), F.shiftright("word", 32).cast("int") + 1) for i in range(N_LEVELS)]
    in_list = F.col("l0") + F.col("l1") + F.col("l2") + F.col("l3") >= sum(least[1:], least[0])
    for i in range(N_LEVELS):
        in_list = in_list | (F.col(f"l{i}") >= least[i])
    listed = sums.where("word >= 0").where(in_list).toPandas().sort_values("word")
    second = lists_of(listed["word"].to_numpy(np.int64), listed[[f"l{i}" for i in range(N_LEVELS)]].to_numpy(float), totals)
    second.fit(labelled.terms(second), labelled.levels)
    final = context.broadcast(second)
    each = read.mapInArrow(lambda batches: _levels(batches, final), out)
    names = [c for c in each.columns if c not in ("key", "n_words")]
    once = each.groupBy("key").agg(F.max(F.struct("n_words", *names)).alias("r"))
    return once.select(F.col("key").alias(key), "r.lang", "r.n_words", *[f"r.{c}" for c in names if c != "lang"])
