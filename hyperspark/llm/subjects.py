"""Subject areas of documents by a seeded non-negative factorisation of the document-term matrix.

One component is anchored for each subject, and one for words of no subject. Seeds come from subjects given by
hand and, with less weight, from stated domains; alternating multiplicative updates (Kullback-Leibler) then run
over all documents: a pass computes each document's mixture with the components fixed and sums the expected
term counts, the sums with the seeds as prior counts are the next components. Mixtures of sentences, with their
document's mixture as prior, give each sentence's subject, and the shares of sentences a document's subjects.

Terms are numbered by a hash into ``BUCKETS``, so the matrix has a bound at every size of the corpus and no term
is left out for being rare in a large one. Texts are read once into term numbers. Lines of program code are told
from prose by the mixture of :mod:`hyperspark.llm.code_lines` over the words and marks of lines, learned by
expectation-maximisation on the lines of all texts; a line of code is one sentence of one term.

Defined results: null, empty and blank texts have no subjects; repeated rows count once, the longest text of a
key stays; sentences without any word of a subject are left out of the shares; labels that name no subject are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.llm.code_lines import CODE_ROUNDS, CODE_SEEDS, CODE_SMOOTHING, CODE_START, MARK, SENTENCE_END, terms_of
from hyperspark.plans.runtime import cut, ship

#: Passes over the corpus, inner updates of a mixture, term numbers, documents that must hold a term number, weight
#: of a subject given by hand against a stated domain, seeds' prior counts.
PASSES = 4
INNER = 12
BUCKETS = 1 << 20
LEAST_DOCUMENTS = 3
HAND_WEIGHT = 4.0
SEED_STRENGTH = 0.15
SENTENCE_PRIOR = 0.6
TIED = 0.4
CACHE_WORDS = 300_000
#: The number of a line of code; terms have higher ones.
CODE_NUMBER = 0
#: Added to the number of a term that its line had before.
REPEATED = 1 << 24
#: Whether an ASCII character is one of the marks that code is told by at first.
IS_MARK = np.array([bool(MARK.match(chr(i))) for i in range(128)])


def number_of(term: str) -> int:
    return 1 + zlib.crc32(term.encode()) % (BUCKETS - 1)


class Reader:
    """Turns texts into the term numbers of their lines and sentences; keeps the numbers of terms it has met."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"\n": 0} | {x: 1 for x in SENTENCE_END}
        self.numbers = np.zeros(4096, np.int32)
        self.used = 2

    def _ids(self, terms: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        for term in set(terms).difference(self.known):
            i = self.known[term] = self.used
            self.used += 1
            if i >= len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.numbers[i] = number_of(term)
        return np.fromiter(map(self.known.__getitem__, terms), np.int64, len(terms))

    def read(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Term numbers of all texts, sentence ends and line ends (within their text), each end to end with their number in each text.

        A term that its line had before has ``REPEATED`` added; the end of a line is doubled, plus 1 if its marks make it code at first.
        """
        lists = [terms_of(t) + ["\n"] for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = self._ids([t for x in lists for t in x])
        document = np.repeat(np.arange(len(texts)), lengths)
        line = np.concatenate([[0], np.cumsum(ids == 0)])[:-1]
        sentence = np.concatenate([[0], np.cumsum(ids < 2)])[:-1]
        line_document, term = document[ids == 0], ids > 1
        document, line, sentence, ids = document[term], line[term], sentence[term], ids[term]
        numbers = self.numbers[ids]
        pairs = line << 32 | ids
        order = np.argsort(pairs, kind="stable")
        numbers[order[1:][pairs[order[1:]] == pairs[order[:-1]]]] += REPEATED
        n_terms = np.bincount(document, minlength=len(texts))
        start = np.cumsum(n_terms) - n_terms
        last = np.concatenate([sentence[1:] != sentence[:-1], [True]])[: len(ids)]
        ends = np.flatnonzero(last) + 1 - start[document[last]]
        # Lines without terms are lines too unless they are blank.
        joined = "".join(t + "\n" for t in texts)
        written = np.array([bool(x.strip()) for x in joined.split("\n")[:-1]], bool)
        characters = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        feeds = np.flatnonzero(characters == 10)
        marks = np.diff(np.cumsum(IS_MARK[np.minimum(characters, 127)])[feeds], prepend=0)
        marked = marks >= CODE_START * (np.diff(feeds, prepend=-1) - 1)
        line_ends = np.cumsum(np.bincount(line, minlength=len(feeds))) - start[line_document]
        lines = (line_ends * 2 + marked)[written]
        return (numbers, n_terms), (ends, np.bincount(document[last], minlength=len(texts))), (lines, np.bincount(line_document[written], minlength=len(texts)))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, stated, n_words, terms, ends, lines)``: what :meth:`Reader.read` gives of each text."""
    reader = Reader()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        words = pa.array([len(t.split()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, *[_lists(*x) for x in reader.read(texts)]], ["key", "stated", "n_words", "terms", "ends", "lines"])


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(column)
    lengths = np.asarray(values.value_lengths().fill_null(0))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _by_line(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the batch (``REPEATED`` taken off), the line of each, whether it is the first of its kind there, and whether each line is code by its marks."""
    terms, lengths = _flat(batch, 2)
    lines, n_lines = _flat(batch, 5)
    stop = (lines >> 1) + np.repeat(np.cumsum(lengths) - lengths, n_lines)
    return terms % REPEATED, np.searchsorted(stop, np.arange(len(terms)), side="right"), terms < REPEATED, (lines & 1).astype(float)


def _few_odds(code: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """What is sent of log odds: those of the term numbers met."""
    there = np.flatnonzero(code[0])
    return there.astype(np.int32), code[0][there].astype(np.float32), code[1]


def _all_odds(few: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, float]:
    odds = np.zeros(BUCKETS)
    odds[few[0]] = few[1]
    return odds, few[2]


def _code_pass(batches: Iterator[pa.RecordBatch], code) -> Iterator[pa.RecordBatch]:
    """Sums of the terms of lines, weighted by the probabilities of code and of prose; at 0 those of the lines."""
    sums = np.zeros((2, BUCKETS))
    odds, prior = (None, 0.0) if code is None else _all_odds(code.value)
    for batch in batches:
        terms, line, first, likely = _by_line(batch)
        terms, line = terms[first], line[first]
        if odds is not None:
            likely = 1 / (1 + np.exp(-np.clip(prior + np.bincount(line, odds[terms], len(likely)), -30, 30)))
        for held, weights in zip(sums, (likely, 1 - likely)):
            held += np.bincount(terms, weights[line], BUCKETS)
            held[CODE_NUMBER] += weights.sum()
    there = np.flatnonzero(sums.any(0))
    yield _sums(there, sums[:, there].T)


def learn_code_of_all(read: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of term numbers in lines of program code against prose, and of code itself: ``code_lines.learn_code`` over all rows of ``read``.

    ``read (key, n_words, terms, ends, seeds, lines)``; a round is one pass over the rows, at most ``BUCKETS`` sums reach the driver.
    """
    context, code = read.sparkSession.sparkContext, None
    given = np.bincount([number_of(t) for x in CODE_SEEDS for t in set(terms_of(x)) - SENTENCE_END], minlength=BUCKETS)
    for _ in range(CODE_ROUNDS):
        shared = None if code is None else context.broadcast(_few_odds(code))
        terms, values = _gathered(read.mapInArrow(lambda batches, shared=shared: _code_pass(batches, shared), "term int, c0 double, c1 double"))
        if shared is not None:
            shared.destroy()
        held = np.zeros((2, BUCKETS))
        held[:, terms] = values.T
        lines = held[:, CODE_NUMBER] + [len(CODE_SEEDS), 0]
        held[:, CODE_NUMBER] = 0.0
        held[0] += given
        seen = held.any(0)
        rates = (held + CODE_SMOOTHING) / (held.sum(1, keepdims=True) + CODE_SMOOTHING * seen.sum())
        code = np.where(seen, np.log(rates[0] / rates[1]), 0.0), float(np.log((lines[0] + 1) / (lines[1] + 1)))
    return code


def _encoded(batches: Iterator[pa.RecordBatch], code) -> Iterator[pa.RecordBatch]:
    """``(key, n_words, terms, ends, seeds)``: term numbers of all sentences end to end, a line of code as one term, and where each sentence ends."""
    odds, prior = _all_odds(code.value)
    for batch in batches:
        terms, line, once, marked = _by_line(batch)
        lengths = _flat(batch, 2)[1]
        ends, n_ends = _flat(batch, 3)
        start, n = np.cumsum(lengths) - lengths, len(lengths)
        document = np.repeat(np.arange(n), lengths)
        sentence = np.searchsorted(ends + np.repeat(start, n_ends), np.arange(len(terms)), side="right")
        # A line counts each of its terms once, as in learning.
        code_line = np.bincount(line[once], odds[terms[once]], len(marked)) + prior > 0
        within = code_line[line]
        first = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
        keep = ~within | first
        document, sentence, numbers = document[keep], sentence[keep], np.where(within, CODE_NUMBER, terms)[keep]
        last = np.concatenate([sentence[1:] != sentence[:-1], [True]])[: len(sentence)]
        n_terms = np.bincount(document, minlength=n)
        stops = np.flatnonzero(last) + 1 - (np.cumsum(n_terms) - n_terms)[document[last]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(numbers, n_terms), _lists(stops, np.bincount(document[last], minlength=n)), batch.column(4)], ["key", "n_words", "terms", "ends", "seeds"])


class Model:
    """Components of the term numbers that count: ``numbers`` ascending, ``rows`` (terms × components).

    Terms at zero in all subjects belong to the last component alone; updates keep that, so they are counted without being mixed.
    """

    def __init__(self, numbers: np.ndarray, rows: np.ndarray):
        self.numbers, self.rows = numbers, rows.astype(np.float32)
        self.mixed = self.rows[:, :-1].any(1)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term; -1 if it doesn't count."""
        at = np.minimum(np.searchsorted(self.numbers, terms), len(self.numbers) - 1)
        return np.where(self.numbers[at] == terms, at, -1)

    def mixtures(self, places: np.ndarray, owner: np.ndarray, counts: np.ndarray, prior: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixtures (owners × components) with the components fixed, the mixed entries, and their parts (entries × components).

        Entries are given as terms' places, owners in ascending order, and counts; ``prior`` (owners × components).
        """
        n, k = prior.shape
        base = prior.astype(np.float32)
        weights = base.copy() + np.float32(1e-6)
        base[:, k - 1] += np.bincount(owner[~self.mixed[places]], counts[~self.mixed[places]], n)
        mixed = np.flatnonzero(self.mixed[places])
        if not len(mixed):
            return base, mixed, np.zeros((0, k), np.float32)
        likely, counts, owner = self.rows[places[mixed]] + np.float32(1e-12), counts[mixed].astype(np.float32), owner[mixed]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows, sizes = owner[first], np.diff(np.append(first, len(owner)))
        weights = weights[rows]
        for _ in range(inner):
            parts = np.repeat(weights, sizes, axis=0)
            parts *= likely
            parts *= (counts / parts.sum(1))[:, None]
            weights = np.add.reduceat(parts, first, axis=0) + base[rows]
        base[rows] = weights
        return base, mixed, parts


def _entries(model: Model | None, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different terms of each document (as places if there is a model), their owners in order, and their counts."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if model is not None:
        terms = model.places(terms)
        owner, terms = owner[terms >= 0], terms[terms >= 0]
    codes = np.sort(owner << 32 | terms)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    once, counts = codes[first], np.diff(np.append(first, len(codes)))
    return once & 0xFFFFFFFF, once >> 32, counts


def _by_term(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    ordered = terms[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def _sums(numbers: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *[pa.array(values[:, j].astype(np.float64)) for j in range(values.shape[1])]], ["term", *[f"c{j}" for j in range(values.shape[1])]])


def _seed_pass(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per term the seeds of the subjects, and the number of documents; a term counts once a document, so that no long document outweighs the others."""
    for batch in batches:
        terms, owner, _ = _entries(None, *_flat(batch, 2))
        seeds, lengths = _flat_seeds(batch, k)
        yield _sums(*_by_term(terms, np.hstack([seeds[owner], np.ones((len(terms), 1))])))


def _flat_seeds(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, int]:
    return np.asarray(batch.column(4).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, k), k


def _update_pass(batches: Iterator[pa.RecordBatch], model, k: int) -> Iterator[pa.RecordBatch]:
    """Expected counts of the mixed terms in each component."""
    for batch in batches:
        terms, lengths = _flat(batch, 2)
        places, owner, counts = _entries(model.value, terms, lengths)
        _, mixed, parts = model.value.mixtures(places, owner, counts, np.full((len(lengths), k + 1), 0.05))
        at, sums = _by_term(places[mixed], parts)
        yield _sums(model.value.numbers[at], sums)


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = np.unique(_flat(batch, 2)[0], return_counts=True)
        yield _sums(terms, counts[:, None])


def _gathered(sums: DataFrame, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums by term, added before and after the shuffle; at most ``BUCKETS`` rows reach the driver."""
    columns = [c for c in sums.columns if c != "term"]
    found = sums.groupBy("term").agg(*[F.sum(c).cast("float").alias(c) for c in columns]).toArrow().sort_by("term")
    terms = found["term"].to_numpy().astype(np.int64)
    values = np.stack([found[c].to_numpy().astype(float) for c in columns], 1)
    if numbers is None:
        return terms, values
    out = np.zeros((len(numbers), len(columns)))
    at = np.minimum(np.searchsorted(numbers, terms), len(numbers) - 1)
    good = numbers[at] == terms
    out[at[good]] = values[good]
    return numbers, out


def start_components(seeds: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """First components from seed counts (k × v): terms tied to one subject go to it, the others to the last component.

    A term whose likeliest subject has less than ``TIED`` of it is at zero in all subjects; updates keep zeros, so
    common words of a language that is rare in the corpus can't drift into a subject.
    """
    k = len(seeds)
    rates = (seeds + 0.02 * frequency / k) / (seeds.sum(1, keepdims=True) + 1.0)
    tied = rates / (rates.sum(0) + 1e-12)
    most = tied.max(0)
    gate = np.where(most < max(TIED, 1.5 / k), 0.0, np.clip((most - 1.5 / k) / (3.0 / k), 0.3, 0.99))
    out = np.vstack([frequency * gate * tied**2, frequency * (1 - gate)])
    return out / (out.sum(1, keepdims=True) + 1e-12)


def _judged(batches: Iterator[pa.RecordBatch], model, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, lengths = _flat(batch, 2)
        ends, sentences = _flat(batch, 3)
        n = len(lengths)
        weights, _, _ = model.value.mixtures(*_entries(model.value, terms, lengths), np.full((n, k + 1), 0.05))
        own = weights[:, :k] / (weights[:, :k].sum(1, keepdims=True) + 1e-12)
        document = np.repeat(np.arange(n), sentences)
        stop = ends + np.concatenate([[0], np.cumsum(lengths)[:-1]])[document] if n else ends
        sentence = np.searchsorted(stop, np.arange(len(terms)), side="right")
        prior = np.hstack([own[document] * SENTENCE_PRIOR, np.full((len(document), 1), 0.3)])
        places = model.value.places(terms)
        found, mixed, parts = model.value.mixtures(places[places >= 0], sentence[places >= 0], np.ones((places >= 0).sum()), prior)
        evidence = np.bincount(sentence[places >= 0][mixed], 1 - parts[:, k], len(document))
        known = evidence > 0.5
        subject = found[:, :k].argmax(1)
        table = np.zeros((n, k))
        np.add.at(table, (document[known], subject[known]), 1.0)
        shares = table / np.maximum(table.sum(1, keepdims=True), 1.0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(shares.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(table.sum(1).astype(np.int64)), lists], ["key", "n_words", "n_sentences", "shares"])


def subject_shares(documents: DataFrame, subjects: DataFrame, labels: DataFrame | None = None, key: str = "conv_id", text: str = "plain_text", stated: str | None = "domain_detected", passes: int = PASSES) -> DataFrame:
    """``(key, n_words, n_sentences, subject, share)``: for each document the share of its sentences about each subject it has.

    ``subjects (subject, …)`` is a small table; ``labels (key, subject)`` are subjects given by hand.
    """
    spark = documents.sparkSession
    ship(spark)
    names = sorted({r[0].strip().lower() for r in subjects.where("subject is not null").select("subject").collect()})
    k = len(names)
    domain = F.lower(F.trim(F.col(stated))) if stated else F.lit(None).cast("string")
    texts = documents.where(F.col(key).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(key).cast("long").alias("key"), domain.alias("stated"), F.col(text).alias("text"))
    context = spark.sparkContext
    read = texts.mapInArrow(_read, "key bigint, stated string, n_words bigint, terms array<int>, ends array<int>, lines array<int>")
    rows = read.groupBy("key").agg(F.max(F.struct("n_words", F.size("terms").alias("size"), "terms", "ends", "lines")).alias("r"), F.max("stated").alias("stated")).select("key", "r.n_words", "r.terms", "r.ends", "r.lines", "stated")
    if labels is not None:
        hand = labels.where("subject is not null").groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_set(F.lower(F.trim("subject"))).alias("hand"))
        rows = rows.join(hand, "key", "left")
    else:
        rows = rows.withColumn("hand", F.lit(None).cast("array<string>"))
    seed = F.array(*[F.when(F.size("hand") > 0, F.array_contains("hand", s).cast("double") * HAND_WEIGHT / F.size("hand")).otherwise(F.coalesce((F.col("stated") == s).cast("double"), F.lit(0.0))) for s in names])
    by_line = cut(rows.select("key", "n_words", "terms", "ends", seed.alias("seeds"), "lines"))
    code = context.broadcast(_few_odds(learn_code_of_all(by_line)))
    encoded = cut(by_line.mapInArrow(lambda batches: _encoded(batches, code), "key bigint, n_words bigint, terms array<int>, ends array<int>, seeds array<double>"))

    def columns(n: int) -> str:
        return ", ".join(["term int", *[f"c{j} double" for j in range(n)]])

    numbers, seeded = _gathered(encoded.mapInArrow(lambda batches: _seed_pass(batches, k), columns(k + 1)))
    counts = (seeded[:, k] >= LEAST_DOCUMENTS) | (numbers == CODE_NUMBER)
    numbers, seeds, frequency = numbers[counts], seeded[counts, :k].T, seeded[counts, k]
    if not len(numbers):
        return spark.createDataFrame([], "key long, n_words long, n_sentences long, subject string, share double").withColumnRenamed("key", key)
    if "code" in names:
        is_code = numbers == CODE_NUMBER
        seeds[:, is_code] = 0.0
        seeds[names.index("code"), is_code] = frequency[is_code]
    anchors = start_components(seeds, frequency)
    components = anchors
    # Terms of the last component alone keep their counts through all passes.
    alone = ~anchors[:k].any(0)
    fixed = _gathered(encoded.mapInArrow(_count_pass, columns(1)), numbers)[1][:, 0] * alone
    for _ in range(passes):
        model = context.broadcast(Model(numbers, components.T))
        sums = _gathered(encoded.mapInArrow(lambda batches, model=model: _update_pass(batches, model, k), columns(k + 1)), numbers)[1].T
        sums[k] += fixed
        mass = sums.sum(1, keepdims=True)
        components = (sums + SEED_STRENGTH * mass * anchors) / (mass * (1 + SEED_STRENGTH) + 1e-12)
    model = context.broadcast(Model(numbers, components.T))
    judged = encoded.mapInArrow(lambda batches: _judged(batches, model, k), "key bigint, n_words bigint, n_sentences bigint, shares array<double>")
    each = judged.select("key", "n_words", "n_sentences", F.posexplode("shares").alias("i", "share")).where("share > 0")
    return each.select(F.col("key").alias(key), "n_words", "n_sentences", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1).alias("subject"), F.round("share", 6).alias("share"))
