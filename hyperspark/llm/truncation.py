"""Detection of texts that lost their end.

Lengths of every text are recomputed under nine storage forms (characters, UTF-8 bytes, UTF-16 units,
entity-escaped, JSON-escaped, carriage-return line ends). A limit belongs to a source: no text of it is longer
in one form, texts without a closing mark pile up at that length, and the same length is where other sources
stop too (``source_limits``); where a source isn't named, lengths at which the corpus piles up are used
(``hidden_limits``). The odds of a text at its source's limit are the first evidence. Endings are then
inspected: broken characters and entities, open brackets and dangling marks, words that are only beginnings of
known words, and last words after which the corpus goes on (suffix contexts of one to four words counted over
the whole corpus). Where the document itself is at hand, an exact look at what follows the text in it checks
the verdict.

Defined results: null and blank texts are never damaged; a text that ends in a closing mark is whole; the lack
of a final stop alone is no damage; repeated rows count once; a table without the source column is of one
unnamed source; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperspark.llm.splits import file_key
from hyperspark.plans.runtime import cut, ship, skew_join

#: Marks that close a sentence (before closing quotes and brackets), marks no text ends with.
CLOSING = ".!?。！？।॥؟"
QUOTES = "\"'”’»)]}）】」』"
DANGLING = ",;:(—–-[{«“‘/&،、，；：（"
ELLIPSES = ("...", "…")

TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|\.\.\.|[^\s.!?…。！？।॥؟,;:()\[\]{}\"“”«»—–、，；：（）぀-ヿ㐀-鿿]+|[.!?…。！？।॥؟]|\n")
ENDS = set(".!?…。！？।॥؟")
STOPS = ENDS | {*ELLIPSES, "\n"}
ORDERS = 4
BEGINNING_RANK = ORDERS + 1
CACHE_WORDS = 300_000
#: A context needs so many sightings; from which odds on a text counts as cut.
MIN_SIGHTINGS = 4
#: Texts of a document id that has more than so many, and more than this share of all texts, are spread over tasks.
MANY_TEXTS = 64
MANY_SHARE = 0.001
PREFIX_SALT = 0x9E3779B97F4A7C15
#: Bits of the filter of endings that are looked for; fixed whatever their number, so that a full filter only lets more through.
FILTER_BITS = 1 << 24
#: Sources (or texts of one) that must stop at a length, and the highest odds a limit gives.
LEAST_AT_LIMIT = 5
HIGHEST_ODDS = 400.0


def _count(column: Column, what: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(what), F.lit("")))


FORMS = ("chars", "utf8", "utf16", "html", "html_utf8", "json", "json_utf8", "crlf", "crlf_utf8")


def stored_lengths(q: Column) -> Column:
    """Length of a text under each of the ``FORMS``, in their order."""
    chars, utf8 = F.length(q), F.octet_length(q)
    wide = F.when(utf8 == chars, F.lit(0)).otherwise(F.length(q) - F.length(F.regexp_replace(q, r"[\x{10000}-\x{10FFFF}]", "")))
    foreign = F.when(utf8 == chars, F.lit(0)).otherwise(F.length(q) - F.length(F.regexp_replace(q, r"[^\x00-\x7F]", "")))
    special = 4 * _count(q, "&") + 3 * _count(q, "<") + 3 * _count(q, ">") + 5 * _count(q, '"') + 4 * _count(q, "'")
    slashes = F.length(q) - F.length(F.regexp_replace(q, '["\\\\\n\r\t]', ""))
    feeds = _count(q, "\n")
    every = F.array(chars, utf8, chars + wide, chars + special, utf8 + special, chars + slashes + 5 * foreign + 6 * wide, utf8 + slashes, chars + feeds, utf8 + feeds)
    plain = (utf8 == chars) & ~q.rlike("[&<>\"'\\\\\n\r\t]")
    return F.when(plain, F.array_repeat(chars, len(FORMS))).otherwise(every)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) or 1


def _word_id(token: str) -> int:
    """0 for a closing mark, 1 for a line end or dots (which may stand for a lost end), else the hash of the word (numbers are one word); 2 stands before a sentence."""
    if not token:
        return 2
    if token in ELLIPSES or token == "\n":
        return 1
    if token in ENDS:
        return 0
    return max(_hash("#" if token[0].isdigit() else token.lower()), 3)


def _with_beginnings(ids: np.ndarray) -> np.ndarray:
    word = ids > 1
    return np.insert(ids, np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])), np.uint64(2))


def _longer(h: np.ndarray, before: np.ndarray, order: int) -> np.ndarray:
    """Hashes of contexts that take in one more word."""
    h = (h ^ (before + np.uint64(order))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _contexts(ids: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last 1 … ORDERS words at each position; 0 where a closing mark or line end lies within."""
    word = ids > 1
    mixed = np.where(word, ids, 0).astype(np.uint64)
    out, valid = [mixed], word
    for order in range(1, ORDERS):
        before = np.zeros_like(mixed)
        before[order:] = mixed[:-order]
        valid = valid & (before != 0)
        out.append(np.where(valid, _longer(out[-1], before, order), np.uint64(0)))
    return out


class _Words:
    """Numbers of the words met, and the hashes of all their beginnings end to end."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(4096, np.uint64)
        self.starts: list[np.ndarray] = []

    def places(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.starts.clear()
        for token in set(tokens).difference(self.known):
            i = self.known[token] = len(self.known)
            if i >= len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[i] = _word_id(token)
            low = token.lower()
            beginnings = range(1, min(len(low), 40)) if self.ids[i] > 1 and len(token) > 1 and not token[0].isdigit() else ()
            self.starts.append(np.array([_hash(low[:stop]) ^ PREFIX_SALT for stop in beginnings], np.uint64))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))


def _passes(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    at = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0


def _sightings(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
    """``(h, ends, goes_on)`` of suffix contexts that pass the filter; word beginnings under their own hashes with the longer words' counts.

    A text counts as often as it is there.
    """
    words, bits = _Words(), None if wanted is None else wanted.value
    for batch in batches:
        texts = [x for x in batch.column(0).to_pylist() if x]
        places = words.places(TOKEN.findall("\n".join(texts) + "\n"))
        ids = _with_beginnings(words.ids[places])
        following = np.append(ids[1:], np.uint64(1))
        # Only sentences that reach a closing mark tell how texts end.
        marks = np.flatnonzero(ids <= 1)
        whole = (ids[marks] == 0)[np.minimum(np.searchsorted(marks, np.arange(len(ids))), len(marks) - 1)]
        counted = whole & (ids != 2)
        hashes, ends, more = [], [], []
        for h in _contexts(ids):
            at = np.flatnonzero((h != 0) & counted)
            at = at[_passes(bits, h[at])]
            hashes.append(h[at])
            ends.append((following[at] == 0).astype(np.int64))
            more.append(1 - ends[-1])
        seen = np.bincount(places[whole[ids != 2] & (words.ids[places] > 2)], minlength=len(words.starts))
        there = np.flatnonzero(seen)
        if len(there):
            beginnings = np.concatenate([words.starts[i] for i in there])
            counts = np.repeat(seen[there], [len(words.starts[i]) for i in there])
            keep = _passes(bits, beginnings)
            hashes.append(beginnings[keep])
            ends.append(np.zeros(int(keep.sum()), np.int64))
            more.append(counts[keep])
        names, place = np.unique(np.concatenate(hashes), return_inverse=True)
        out = [names.view(np.int64), np.bincount(place, np.concatenate(ends), len(names)).astype(np.int64), np.bincount(place, np.concatenate(more), len(names)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["h", "ends", "goes_on"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, rank, h)`` of the unfinished sentence of each text.

    Ranks 1 … ORDERS are the contexts of its end, rank 0 its last word as a beginning of longer words,
    BEGINNING_RANK its first two words as the beginning of a sentence.
    """
    words = _Words()
    for batch in batches:
        keys, picked, last = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = TOKEN.findall(text)
            first = next((i + 1 for i in range(len(tokens) - 1, -1, -1) if tokens[i] in STOPS), 0)
            tokens = tokens[first:]
            if tokens:
                keys.append(key), last.append(_hash(tokens[-1].lower()) ^ PREFIX_SALT)
                # The last words, the latest first, then the first two; "" stands before a sentence.
                picked += [*reversed(([""] * (len(tokens) < ORDERS) + tokens)[-ORDERS:]), *["\n"] * max(0, ORDERS - 1 - len(tokens)), tokens[0], tokens[1] if len(tokens) > 1 else ""]
        # The places come first: words met here may replace the array of ids by a longer one.
        places = words.places(picked)
        table = words.ids[places].reshape(-1, ORDERS + 2)
        table = np.where(table == 1, np.uint64(0), table)
        h, ranks, hashes, owner = table[:, 0], [], [], []
        for rank in range(1, ORDERS + 1):
            if rank > 1:
                h = np.where((h != 0) & (table[:, rank - 1] != 0), _longer(h, table[:, rank - 1], rank - 1), np.uint64(0))
            there = np.flatnonzero(h)
            owner.append(there), hashes.append(h[there]), ranks.append(np.full(len(there), rank))
        one, two = table[:, ORDERS], table[:, ORDERS + 1]
        start = np.uint64(2)
        beginning = np.where(two == 2, _longer(one, np.full(len(one), start), 1), _longer(_longer(two, one, 1), np.full(len(one), start), 2))
        for rank, h in ((0, np.array(last, np.uint64)), (BEGINNING_RANK, beginning)):
            owner.append(np.arange(len(keys))), hashes.append(h), ranks.append(np.full(len(keys), rank))
        own = np.array(keys, np.int64)[np.concatenate(owner)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(ranks).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], ["key", "rank", "h"])


def _with_neighbours(counts: DataFrame, *groups: str) -> DataFrame:
    """Adds to ``(groups, length, n)`` what a length without a limit would hold, ``base``, from the lengths near it.

    Each count is sent to the lengths it is near to, so no group's lengths meet in one task.
    """
    sent = counts.select(*groups, F.explode(F.sequence(F.lit(-14), F.lit(14))).alias("d"), "length", "n").select(*groups, (F.col("length") + F.col("d")).alias("length"), "d", "n")
    far, above = F.abs("d") >= 4, F.col("d").between(-3, -1)
    summed = sent.groupBy(*groups, "length").agg(
        F.max(F.when(F.col("d") == 0, F.col("n"))).alias("n"), (F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)) / 22.0).alias("near"), (F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)) / 3.0).alias("beside")
    )
    return summed.where("n is not null").select(*groups, "length", "n", F.greatest("near", "beside").alias("base"))


def _form(i: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in FORMS]), F.col(i) + 1).alias("form")


def _piles_up(n: str = "n", base: str = "base") -> Column:
    return (F.col(n) >= LEAST_AT_LIMIT) & (F.col(n) > 4 * F.col(base) + 3 * F.sqrt(F.col(base) + 1)) & (F.col("length") >= 16)


def hidden_limits(open_texts: DataFrame) -> DataFrame:
    """``(form, shape, length, odds)``: lengths at which texts of one shape pile up. ``open_texts`` holds ``q`` and ``shape``, and may hold their lengths ``l``."""
    lengths = open_texts.select("shape", F.posexplode("l" if "l" in open_texts.columns else stored_lengths(F.col("q"))).alias("i", "length")).select("shape", _form("i"), F.col("length").cast("long"))
    counts = lengths.groupBy("form", "shape", "length").agg(F.count(F.lit(1)).alias("n"))
    return _with_neighbours(counts, "form", "shape").where(_piles_up()).select("form", "shape", "length", ((F.col("n") - F.col("base")) / (F.col("base") + 0.5)).alias("odds"))


def source_limits(rows: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The limits of sources ``(file, form, length, n_at, odds)``, and ``(key, file, form, odds)`` of the texts at them.

    ``rows`` holds every text as ``(source, q)``, ``candidates`` those without a closing mark as ``(key, file, q, l)``.
    A source's longest length in a form is its limit if other sources stop there too with several texts, far more of
    them than at the lengths around, or if its own texts pile up there. Copies of a text count once.
    """
    most = [f"m{i}" for i in range(len(FORMS))]
    as_written = rows.where("source is not null").withColumn("l", stored_lengths(F.col("q"))).groupBy("source").agg(*[F.max(F.col("l")[i]).alias(m) for i, m in enumerate(most)])
    longest = as_written.withColumn("file", _file_of(F.col("source"))).where("file is not null").groupBy("file").agg(*[F.max(m).cast("long").alias(m) for m in most])
    # A byte limit may drop the whole last character, so up to three bytes less also count where characters are long.
    slack = F.when(F.octet_length("q") > 1.5 * F.length("q"), 3).otherwise(0)
    own = candidates.where("file is not null").select("key", "file", F.xxhash64("q").alias("t"), slack.alias("slack"), "l")
    gaps = [F.struct(F.lit(name).alias("form"), F.col(f"m{i}").alias("length"), (F.col(f"m{i}") - F.col("l")[i]).alias("gap"), (F.col("slack") if "utf8" in name else F.lit(0)).alias("slack")) for i, name in enumerate(FORMS)]
    near = cut(skew_join(own, longest, "file", salt_by="key").select("key", "file", "t", F.explode(F.filter(F.array(*gaps), lambda g: (g["gap"] <= 14) & (g["length"] >= 16))).alias("g")).select("key", "file", "t", "g.*"))
    near = near.withColumn("at", F.col("gap") <= F.col("slack"))
    stops = near.groupBy("file", "form", "length").agg(F.count_distinct(F.when(F.col("at"), F.col("t"))).alias("n_at"), (F.count_if((F.col("gap") >= 4) & ~F.col("at")) / 11.0).alias("around")).where("n_at > 0")
    # A source with one text at its longest length tells nothing of limits; at lengths where most sources have several it shares in them.
    several = stops.groupBy("form", "length").agg(F.count_if(F.col("n_at") >= 2).alias("n"), F.count(F.lit(1)).alias("n_sources")).where("n > 0")
    shared = _with_neighbours(several, "form").where(_piles_up()).join(several.drop("n"), ["form", "length"])
    by_others = (F.col("n") - F.col("base")) / (F.col("base") + 0.5) * F.when(F.col("n_at") >= 2, F.col("n_at")).otherwise(0.5 * F.col("n") / F.col("n_sources"))
    by_own = F.when(_piles_up("n_at", "around"), (F.col("n_at") - F.col("around")) / (F.col("around") + 0.5))
    limits = stops.join(shared, ["form", "length"], "left").select("file", "form", "length", "n_at", F.least(F.coalesce(F.greatest(by_others, by_own), F.lit(0.0)), F.lit(HIGHEST_ODDS)).alias("odds")).where("odds > 0")
    limits = cut(limits.withColumn("limit", F.xxhash64("file", "form")))
    texts = skew_join(near.where("at").withColumn("limit", F.xxhash64("file", "form")).select("key", "limit"), limits.select("limit", "form", "odds"), "limit", salt_by="key")
    return limits.drop("limit"), texts.groupBy("key").agg(F.max("odds").alias("source_odds"))


def _file_of(source: Column) -> Column:
    @F.pandas_udf("string")
    def named(values: pd.Series) -> pd.Series:
        return values.map({x: file_key(x) for x in values.unique()})

    return named(source)


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes; one row for each of at most ``FILTER_BITS / 64`` words reaches the driver."""
    found = hashes.selectExpr(f"shiftright(h & {FILTER_BITS - 1}, 6) as w", "shiftleft(1L, cast(h & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return bits


class Verdicts:
    """The result of :func:`judge`: ``verdicts (key, damaged, evidence)`` and ``limits`` of sources."""

    def __init__(self, verdicts: DataFrame, limits: DataFrame):
        self.verdicts, self.limits = verdicts, limits


def judge(records: DataFrame, corpus: DataFrame | None = None, record: str = "sample_id", text: str = "query", document: str = "doc_id", corpus_document: str = "doc_id", corpus_text: str = "plain_text", source: str = "source", use_lengths: bool = True) -> Verdicts:
    """Verdicts on the texts without a closing mark; ``evidence`` is what decided: ``limit``, ``broken``, ``document``, ``word`` or ``ending``."""
    ship(records.sparkSession)
    written = F.col(source).cast("string") if source in records.columns else F.lit(None).cast("string")
    rows = records.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("key"), F.rtrim(F.col(text)).alias("q"), F.col(document).cast("string").alias("doc"), written.alias("source"))
    closing = f"[{re.escape(CLOSING)}][{re.escape(QUOTES)}]*$"
    dots = F.col("q").rlike(r"(\.\.\.|…)$")
    shape = F.when(dots, "dots").when(F.col("q").rlike(closing) | F.col("q").rlike(r"\([^()]*\)$"), "closed").otherwise("open")
    rows = rows.where(F.col("q") != "").withColumn("shape", shape)
    once = rows.where("shape <> 'closed'").groupBy("key").agg(F.max(F.struct(F.length("q"), "q", "doc", "shape", "source")).alias("r")).select("key", "r.q", "r.doc", "r.shape", "r.source")
    candidates = cut(once.select("key", "q", "doc", "shape", _file_of(F.col("source")).alias("file"), stored_lengths(F.col("q")).alias("l")))

    # Evidence 1: a limit of the text's source; for texts of unnamed sources, a pile-up in the corpus.
    limits, at_source = source_limits(rows, candidates)
    unnamed = candidates.where("file is null")
    at_limit = unnamed.select("key", "shape", F.posexplode("l").alias("i", "length")).select("key", "shape", _form("i"), "length").join(hidden_limits(candidates), ["form", "shape", "length"]).groupBy("key").agg(F.max("odds").alias("corpus_odds"))

    # Evidence 2: how the corpus goes on after such an ending.
    core = F.rtrim(F.regexp_replace("q", r"(\.\.\.|…)$", ""))
    candidates = candidates.withColumn("core", core)
    texts = rows.select("q")
    if corpus is not None:
        texts = texts.union(corpus.where(F.col(corpus_text).isNotNull()).select(corpus_text))
    tails = cut(candidates.select("key", "core").mapInArrow(_tails, "key bigint, rank int, h bigint"))
    wanted = records.sparkSession.sparkContext.broadcast(_filter_of(tails.select("h")))
    counts = texts.mapInArrow(lambda batches: _sightings(batches, wanted), "h bigint, ends bigint, goes_on bigint").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    seen = skew_join(tails, counts, "h", "left", salt_by="key").select("key", "rank", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("goes_on", F.lit(0)).alias("goes_on"))
    sighted = F.col("ends") + F.col("goes_on") >= MIN_SIGHTINGS
    endings = seen.groupBy("key").agg(
        F.max(F.when(F.col("rank") == 1, F.col("ends") + F.col("goes_on"))).alias("word_n"),
        F.max(F.when(F.col("rank") == 0, F.col("goes_on"))).alias("longer_n"),
        F.max(F.when(F.col("rank") == BEGINNING_RANK, F.col("ends") + F.col("goes_on"))).alias("beginning_n"),
        F.max_by(F.struct("rank", "ends", "goes_on"), F.when(F.col("rank").between(1, ORDERS) & sighted, F.col("rank"))).alias("context"),
    )

    # Evidence 3: what follows the text in its own document.
    judged = candidates.join(at_source, "key", "left").join(at_limit, "key", "left").join(endings, "key", "left")
    if corpus is not None:
        texts = corpus.where(F.col(corpus_text).isNotNull() & F.col(corpus_document).isNotNull()).select(F.col(corpus_document).cast("string").alias("doc"), F.col(corpus_text).alias("body"))
        cores = candidates.where(F.col("doc").isNotNull() & (F.length("core") >= 8)).select("key", "doc", "core")
        counts = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        # At most 1 / MANY_SHARE ids, so safe to broadcast. Their texts are spread, all others' candidates where these are many.
        many = F.broadcast(cut(counts.where((F.col("n") > MANY_TEXTS) & (F.col("n") > counts.agg(F.sum("n")).scalar() * MANY_SHARE)).select("doc")))
        few_texts = skew_join(cores.join(many, "doc", "left_anti"), texts.join(many, "doc", "left_anti"), "doc", salt_by="key")
        many_texts = skew_join(texts.join(many, "doc", "left_semi").distinct(), cores.join(many, "doc", "left_semi"), "doc", salt_by="body")
        pairs = few_texts.select("key", "core", "body").union(many_texts.select("key", "core", "body")).where(F.col("body").contains(F.col("core")))
        body = F.concat("body", F.lit("\n"))
        ends_there = F.lit(False)
        for mark in [*CLOSING, "…", "\n", ":", " (", " —", " –"]:
            ends_there = ends_there | F.contains(body, F.concat("core", F.lit(mark)))
        follows = pairs.groupBy("key").agg(F.max(ends_there).alias("ends_there")).select("key", F.when(F.col("ends_there"), "ends").otherwise("goes_on").alias("there"))
        judged = judged.join(follows, "key", "left")
    else:
        judged = judged.withColumn("there", F.lit(None).cast("string"))

    broken = F.col("core").rlike(r"�$|&#?\w{0,7}$") | F.col("core").rlike(f"[{re.escape(DANGLING)}]$")
    # A heading begins as no sentence does; how sentences go on says nothing about it.
    sentence = F.coalesce("beginning_n", F.lit(0)) > 0
    word_n = F.coalesce("word_n", F.lit(0))
    part_of_word = sentence & (word_n * 100 < F.coalesce("longer_n", F.lit(0))) & (F.coalesce(F.col("context.rank"), F.lit(0)) < 2)
    ends, goes = F.coalesce(F.col("context.ends"), F.lit(0)), F.coalesce(F.col("context.goes_on"), F.lit(0))
    share = (ends + 0.3) / (ends + goes + 0.6)
    odds = F.coalesce("source_odds", "corpus_odds", F.lit(0.0)) if use_lengths else F.lit(0.0)
    prior = F.log(odds + 0.05)
    # A whole text ends where texts end; a cut falls there about once in fifty.
    ending = F.when(F.col("context").isNull() | ~sentence, F.lit(0.0)).otherwise(F.log((1 - share + 0.02) / (share + 0.005)))
    # What no ending could outweigh is decided by the limit alone.
    evidence = F.when(odds >= HIGHEST_ODDS / 2, "limit").when(broken, "broken").when(F.col("there").isNotNull(), "document").when(part_of_word, "word").when(odds >= 1, "limit").otherwise("ending")
    damaged = F.when((F.col("there") == "ends") & ~broken, False).when(broken | (F.col("there") == "goes_on") | part_of_word, True).otherwise(prior + ending > 0)
    return Verdicts(judged.select("key", damaged.alias("damaged"), evidence.alias("evidence")), limits)


def truncated(records: DataFrame, corpus: DataFrame | None = None, record: str = "sample_id", **names: str) -> DataFrame:
    """``(record, damaged)`` of every record id, ``damaged`` true if its text lost its end; the names are those of :func:`judge`."""
    every = records.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("key")).distinct()
    return every.join(judge(records, corpus, record, **names).verdicts, "key", "left").select(F.col("key").alias(record), F.coalesce("damaged", F.lit(False)).alias("damaged"))


def damage_by_source(records: DataFrame, corpus: DataFrame | None, record: str = "sample_id", source: str = "source", **names: str) -> DataFrame:
    """``(source, n_records, n_damaged, share, limit_form, limit_length, n_at_limit)``; sources as written, null included, with the limit of their file."""
    found = judge(records, corpus, record, source=source, **names)
    placed = records.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("__key"), F.col(source).alias("__source")).distinct()
    verdicts = found.verdicts.select(F.col("key").alias("__key"), "damaged")
    counts = placed.join(verdicts, "__key", "left").groupBy("__source").agg(F.count_distinct("__key").alias("n_records"), F.count_distinct(F.when(F.col("damaged"), F.col("__key"))).alias("n_damaged"))
    limit = found.limits.groupBy(F.col("file").alias("__file")).agg(F.max_by(F.struct("form", "length", "n_at"), F.struct("odds", "n_at", "form")).alias("limit"))
    named = counts.withColumn("__file", _file_of(F.col("__source").cast("string"))).join(limit, "__file", "left")
    return named.select(F.col("__source").alias(source), "n_records", "n_damaged", F.round(F.col("n_damaged") / F.col("n_records"), 6).alias("share"), F.col("limit.form").alias("limit_form"), F.col("limit.length").alias("limit_length"), F.col("limit.n_at").alias("n_at_limit"))
