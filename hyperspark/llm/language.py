"""Language of every text and of every stretch of a mixed text.

A linear-chain conditional random field labels the words of a line. Its features are the word itself (the
lexicon), affixes, letter trigrams, script and shape; its transitions are learned apart for places after a
clause mark and within a clause. Scores of a word are worked out once per distinct word and worker;
forward-backward runs for thousands of lines at a time. Stretches are runs of one label; the confidence of a
stretch is the mean posterior of its words.

The field is trained on a bounded sample of labelled texts (``TRAIN_ROWS``, different texts of the lowest hashes),
lines of program code found by a mixture of prose and code (``code_lines``), and lines joined from texts of two
languages; a first pass, trained on other texts of the sample, throws out texts whose label it doubts.

Defined results: null and blank texts give no rows; lines without words give no rows; lines of any length are
labelled whole; repeated rows count once; labels that name no language are missing labels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.llm.code_lines import CODE_SEEDS, is_code, learn_code
from hyperspark.plans.runtime import hash_sample, ship

#: Bounds of what the field is trained on: labelled texts, texts whose lines of code are learned, lines of code.
TRAIN_ROWS = 6000
CODE_TEXTS = 2000
TRAIN_CODE_LINES = 600
FEATURES = 1 << 17
#: Words of a text that are trained on; all are labelled.
LONGEST = 512
CACHE_WORDS = 200_000
#: Words a stretch in a further language must have, and its least confidence.
CLAUSE_WORDS = 3
CLAUSE_CONFIDENCE = 0.7
#: Parts of the labelled texts that are judged by the field of the others, and the confidence in another language from which on a label is thrown out.
FOLDS = 5
SURE = 0.5
CODE = "code"

WIDE = re.compile(r"([぀-ヿ㐀-鿿豈-﫿]+)")
CLAUSE_END = tuple(".!?。！？।…:;)—–")


def words_of(line: str) -> list[str]:
    """White-space tokens; runs of Chinese or Japanese characters stand alone."""
    if WIDE.search(line):
        line = WIDE.sub(r" \1 ", line)
    return line.split()


def _script(letter: str) -> str:
    point = ord(letter)
    if point < 0x250:
        return "latin"
    if point < 0x370:
        return "other"
    for stop, name in ((0x400, "greek"), (0x530, "cyrillic"), (0x600, "hebrew"), (0x780, "arabic"), (0x900, "other"), (0x980, "devanagari"), (0x3040, "other"), (0x3100, "kana"), (0x3400, "other"), (0xA000, "han")):
        if point < stop:
            return name
    return "other"


def features(token: str) -> list[int]:
    """Hashed features of a token."""
    core = token.strip(".,;:!?\"'()[]{}«»“”‘’—–…-¿¡。，！？；：（）।").lower()
    found = []
    if core:
        letters = [c for c in core if c.isalpha()]
        found += ["w" + core, "s1" + core[-1:], "s2" + core[-2:], "s3" + core[-3:], "s4" + core[-4:], "p2" + core[:2], "p3" + core[:3]]
        if letters:
            found.append("script" + _script(letters[0]))
        padded = f"<{core[:40]}>"
        found += ["t" + padded[i : i + 3] for i in range(len(padded) - 2)]
        found += ["c" + c for c in set(letters) if c > "\x7f" and c < "ɐ"]
        if core.isdigit():
            found.append("digits")
    else:
        found.append("mark" + token[:3])
    inner = sum(c in "(){}[];=<>+*%_&|\\/#" for c in token)
    if inner:
        found += ["code", f"code{min(inner, 3)}", "codeend" + token[-1]]
        if re.search(r"\w[(\[.=_]\w|\w[(\[]", token):
            found.append("call")
    return [zlib.crc32(x.encode()) % FEATURES for x in found]


def _breaks(tokens: list[str]) -> list[bool]:
    """Whether a clause may begin at each token."""
    return [i == 0 or tokens[i - 1].endswith(CLAUSE_END) or tokens[i][0] in "(—–" for i in range(len(tokens))]


@dataclass
class Field:
    """Weights of features (FEATURES × labels) and of transitions (within a clause, at a break)."""

    weights: np.ndarray
    within: np.ndarray
    at_break: np.ndarray


def _emissions(scores: np.ndarray) -> np.ndarray:
    """Scores as factors, the best label's factor 1."""
    return np.exp(scores - scores.max(-1, keepdims=True))


def _forward_backward(emitted: np.ndarray, breaks: np.ndarray, lengths: np.ndarray, field: Field, want_pairs: bool = False):
    """Posteriors of a padded batch (sequences × time × labels) of emission factors, and expected transitions by kind if wanted.

    Messages are scaled at every fourth step; factors of at most 1 can't leave the range of floats in between.
    """
    batch, time, labels = emitted.shape
    inner, outer = np.exp(field.within).astype(emitted.dtype), np.exp(field.at_break).astype(emitted.dtype)
    alpha = np.empty_like(emitted)
    alpha[:, 0] = emitted[:, 0]
    for t in range(1, time):
        step = np.where(breaks[:, t, None], alpha[:, t - 1] @ outer, alpha[:, t - 1] @ inner) * emitted[:, t]
        alpha[:, t] = step / step.sum(1, keepdims=True) if t % 4 == 0 else step
    beta = np.ones((batch, labels), emitted.dtype)
    pairs = (np.zeros((labels, labels)), np.zeros((labels, labels)))
    out = np.empty_like(emitted)
    for t in range(time - 1, -1, -1):
        beta[lengths - 1 == t] = 1.0
        out[:, t] = alpha[:, t] * beta
        if t:
            right = beta * emitted[:, t]
            if want_pairs:
                live = t < lengths
                for kind, table in enumerate((inner, outer)):
                    rows = live & (breaks[:, t] == bool(kind))
                    if rows.any():
                        norm = np.einsum("bi,ij,bj->b", alpha[rows, t - 1], table, right[rows]) + 1e-30
                        pairs[kind][:] += table * np.einsum("bi,bj->ij", alpha[rows, t - 1] / norm[:, None], right[rows])
            beta = np.where(breaks[:, t, None], right @ outer.T, right @ inner.T)
            if t % 4 == 0:
                beta /= beta.sum(1, keepdims=True) + 1e-30
    out /= out.sum(2, keepdims=True) + 1e-30
    return (out, pairs) if want_pairs else out


def _padded(lists: list[np.ndarray], fill) -> np.ndarray:
    width = max(map(len, lists))
    out = np.full((len(lists), width), fill, lists[0].dtype)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def train(sequences: list[tuple[list[str], list[int]]], labels: int, rounds: int = 40, start: Field | None = None) -> Field:
    """Fit the field to labelled word sequences by full-batch gradient steps with adaptive rates; features seen a few times only take small steps."""
    kinds: dict[str, int] = {}
    encoded = [np.array([kinds.setdefault(t, len(kinds)) for t in tokens], np.int64) for tokens, _ in sequences]
    lists = [features(t) for t in kinds]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.array([f for x in lists for f in x], np.int64)
    used, slot = np.unique(flat, return_inverse=True)
    # Features of a word stand together, and so do, in another order, the words of a feature: sums are over runs.
    of_word = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
    by_feature = np.argsort(slot, kind="stable")
    of_feature = np.searchsorted(slot[by_feature], np.arange(len(used)))
    order = np.argsort([len(x) for x in encoded], kind="stable")
    batches = []
    for at in range(0, len(order), 2000):
        rows = order[at : at + 2000]
        batches.append((_padded([encoded[i] for i in rows], 0), _padded([np.array(_breaks(sequences[i][0]), bool) for i in rows], False), np.array([len(encoded[i]) for i in rows]), _padded([np.array(sequences[i][1], np.int64) for i in rows], 0)))
    if start is None:
        # Start from each feature's balanced log-odds of the labels; a word has about twenty features that say the same.
        seen = np.zeros((len(lists), labels))
        for ids, (_, truth) in zip(encoded, sequences):
            np.add.at(seen, (ids, truth), 1.0)
        held = np.zeros((len(used), labels))
        np.add.at(held, slot, seen[owner])
        rates = held / np.maximum(seen.sum(0), 1.0)
        odds = np.log((rates + 1e-6) / (rates.mean(1, keepdims=True) + 1e-6))
        weights = 0.1 * np.clip(odds, -5.0, 5.0)
    else:
        weights = start.weights[used].astype(np.float64)
    tables = [np.where(np.eye(labels, dtype=bool), 2.0, -1.0), np.where(np.eye(labels, dtype=bool), 1.0, -0.5)] if start is None else [start.within.copy(), start.at_break.copy()]
    params = [weights, *tables]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = sum(len(x) for x in encoded)
    for step in range(1, rounds + 1):
        factors = _emissions(np.add.reduceat(weights[slot], of_word, axis=0))
        slope_kind, slope_tables = np.zeros_like(factors), [np.zeros_like(t) for t in tables]
        field = Field(weights, tables[0], tables[1])
        for ids, breaks, lengths, truth in batches:
            post, pairs = _forward_backward(factors[ids], breaks, lengths, field, True)
            live = np.arange(ids.shape[1]) < lengths[:, None]
            slope = post[live]
            slope[np.arange(len(slope)), truth[live]] -= 1.0
            words = ids[live]
            for label in range(labels):
                slope_kind[:, label] += np.bincount(words, slope[:, label], len(slope_kind))
            after = live[:, 1:]
            for kind in (0, 1):
                rows = after & (breaks[:, 1:] == bool(kind))
                seen = np.bincount(truth[:, :-1][rows] * labels + truth[:, 1:][rows], minlength=labels * labels).reshape(labels, labels)
                slope_tables[kind] += pairs[kind] - seen
        slope_weights = np.add.reduceat(slope_kind[owner[by_feature]], of_feature, axis=0)
        for i, slope in enumerate([slope_weights / total + 1e-6 * weights, slope_tables[0] / total, slope_tables[1] / total]):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            params[i] -= 0.06 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 2e-5)
    out = np.zeros((FEATURES, labels), np.float32)
    out[used] = weights
    return Field(out, tables[0], tables[1])


class Labeller:
    """The field with its cache of word scores; labels many lines at once."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, field.weights.shape[1]), np.float32)
        self.weight = np.zeros(1024, np.int32)
        self.closes = np.zeros(1024, bool)
        self.opens = np.zeros(1024, bool)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for token in set(tokens).difference(self.known):
            i = self.known[token] = len(self.known)
            if i >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
                self.closes = np.concatenate([self.closes, np.zeros_like(self.closes)])
                self.opens = np.concatenate([self.opens, np.zeros_like(self.opens)])
            self.scores[i] = _emissions(self.field.weights[features(token)].sum(0))
            self.closes[i], self.opens[i] = token[-1] in CLAUSE_END, token[0] in "(—–"
            wide = WIDE.match(token)
            self.weight[i] = len(token) // 2 if wide else int(any(c.isalnum() for c in token))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def label(self, lines: list[list[str]]) -> list[list[tuple[int, int, float]]]:
        """For each line its stretches ``(label, words, confidence)``, in order."""
        owner = [i for i, line in enumerate(lines) if line]
        pieces = [lines[i] for i in owner]
        out: list[list[tuple[int, int, float]]] = [[] for _ in lines]
        if not pieces:
            return out
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = [t for p in pieces for t in p]
        ids = self._ids(flat)
        breaks = self.opens[ids]
        breaks[1:] |= self.closes[ids[:-1]]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        best = np.empty(len(flat), np.int64)
        sure = np.empty(len(flat), np.float32)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = lengths[order[at]]
            stop = at
            while stop < len(order) and (stop - at + 1) * lengths[order[stop]] <= 120_000 and (stop - at < 64 or lengths[order[stop]] <= 1.3 * longest + 2):
                stop += 1
            rows = order[at : max(stop, at + 1)]
            at = max(stop, at + 1)
            width = int(lengths[rows].max())
            place = np.minimum(starts[rows][:, None] + np.arange(width), len(flat) - 1)
            live = np.arange(width) < lengths[rows][:, None]
            post = _forward_backward(self.scores[ids[place]], breaks[place], lengths[rows], self.field)
            best[place[live]] = post.argmax(2)[live]
            sure[place[live]] = post.max(2)[live]
        weight = self.weight[ids]
        change = np.ones(len(flat), bool)
        change[1:] = best[1:] != best[:-1]
        change[starts] = True
        first = np.flatnonzero(change)
        n = np.add.reduceat(weight, first)
        # The confidence is that of the words; marks count a little so that it is defined without words.
        share = weight + 1e-3
        mean = np.add.reduceat(sure * share, first) / np.add.reduceat(share, first)
        line_of = np.asarray(owner)[np.searchsorted(starts, first, side="right") - 1]
        for i, label, words, confidence in zip(line_of.tolist(), best[first].tolist(), n.tolist(), mean.tolist()):
            out[i].append((label, words, confidence))
        return out


def stretches(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Stretches of a line that count: the heaviest, and others long and sure enough; others give way to their neighbours."""
    found = [x for x in found if x[1] > 0]
    if not found:
        return []
    merged: dict[int, int] = {}
    for label, words, _ in found:
        merged[label] = merged.get(label, 0) + words
    main = max(merged, key=lambda k: (merged[k], -k))
    out: list[tuple[int, int, float]] = []
    for label, words, confidence in found:
        if label != main and (words < CLAUSE_WORDS or confidence < CLAUSE_CONFIDENCE):
            continue
        if out and out[-1][0] == label:
            total = out[-1][1] + words
            out[-1] = (label, total, (out[-1][2] * out[-1][1] + confidence * words) / total)
        else:
            out.append((label, words, confidence))
    return out


def language_names(languages: DataFrame) -> tuple[list[str], dict[str, int], int | None]:
    """Codes in order, the label each name stands for, and the label of program code (``languages`` is a small table)."""
    rows = sorted({(r["lang_code"], r["iso"], r["lang_name"]) for r in languages.where("lang_code is not null").select("lang_code", "iso", "lang_name").collect()})
    codes = [r[0] for r in rows]
    names = {str(x).strip().lower(): i for i, r in enumerate(rows) for x in r if x}
    return codes, names, next((i for i, r in enumerate(rows) if r[1] == CODE), None)


def train_on(texts: DataFrame, prose: DataFrame | None, names: dict[str, int], n_labels: int, code_label: int | None, rows: int = TRAIN_ROWS) -> Field:
    """Train on ``rows`` labelled texts ``(text, lang)`` chosen by hash, and on lines of program code of the texts ``prose (text)``."""
    named = F.lower(F.trim("lang")).isin(*names)
    picked = hash_sample(texts.where(named & (F.trim("text") != "")).select("text", "lang"), "text", rows, seed=6).collect()
    sequences = []
    for text, lang in sorted((r["text"], r["lang"]) for r in picked):
        tokens = words_of(text.replace("\n", " "))[:LONGEST]
        if tokens:
            sequences.append((tokens, [names[lang.strip().lower()]] * len(tokens)))
    if code_label is not None:
        lines = list(CODE_SEEDS)
        if prose is not None:
            sampled = sorted(r["text"] for r in hash_sample(prose.where(F.trim("text") != "").select("text"), "text", CODE_TEXTS, seed=7).collect())
            code = learn_code(sampled)
            lines += sorted({x for t in sampled for x in t.split("\n") if x.strip() and is_code(x, code)})[:TRAIN_CODE_LINES]
        sequences += [(t, [code_label] * len(t)) for t in (words_of(x)[:LONGEST] for x in lines) if t]
    rng = np.random.default_rng(11)
    if not sequences:
        return Field(np.zeros((FEATURES, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros((n_labels, n_labels)))
    clean, field = [], None
    for fold in range(FOLDS):
        own, other = sequences[fold::FOLDS], [s for i, s in enumerate(sequences) if i % FOLDS != fold] or sequences
        field = train(other, n_labels, rounds=5)
        if not own:
            continue
        doubt = Labeller(field).label([t for t, _ in own])
        for s, found in zip(own, doubt):
            label, _, confidence = max(found, key=lambda x: x[1])
            if label == s[1][0] or confidence < SURE:
                clean.append(s)
    clean = clean or sequences
    mixed = []
    for _ in range(len(clean) // 3):
        (a, la), (b, lb) = clean[int(rng.integers(len(clean)))], clean[int(rng.integers(len(clean)))]
        if code_label is not None and code_label in (la[0], lb[0]):
            continue
        a, b, kind = list(a), list(b), int(rng.integers(4))
        if kind == 1:
            b[0] = b[0][:1].lower() + b[0][1:]
            a[-1] = a[-1].rstrip(".。") + rng.choice([",", ":", " —", ";"])
            a = " ".join(a).split()
        elif kind == 2:
            a[-1] = a[-1].rstrip(".。") or a[-1]
            b[0], b[-1] = "(" + b[0], b[-1].rstrip(".") + ")"
        mixed.append((a + b, [la[0]] * len(a) + [lb[0]] * len(b)))
    return train(clean + mixed, n_labels, rounds=20)


def _labelled(batches: Iterator[pa.RecordBatch], model, codes: list[str], names: dict[str, int], only_doubtful: bool) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model.value)
    for batch in batches:
        keys, kinds, texts, stated = (c.to_pylist() for c in batch.columns)
        lines, owner, number = [], [], []
        for i, text in enumerate(texts):
            for n, line in enumerate((text or "").split("\n"), 1):
                tokens = words_of(line)
                if tokens:
                    lines.append(tokens), owner.append(i), number.append(n)
        parts = [stretches(x) for x in labeller.label(lines)]
        weights: list[dict[int, int]] = [{} for _ in texts]
        for i, found in zip(owner, parts):
            for label, words, _ in found:
                weights[i][label] = weights[i].get(label, 0) + words
        main = [max(w, key=lambda k: (w[k], -k)) if w else -1 for w in weights]
        told = [names.get(s.strip().lower(), -1) if s else -1 for s in stated]
        doubtful = [len(w) > 1 or t not in w for w, t in zip(weights, told)]
        out: list[list] = [[] for _ in range(11)]
        for i, n, found in zip(owner, number, parts):
            if only_doubtful and not doubtful[i]:
                continue
            for seg, (label, words, confidence) in enumerate(found, 1):
                values = (kinds[i], keys[i], n, seg, codes[label], words, round(confidence, 4), codes[main[i]], doubtful[i], len(texts[i].split()), len(texts[i].strip()))
                for column, value in zip(out, values):
                    column.append(value)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["record_kind", "record_id", "line_no", "segment_no", "lang_code", "n_words", "confidence", "main_lang", "doubtful", "text_words", "text_chars"])


def segments(records: DataFrame, field: Field, codes: list[str], names: dict[str, int], only_doubtful: bool = False) -> DataFrame:
    """Stretches of every record ``(record_id, record_kind, text, stated)``; a map without a shuffle.

    ``(record_kind, record_id, line_no, segment_no, lang_code, n_words, confidence, main_lang, doubtful, text_words, text_chars)``;
    ``doubtful`` marks records in more than one language or whose stated label isn't among their languages.
    """
    ship(records.sparkSession)
    model = records.sparkSession.sparkContext.broadcast(field)
    rows = records.where("record_id is not null and trim(text) <> ''").select(F.col("record_id").cast("long"), "record_kind", "text", "stated")
    schema = "record_kind string, record_id long, line_no long, segment_no long, lang_code string, n_words long, confidence double, main_lang string, doubtful boolean, text_words long, text_chars long"
    return rows.mapInArrow(lambda batches: _labelled(batches, model, codes, names, only_doubtful), schema)


def record_labels(found: DataFrame) -> DataFrame:
    """``(record_kind, record_id, lang_code, confidence, n_languages)``: one row per record."""
    by = found.dropDuplicates(["record_kind", "record_id", "line_no", "segment_no"]).groupBy("record_kind", "record_id")
    return by.agg(
        F.max("main_lang").alias("lang_code"),
        F.round(F.sum(F.when(F.col("lang_code") == F.col("main_lang"), F.col("confidence") * F.col("n_words"))) / F.sum("n_words"), 4).alias("confidence"),
        F.count_distinct("lang_code").alias("n_languages"),
    )
