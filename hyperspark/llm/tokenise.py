"""Encoding of a corpus with a public byte-level BPE vocabulary.

Text is cut into pieces without regular expressions: every code point gets a class from an array,
each class is a transition function of a small automaton, and the functions are composed by an
associative scan (elements of the finite transition monoid, a byte each), so that all states of a
batch come from a few vectorised table look-ups. The pieces then feed a cached pair merging.

Defined results: a null text and an empty text have the ids ``[]`` (one row each); every other text is
encoded whole, special-token strings as ordinary text. Concatenating the bytes of the ids gives the text back.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperspark.plans.runtime import ship

#: Fixed values of the vocabulary's pre-tokenisation: contractions kept as one piece, white-space code points.
CONTRACTION_ONE = "sdmt"
CONTRACTION_TWO = ("re", "ve", "ll")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG, START = range(8)
# States before a code point: at a free piece start, in letters, in numbers, in others, after one blank, with one or two letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(7)

#: Pieces remembered by a worker, and code points handled at a time; both only bound memory.
CACHE_PIECES = 400_000
CHUNK_POINTS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            out[point] = kind
    out[list(WHITE_SPACE)] = SPACE
    out[0x20] = BLANK
    return out


def _step(state: int, symbol: int) -> int:
    """State after a code point of class ``symbol`` (SHORT, LONG: an apostrophe that begins a contraction if it begins a piece)."""
    if symbol == START:
        return FREE
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return FREE
    if symbol in (SHORT, LONG) and state in (FREE, IN_LETTERS, IN_NUMBERS):
        return ONE_LEFT if symbol == SHORT else TWO_LEFT
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, BLANK: AFTER_BLANK, SPACE: FREE}.get(symbol, IN_OTHERS)


def _begins(state: int, symbol: int) -> bool:
    """Whether a code point of class ``symbol`` met in ``state`` is the first of a piece."""
    if state in (ONE_LEFT, TWO_LEFT):
        return False
    if symbol == LETTER:
        return state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (OTHER, SHORT, LONG):
        return state not in (IN_OTHERS, AFTER_BLANK)
    return True


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the class functions, the composition table (first, then second), the image of FREE, and the piece-start table."""
    generators = [tuple(_step(state, symbol) for state in range(7)) for symbol in range(8)]
    elements = {tuple(range(7)): 0}
    queue = [tuple(range(7))]
    for function in queue:
        for generator in generators:
            after = tuple(generator[x] for x in function)
            if after not in elements:
                elements[after] = len(elements)
                queue.append(after)
    composed = np.zeros((len(queue), len(queue)), np.uint8)
    for a, first in enumerate(queue):
        for b, second in enumerate(queue):
            composed[a, b] = elements[tuple(second[x] for x in first)]
    begins = np.array([[_begins(state, symbol) for symbol in range(8)] for state in range(7)])
    return np.array([elements[g] for g in generators], np.uint8), composed, np.array([f[FREE] for f in queue], np.uint8), begins


def _prefixes(functions: np.ndarray, composed: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions of a sequence of monoid elements, by blocks of 64 side by side."""
    n, width = len(functions), 64
    if n <= width:
        out, so_far = np.zeros(n, np.uint8), 0
        for i, f in enumerate(functions):
            out[i] = so_far
            so_far = composed[so_far, f]
        return out
    lanes = -(-n // width)
    grid = np.zeros(lanes * width, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    size = len(composed)
    flat = composed.ravel()
    running = np.zeros((width + 1, lanes), np.uint8)
    for j in range(width):
        running[j + 1] = flat[running[j].astype(np.intp) * size + grid[j]]
    before = _prefixes(running[width], composed).astype(np.intp) * size
    return flat[before + running[:width]].T.ravel()[:n]


def piece_starts(points: np.ndarray, document_starts: np.ndarray) -> np.ndarray:
    """Offsets at which pieces begin in concatenated documents; ``document_starts`` are the offsets of non-empty documents."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    generators, composed, image, begins = _monoid()
    symbols = _classes()[points]
    ends = np.zeros(n, bool)  # last code point of a document
    ends[document_starts[1:] - 1] = True
    ends[-1] = True
    quotes = np.flatnonzero((points == 0x27) & ~ends)
    if len(quotes):
        first = points[quotes + 1]
        short = np.isin(first, [ord(c) for c in CONTRACTION_ONE])
        symbols[quotes[short]] = SHORT
        rest = quotes[~short & ~ends[quotes + 1]]
        if len(rest):
            pair = points[rest + 1].astype(np.int64) << 21 | points[rest + 2]
            symbols[rest[np.isin(pair, [ord(a) << 21 | ord(b) for a, b in CONTRACTION_TWO])]] = LONG
    functions = generators[symbols]
    # A document's first code point is met in the state FREE: its function is preceded by the reset.
    functions_in = functions.copy()
    functions_in[document_starts] = composed[generators[START], functions[document_starts]]
    states = image[_prefixes(functions_in, composed)]
    states[document_starts] = FREE
    out = begins[states, symbols]
    # Of a run of white space before another code point the last one stands alone (or joins what follows); at a document's end the run is one piece.
    white = (symbols == BLANK) | (symbols == SPACE)
    free = white & (states != ONE_LEFT) & (states != TWO_LEFT)
    after_white = np.zeros(n, bool)
    after_white[1:] = free[:-1]
    after_white[document_starts] = False
    last = np.ones(n, bool)
    last[:-1] = ~white[1:]
    last |= ends
    out[free & after_white & ~(last & ~ends)] = False
    out[document_starts] = True
    return np.flatnonzero(out)


class Encoder:
    """Byte-level BPE by ranks with a bounded cache of pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank is merged until none is left."""
        known = self.ranks.get(piece)
        if known is not None:
            return (known,)
        if len(piece) > 600:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return tuple(self.ranks[p] for p in parts)
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = self.ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = self.ranks.get(parts[i] + parts[i + 1])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for pieces of any length in n log n."""
        import heapq

        n = len(piece)
        end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.ranks.get(piece[i : end[j]])
                if rank is not None:
                    heap.append((rank, i, end[i], end[j])) if not started else heapq.heappush(heap, (rank, i, end[i], end[j]))

        started = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode_documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (int32) and the number of ids of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        starts = piece_starts(points, offsets[:-1][lengths > 0])
        bounds = np.append(starts, len(whole)).tolist()
        pieces = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for piece in set(pieces).difference(cache):
            cache[piece] = self.merge(piece.encode())
        found = list(map(cache.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter((x for one in found for x in one), np.int32, int(total[-1]))
        edges = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(edges)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, points = [], 0
    for text in texts:
        if held and points + len(text) > CHUNK_POINTS:
            yield held
            held, points = [], 0
        held.append(text)
        points += len(text)
    if held:
        yield held


def _encoded(batches: Iterator[pa.RecordBatch], path: str, counts_only: bool) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    for batch in batches:
        keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
        done = 0
        for chunk in _chunks(texts):
            ids, sizes = model.encode_documents(chunk)
            key = keys.slice(done, len(chunk))
            done += len(chunk)
            if counts_only:
                value = pa.array(sizes, pa.int64())
            else:
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))
            kept = [batch.column(i).slice(done - len(chunk), len(chunk)) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([key, value, *kept], ["key", "value", *(f"kept{i}" for i in range(len(kept)))])


def _run(df: DataFrame, id_column: str, text_column: str, name: str, vocabulary: str | None, counts_only: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()
    kinds = dict(df.dtypes)
    schema = f"key {kinds[id_column]}, value {'bigint' if counts_only else 'array<int>'}" + "".join(f", kept{i} {kinds[c]}" for i, c in enumerate(keep))
    rows = df.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"), *[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)])
    out = rows.mapInArrow(lambda batches: _encoded(batches, path, counts_only), schema)
    return out.select(F.col("key").alias(id_column), F.col("value").alias(name), *[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)])


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, ids)`` of every row of ``df``, null and empty texts with ``ids = []``; a map without a shuffle.

    ``vocabulary`` is the path of a rank file (``.tiktoken``), readable on every executor.
    """
    return _run(df, id_column, text_column, "ids", vocabulary, False)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_tokens, *keep)`` of every row of ``df``; 0 for null and empty texts."""
    return _run(df, id_column, text_column, "n_tokens", vocabulary, True, keep)


def decode(ids: list[int] | np.ndarray, vocabulary: str | None = None) -> str:
    """The text of a list of ids."""
    model = encoder(vocabulary or default_vocabulary())
    tokens = model.__dict__.setdefault("tokens", {rank: token for token, rank in model.ranks.items()})
    return b"".join(tokens[int(i)] for i in ids).decode("utf-8", errors="replace")
