"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation uses no regular expression. A batch of texts becomes one array of code points, a table turns it into
symbols, and the automaton of the split pattern is run over all of them at once: each symbol is a transition function on
a handful of states, and the functions are composed by an associative scan (distance doubling, which stops as soon as
all composed functions are constant). The states give the slice boundaries; the slices are merged by byte pairs, each
distinct slice once per worker.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
texts of any length are encoded whole (a batch is worked off in groups of a few million code points); repeated rows stay
repeated; an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points a group of texts holds at most, unless one text alone is longer.
GROUP_CHARS = 2_000_000
#: Distinct slices a worker remembers before it starts anew.
CACHE_SLICES = 400_000

# Symbols of the automaton.
LETTER, STMD, SYM_R, SYM_V, SYM_E, SYM_L, NUMBER, OTHER, APOSTROPHE, WHITE, SPACE = range(11)
# Its states: the class of the last character, then the ones inside a contraction.
IN_L, IN_N, IN_O, IN_W, IN_P, OPEN, OPEN_RV, OPEN_L, CLOSED = range(9)
#: All code points that are letters or numbers lie below this one.
_TABLE_END = 0x33500


def default_ranks_path() -> str:
    """The rank file of byte_bpe_50k in the installed vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point; one entry more for all beyond the table."""
    table = np.full(_TABLE_END + 1, OTHER, np.uint8)
    for cp in range(_TABLE_END):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, symbol in (("stmd", STMD), ("r", SYM_R), ("v", SYM_V), ("e", SYM_E), ("l", SYM_L)):
        for c in letters:
            table[ord(c)] = symbol
    return table


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """transitions()[symbol] is the function state -> state of that symbol, as an array."""
    fixed = {NUMBER: IN_N, OTHER: IN_O, WHITE: IN_W, SPACE: IN_P}
    t = np.full((11, 9), IN_L, np.uint8)
    for symbol, state in fixed.items():
        t[symbol] = state
    t[STMD, OPEN] = CLOSED
    t[SYM_R, OPEN] = t[SYM_V, OPEN] = OPEN_RV
    t[SYM_L, OPEN] = OPEN_L
    t[SYM_E, OPEN_RV] = t[SYM_L, OPEN_L] = CLOSED
    # An apostrophe opens a contraction only where a slice begins: not within a run of marks, nor after a space it takes along.
    t[APOSTROPHE] = OPEN
    t[APOSTROPHE, [IN_O, IN_P, OPEN]] = IN_O
    return t


def scan(functions: np.ndarray, first: int) -> np.ndarray:
    """States after each position, from the functions of the positions, by composition over doubled distances."""
    f = functions.copy()
    n, distance = len(f), 1
    open_ = np.flatnonzero((f != f[:, :1]).any(axis=1))
    while len(open_) and distance < n:
        own = open_[open_ >= distance]
        f[own] = np.take_along_axis(f[own], f[own - distance], axis=1)
        open_ = own[(f[own] != f[own, :1]).any(axis=1)]
        distance *= 2
    return f[:, first]


def boundaries(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """For each code point, whether a slice begins there. text_starts: positions where a text begins."""
    n = len(points)
    start = np.zeros(n, bool)
    if not n:
        return start
    symbols = symbol_table()[np.minimum(points, _TABLE_END)]
    functions = transitions()[symbols]
    at_start = np.zeros(n, bool)
    at_start[text_starts] = True
    functions[at_start] = functions[at_start][:, IN_W : IN_W + 1]  # each text begins as after white space
    state = scan(functions, IN_W)
    kind = np.array([0, 0, 0, 0, 0, 0, 1, 2, 2, 3, 3], np.uint8)[symbols]
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= at_start
    # The last white space before a word: a space goes along with the word, any other stands alone.
    word = np.flatnonzero((kind[1:] != 3) & (kind[:-1] == 3) & ~at_start[1:]) + 1
    start[word - 1] = True
    start[word[symbols[word - 1] == SPACE]] = False
    closed = np.flatnonzero(state == CLOSED)
    long_ = symbols[closed] != STMD
    start[closed] = False
    start[closed[long_] - 1] = False
    after = closed[closed + 1 < n] + 1
    start[after] = True
    return start


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined until none has a rank."""
    n = len(piece)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(pairs)  # (rank, begin, end): of equal ranks the leftmost comes first
    while pairs:
        rank, i, end = heapq.heappop(pairs)
        j = after[i] if ends[i] > 0 else n
        if ends[i] < 0 or j >= n or ends[j] != end:
            continue  # one of its parts has been joined since
        ends[i], ends[j] = end, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                heapq.heappush(pairs, (r, i, ends[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
            heapq.heappush(pairs, (r, k, end))
    return [ranks[piece[i : ends[i]]] for i in range(n) if ends[i] > 0]


class Encoder:
    """Encoder for one rank file. It lives once per worker: see ``encoder``."""

    def __init__(self, ranks_path: str, compiled: bool = True):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self._merge = lambda piece: merge(piece, self.ranks)
        if compiled:
            try:
                import tiktoken

                core = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=self.ranks, special_tokens={})
                self._merge = core._encode_single_piece
            except (ImportError, AttributeError):
                pass

    def encode_slice(self, piece: bytes) -> tuple[int, ...]:
        if (ids := self.cache.get(piece)) is None:
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            rank = self.ranks.get(piece)
            ids = self.cache[piece] = (rank,) if rank is not None else tuple(self._merge(piece))
        return ids

    def slices(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """All slices of the texts, and for each text the number of slices before its end."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        start = boundaries(points, begins[lengths > 0])
        at = np.flatnonzero(start)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = joined.encode("utf-8", "surrogatepass")
        cuts = [*byte_at[at].tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])], np.searchsorted(at, ends, "left")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them (one more than texts)."""
        flat, offsets = [], [0]
        for group in _groups(texts):
            pieces, upto = self.slices(group)
            ids = [self.encode_slice(p) for p in pieces]
            counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(counts[-1])))
            base = offsets[-1]
            offsets.extend((base + counts[upto]).tolist())
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.asarray(offsets, np.int64)

    def widths(self) -> np.ndarray:
        """Bytes of each token, by its id."""
        if not hasattr(self, "_widths"):
            self._widths = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for piece, i in self.ranks.items():
                self._widths[i] = len(piece)
        return self._widths

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after the last) of each token of the text's UTF-8 bytes."""
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        out, at = [], 0
        for i in self.encode([text])[0].tolist():
            out.append((i, at, at := at + len(self._bytes[i])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@lru_cache(maxsize=4)
def encoder(ranks_path: str) -> Encoder:
    """The worker's encoder of that rank file."""
    return Encoder(ranks_path)


def encode_corpus(df: DataFrame, key: str, text: str, ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text. No shuffle; rows stay where they are read."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path or default_ranks_path())  # where the vocabularies are is known on the worker
        for b in batches:
            flat, offsets = own.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["k", "ids"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), F.col("ids").alias(ids))


def encode_with_ends(df: DataFrame, key: str, text: str, ranks_path: str | None = None) -> DataFrame:
    """(key, ids, ends): the token ids of each text and the byte of its UTF-8 form after each token's last one. No shuffle."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path or default_ranks_path())
        for b in batches:
            flat, offsets = own.encode(b.column(1).to_pylist())
            upto = np.concatenate([[0], np.cumsum(own.widths()[flat])]) if len(flat) else np.zeros(1, np.int64)
            # Sums begin anew with each text.
            ends = upto[1:] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int64)))], ["k", "ids", "ends"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, ids array<int>, ends array<bigint>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str, out: str, ranks_path: str | None = None, drop_text: bool = True) -> DataFrame:
    """The columns of df (without the text if drop_text) and ``out``: the number of tokens of the text, 0 for null."""
    rest = [c for c in df.columns if c != text] if drop_text else df.columns
    # The text goes last under a name of its own, so that no column of the caller can clash with it.
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path or default_ranks_path())
        for b in batches:
            _, offsets = own.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets))], [*b.schema.names[:-1], "n"])

    fields = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest)))
    done = source.mapInArrow(run, f"{fields}, n bigint" if fields else "n bigint")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("n").alias(out))
