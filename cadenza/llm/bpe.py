"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pre-tokens are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found without a regular expression.  Every code point gets a *symbol*: its class (letter, number,
white space, other), told apart by one character of lookahead for white space and by the letters
that follow for an apostrophe.  A finite automaton of eight states reads the symbols; each symbol
is a function from states to states.  The functions that these generate under composition are
few, so they are numbered and composition is a table; composition is associative, so all states of
a batch of texts come from one blocked prefix scan over numbers.  The first symbol of a text is
preceded by the constant function to the start state, so that texts may stand side by side.
The state before a symbol and the symbol say whether a pre-token begins there.

Pre-tokens are slices of the UTF-8 bytes.  A slice becomes token ids by merging the neighbouring
pair of lowest rank, again and again; results of short slices are kept up to a bound.  Tokens
carry their byte offset in the text; decoding puts each token's bytes at its offset.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm import common

#: Slices longer than this are not kept.
LONGEST = 64
CACHED = 200_000
#: Above so many bytes pairs are merged by a heap.
HEAPED = 96
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2_000_000
WIDTH = 64

START, LETTERS, NUMBERS, OTHERS, SPACES, PENDING, ONE, TWO = range(8)
#: Symbols: a letter, a number, another character, an apostrophe with one or two letters of a contraction,
#: white space before white space or the end, a last space before a word, other last white space.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, SPACE, LAST = range(8)
WHITE = 3
# fixed values: the contractions of the pattern, by their number of letters
CONTRACTIONS = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins with this symbol."""
    if state in (ONE, TWO):  # inside a contraction
        return (START if state == ONE else ONE), False
    if symbol in (LETTER, NUMBER):
        run = LETTERS if symbol == LETTER else NUMBERS
        return run, state not in (run, PENDING)
    if symbol in (OTHER, SHORT, LONG):
        inside = state in (OTHERS, PENDING)
        if inside or symbol == OTHER:
            return OTHERS, not inside
        return (ONE if symbol == SHORT else TWO), True
    if symbol == INNER:
        return SPACES, state != SPACES
    return (PENDING if symbol == SPACE else START), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol's function (inside a text, at its beginning), composition, state after each
    function from the start, whether (state, symbol) begins a pre-token."""
    states = range(8)
    inside = [tuple(step(s, x)[0] for s in states) for x in range(8)]
    first = [tuple(f[START] for _ in states) for f in inside]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(states), *inside, *first]))}
    todo = list(known)
    while todo:  # close under composition
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[f[s]] for s in states), tuple(f[g[s]] for s in states)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    functions = list(known)
    after = np.array([[known[tuple(g[f[s]] for s in states)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[step(s, x)[1] for x in range(8)] for s in states])
    number = [np.array([known[f] for f in fs], np.uint16) for fs in (inside, first)]
    return number[0], number[1], after, np.array([f[START] for f in functions], np.uint8), begins


def scanned(functions: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each place the number of the composition of all functions up to it (0 is the identity)."""
    n = len(functions)
    rows = -(-n // WIDTH)
    x = np.zeros(rows * WIDTH, np.uint16)
    x[:n] = functions
    x = np.ascontiguousarray(x.reshape(rows, WIDTH).T)  # a block is a column
    for j in range(1, WIDTH):
        x[j] = after[x[j - 1], x[j]]
    if rows > 1:
        before = scanned(x[-1], after)[:-1]
        x[:, 1:] = after[before[None, :], x[:, 1:]]
    return x.T.reshape(-1)[:n]


@cache
def classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER or WHITE, by the Unicode tables of the tiktoken library."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        # a vocabulary of single bytes gives back what the pattern matches
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


def boundaries(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Byte places in ``data`` (UTF-8 texts side by side, each from ``starts``) where pre-tokens begin."""
    code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(n, bool)
    begin = np.searchsorted(place, starts)
    first[begin[begin < n]] = True
    last = np.append(first[1:], True)
    kind = classes()[code]
    white = kind == WHITE
    symbol = kind.copy()
    before_word = white & ~last & ~np.append(white[1:], True)
    symbol[white] = INNER
    symbol[before_word] = LAST
    symbol[before_word & (code == 32)] = SPACE
    quote = np.flatnonzero((code == 39) & ~last)
    if len(quote):
        one = code[quote + 1]
        more = np.minimum(quote + 2, n - 1)
        two = np.where(last[quote + 1], 0, code[more])
        symbol[quote[np.isin(one, [ord(c) for c in CONTRACTIONS[1]])]] = SHORT
        long = np.zeros(len(quote), bool)
        for a, b in CONTRACTIONS[2]:
            long |= (one == ord(a)) & (two == ord(b))
        symbol[quote[long]] = LONG
    inside, opening, after, state, begins = automaton()
    after_each = state[scanned(np.where(first, opening[symbol], inside[symbol]), after)]
    before = np.where(first, START, np.append(START, after_each[:-1]))
    return place[begins[before, symbol]]


class Vocabulary(dict):
    """Token ids (little-endian 32-bit words) of byte slices; short slices are kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        if rank is not None:
            ids = [rank]
        elif len(piece) <= HEAPED:
            ids = self.merged(piece)
        else:
            ids = self.merged_by_heap(piece)
        out = array("I", ids).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short slice: the leftmost pair of lowest rank is merged until no pair is a token."""
        ranks, none = self.ranks, len(self.lengths)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same for long slices, in time n log n: parts are linked, pairs wait in a heap."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        begin = list(range(-1, n - 1))  # where the part before this one begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                begin[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                left = begin[i]
                if (r := ranks.get(piece[left:stop])) is not None:
                    heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in ``data``, their byte offsets in their text, and where each text's ids end.

        ``starts`` has where each text begins in ``data``, and where the last one ends.
        """
        cut = boundaries(data, starts[:-1])
        stops = np.append(cut[1:], len(data))[: len(cut)]
        words = [self[data[a:b]] for a, b in zip(cut.tolist(), stops.tolist(), strict=True)]
        ids = np.frombuffer(b"".join(words), np.uint32).astype(np.int32)
        offset = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        ends = np.searchsorted(offset, starts[1:])  # every text begins with a token of its own
        begin = np.repeat(starts[:-1], np.diff(ends, prepend=0))
        return ids, (offset - begin).astype(np.int32), ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of every text, each token put at its offset."""
        size = self.lengths[ids]
        last = np.append(0, ends)
        own = np.diff(last) > 0
        total = np.zeros(len(ends), np.int64)
        total[own] = (offsets + size)[ends[own] - 1]
        base = np.cumsum(total) - total
        at = np.repeat(base, np.diff(last)) + offsets
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros(int(total.sum()), np.uint8)
        out[np.repeat(at, size) + within] = self.bytes[np.repeat(self.begins[ids], size) + within]
        whole = out.tobytes()
        return [whole[a : a + n] for a, n in zip(base.tolist(), total.tolist(), strict=True)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))


def encode(df: DataFrame, path: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds ids and offsets (of each token, in bytes of the UTF-8 text) to every row of ``df`` (text).

    ``path`` names ranks of a byte-level vocabulary.  With ``decoded`` the ids are decoded at once and
    their bytes are added, which saves sending long lists of ids to another Python stage.  Null and
    empty texts have no ids.  Columns with these names are replaced; repeated rows stay; an empty
    table stays empty.
    """

    def encoded(text):
        words = vocabulary(path)
        data, starts = flat(text)
        ids, offsets, ends = words.encode(data, starts)
        out = [lists(ids, ends), lists(offsets, ends)]
        return [*out, pa.array(words.decode(ids, offsets, ends), pa.binary())] if decoded else out

    out = "ids array<int>, offsets array<int>" + (", bytes binary" if decoded else "")
    return common.with_columns(df, encoded, ["text"], out, keep, SLICE_BYTES)


def flat(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts side by side (null as nothing), and where each begins and the last ends."""
    column = text.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return b"", np.zeros(len(column) + 1, np.int64)
    return column.buffers()[2][int(starts[0]) : int(starts[-1])].to_pybytes(), starts - starts[0]


def decode(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Adds bytes, the decoded text in UTF-8, to every row of ``df`` (ids, offsets).

    Rows without ids have empty bytes.  A column named bytes is replaced; repeated rows stay; an
    empty table stays empty.
    """

    def decoded(ids, offsets):
        empty = pa.scalar([], pa.list_(pa.int32()))
        ids, offsets = (x.cast(pa.list_(pa.int32())).fill_null(empty) for x in (ids, offsets))
        ends = np.cumsum(np.diff(ids.offsets.to_numpy()))
        return [pa.array(vocabulary(path).decode(ids.flatten().to_numpy(), offsets.flatten().to_numpy(), ends), pa.binary())]

    return common.with_columns(df, decoded, ["ids", "offsets"], "bytes binary", keep, SLICE_BYTES)
