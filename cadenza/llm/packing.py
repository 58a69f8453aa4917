"""Best-fit packing of token sequences with matching of large items.

Documents become token ids with a closing id; longer ones than a sequence are cut, the first
piece being the shorter one.  Lengths are whole numbers up to the capacity, so the packing is
decided on their histogram, whose size does not depend on the corpus:

* pieces above a third of the capacity meet at most in twos; going down from the longest, each
  is matched with the longest partner that still fits;
* smaller pieces go, longest first, into the smallest gap that holds them (best fit), and open
  new sequences only where no gap does.

Equal cases are settled together, so the plan is a short list of sequence patterns with their
multiplicities.  Spark then numbers the pieces of each length (in salted groups, so that a
very frequent length is no single group) and looks up the place of every number in the plan.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import common

CAPACITY = 2_048
END = 0
CACHED = 400_000
#: Longer chunks are not kept.
LONGEST = 64
ROWS = 500
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Where white space meets a space, the tokenizer's pieces depend on more than one space-separated chunk.
ENTANGLED = re.compile(r"[^\S ] [^\S ]")


def encoding(path: str) -> Callable[[str], list[int]]:
    """Text to ids by the vocabulary at ``path``: a tokenizer in JSON, or ranks of a byte-level BPE.

    Both forms of a vocabulary give the same ids (tests compare them); ranks encode short strings
    several times as fast.  Ranks lack the added tokens, which the JSON form beside them names.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(re.sub(r"\.\w+$", ".json", path), encoding="utf-8") as whole:
        added = {token["content"]: token["id"] for token in json.load(whole)["added_tokens"]}
    form = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: form.encode(text, allowed_special="all") if any(token in text for token in added) else form.encode_ordinary(text)


class Encoder(dict):
    """Token ids of texts as little-endian 32-bit words; ids of frequent chunks are kept.

    The tokenizer splits a text before every single space, so chunks between single spaces are
    encoded alone; texts with other white space beside a space are encoded in one piece.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encode = encoding(path)

    def words(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(" " + chunk)).tobytes() if LITTLE else self.words(" " + chunk)
        if len(self) >= CACHED:
            self.clear()
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "  " in text or ENTANGLED.search(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return self.words(first) + b"".join(map(self.__getitem__, rest))


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every row of ``df`` (doc_id, text).

    Null and empty texts are one piece that holds only the closing id.  Other columns are left
    out.  Repeated rows give repeated pieces.
    """
    key = df.schema["doc_id"]
    columns = [key, *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")]
    schema = T.StructType([*columns, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])
    close = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer_path)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                rows: list[tuple] = []
                for i in range(low, min(low + ROWS, batch.num_rows)):
                    ids = encoder.ids(batch.column(1)[i].as_py() or "") + close
                    n = len(ids) // 4
                    start = 0
                    for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        own = ids[4 * start : 4 * stop]
                        rows.append((i, k, start, stop - start, zlib.crc32(own), own if keep_ids else None))
                        start = stop
                cut = list(zip(*rows, strict=True))
                arrays = [batch.column(0).take(pa.array(cut[0])), *(pa.array(c, t) for c, t in zip(cut[1:5], kinds, strict=True))]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cut[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Pattern:
    """``times`` sequences with the same runs of (length, how many)."""

    times: int
    runs: list[tuple[int, int]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold ``counts`` (length to number of pieces, lengths 1 to ``capacity``)."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] += n
    gaps: list[list[Pattern]] = [[] for _ in range(capacity + 1)]  # open patterns by free room

    def put(gap: int, times: int, runs: list[tuple[int, int]]) -> None:
        if times:
            gaps[gap].append(Pattern(times, runs))

    put(0, left[capacity], [(capacity, 1)])
    third = capacity // 3
    for size in range(capacity - 1, third, -1):
        partner = min(capacity - size, size)
        while left[size]:
            while partner > third and (left[partner] == 0 or (partner == size and left[size] < 2)):
                partner -= 1
            if partner <= third:
                put(capacity - size, left[size], [(size, 1)])
                left[size] = 0
            elif partner == size:
                put(capacity - 2 * size, left[size] // 2, [(size, 2)])
                left[size] %= 2
            else:
                n = min(left[size], left[partner])
                put(capacity - size - partner, n, [(size, 1), (partner, 1)])
                left[size] -= n
                left[partner] -= n
    for size in range(third, 0, -1):
        n, gap = left[size], size
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            here = gaps[gap].pop() if gap <= capacity else Pattern(n, [])
            room = min(gap, capacity)
            each = room // size
            full = min(here.times, n // each)
            put(room - each * size, full, [*here.runs, (size, each)])
            n -= full * each
            rest = here.times - full
            if rest and n:  # fewer than ``each`` are left for one more sequence
                put(room - n * size, 1, [*here.runs, (size, n)])
                n, rest = 0, rest - 1
            if here.runs:
                put(room, rest, here.runs)
    return [p for held in gaps for p in held]


def slots(patterns: list[Pattern]) -> dict[int, list[np.ndarray]]:
    """For each length, its runs: first number, pieces a sequence, first sequence, offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for size, each in p.runs:
            found.setdefault(size, []).append((taken.get(size, 0), each, sequence, offset))
            taken[size] = taken.get(size, 0) + each * p.times
            offset += size * each
        sequence += p.times
    return {size: list(np.array(rows, np.int64).T) for size, rows in found.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``cut`` (doc_id, piece, length, ...), a table on disk.

    The driver sees one count per length.  An empty table stays empty.
    """
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = slots(plan(counts, capacity))
    # numbers within a length come from salted groups: about as many groups as rows in each
    salts = F.create_map(*[F.lit(x) for size, n in counts.items() for x in (size, math.isqrt(n) + 1)]) if counts else F.lit(None)
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), salts[F.col("length")] if counts else F.lit(1)))
    before = (
        salted.groupBy("length", "__salt")
        .agg(F.count("*").alias("n"))
        .withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    numbered = salted.withColumn("__own", own).join(before, ["length", "__salt"]).withColumn("__number", F.col("__before") + F.col("__own") - 1)

    def placed(length, number):
        length, number = length.to_numpy(), number.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            first, each, base, begin = at[int(size)]
            run = np.searchsorted(first, number[rows], side="right") - 1
            nth = number[rows] - first[run]
            sequence[rows] = base[run] + nth // each[run]
            offset[rows] = begin[run] + nth % each[run] * size
        return sequence, offset

    return common.with_columns(numbered, placed, ["length", "__number"], "sequence_id long, offset long", cut.columns)


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``df`` with their places; with ``keep_ids`` also their token ids."""
    return place(common.stage(pieces(df, tokenizer_path, capacity, end, keep_ids), "pieces"), capacity)
