"""Restarting windows: each boundary depends on the one before it.

Cutting speech into buckets and planning chunks both walk a recording with one integer of
state (where the open bucket began, where the next chunk starts).  A walk over a whole
recording would run in one task, so each slice is instead summarised by its *state map*:
for every state a walk could bring into the slice, the state it leaves with.  Such a map
is a short list of pieces, each a constant or the identity plus a shift.  Maps compose,
so the true entry state of every slice follows from a chain over the small maps, and the
slices are then walked in parallel.

The numpy code below only ever sees one slice or one block of maps.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from cadenza.timeline import KEY, SLICE, block_number, known

LOWEST = -(2**62)

# lo: first state of each piece; shift: add value to the state instead of replacing it;
# closes: boundaries passed; fresh: the walk left right after closing a boundary
MAP_TYPE = "struct<lo:array<bigint>,shift:array<boolean>,value:array<bigint>,closes:array<bigint>,fresh:array<boolean>>"
STATE_TYPE = "struct<state:bigint,closes:bigint,fresh:boolean>"


def identity() -> list[tuple]:
    return [(LOWEST, True, 0, 0, False)]


def look_up(pieces: list[tuple], state: int) -> tuple[int, int, bool]:
    _, shift, value, closes, fresh = pieces[bisect.bisect_right(pieces, state, key=lambda p: p[0]) - 1]
    return (state + value if shift else value), closes, fresh


def compact(pieces: list[tuple]) -> list[tuple]:
    """Join neighbouring pieces that say the same."""
    out: list[tuple] = []
    for p in pieces:
        if not out or out[-1][1:] != p[1:]:
            out.append(p)
    return out


def compose(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The map that applies ``first`` and then ``second``."""
    starts = [p[0] for p in second]
    out = []
    for i, (lo, shift, value, closes, _) in enumerate(first):
        if not shift:
            state, more, fresh = look_up(second, value)
            out.append((lo, False, state, closes + more, fresh))
            continue
        hi = first[i + 1][0] if i + 1 < len(first) else None
        j = bisect.bisect_right(starts, lo + value) - 1 if lo > LOWEST else 0
        while j < len(second) and (j == 0 or hi is None or second[j][0] < hi + value):
            _, shift2, value2, closes2, fresh2 = second[j]
            at = lo if second[j][0] == LOWEST else max(lo, second[j][0] - value)
            out.append((at, shift2, value + value2 if shift2 else value2, closes + closes2, fresh2))
            j += 1
    return compact(out)


def pack(pieces: list[tuple]) -> dict:
    lo, shift, value, closes, fresh = zip(*pieces)
    return {"lo": list(lo), "shift": list(shift), "value": list(value), "closes": list(closes), "fresh": list(fresh)}


# ---------------------------------------------------------------- rows of slices as Arrow
#
# A batch holds thousands of slices with hundreds of values each.  One slice at a time becomes Python
# objects; results are kept as numbers and handed over every FLUSH of them.

FLUSH = 1 << 18
MAP_FIELDS = (("lo", pa.int64()), ("shift", pa.bool_()), ("value", pa.int64()), ("closes", pa.int64()), ("fresh", pa.bool_()))
STATE_FIELDS = (("state", pa.int64()), ("closes", pa.int64()), ("fresh", pa.bool_()))
_STATE = pa.struct(STATE_FIELDS)


def by_row(walk: Callable, assemble: Callable, returns: str):
    """An Arrow UDF: ``walk`` takes the values of one row and gives (result, size); ``assemble`` makes an array of results."""

    def run(batches):
        for columns in batches:
            columns = (columns,) if isinstance(columns, pa.Array) else columns  # a UDF of one column gets it bare
            done, held = [], 0
            for i in range(len(columns[0])):
                result, size = walk(*[c[i] for c in columns])
                done.append(result)
                held += size
                if held >= FLUSH:
                    yield assemble(done)
                    done, held = [], 0
            if done:
                yield assemble(done)

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR_ITER)


def numbers(scalar) -> np.ndarray:
    """The values of a list of Arrow."""
    return scalar.values.to_numpy(zero_copy_only=False)


def lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind))


def columns_of(rows: Sequence[tuple], fields) -> pa.StructArray:
    """An array of structs of lists from one tuple of numpy arrays per row."""
    return pa.StructArray.from_arrays([lists(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], [n for n, _ in fields])


def row_lists(rows: Sequence[Sequence[tuple]], names: Sequence[str]) -> pa.ListArray:
    """An array of lists of structs of integers."""
    items = [pa.array([x[j] for r in rows for x in r], pa.int64()) for j in range(len(names))]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(items, list(names)))


def flat(pieces: list[tuple]) -> tuple:
    return tuple(np.array(c, np.bool_ if kind == pa.bool_() else np.int64) for c, (_, kind) in zip(zip(*pieces), MAP_FIELDS))


def states(items: Sequence[tuple | None]) -> pa.Array:
    return pa.array([None if x is None else dict(zip(("state", "closes", "fresh"), x)) for x in items], _STATE)


def mapped(make: Callable):
    """UDF for map and cold of each slice; ``make`` gives its pieces and the cold state."""

    def walk(*row):
        pieces, cold = make(*row)
        return (flat(pieces), cold), 4 * len(pieces)

    def assemble(rows):
        return pa.StructArray.from_arrays([columns_of([m for m, _ in rows], MAP_FIELDS), states([c for _, c in rows])], ["map", "cold"])

    return by_row(walk, assemble, f"struct<map:{MAP_TYPE},cold:{STATE_TYPE}>")


def _cold(item) -> tuple[int, int, bool]:
    return int(item["state"]), int(item["closes"]), bool(item["fresh"])


def _maps(items: pa.StructArray) -> Iterator[tuple]:
    """The maps of consecutive slices, each a tuple of numpy arrays."""
    columns = [items.field("map").field(n) for n, _ in MAP_FIELDS]
    for i in range(len(items)):
        yield tuple(numbers(c[i]) for c in columns)


def _after(state: tuple[int, int, bool], m: tuple) -> tuple[int, int, bool]:
    lo, shift, value, closes, fresh = m
    i = int(np.searchsorted(lo, state[0], side="right")) - 1
    return int(state[0] + value[i] if shift[i] else value[i]), int(state[1] + closes[i]), bool(fresh[i])


def _compose_block(parts) -> tuple:
    items = parts.values
    cold = _cold(items.field("cold")[0].as_py())
    maps = _maps(items)
    first = next(maps)
    whole = list(zip(*[c.tolist() for c in first]))
    for m in maps:
        whole = compose(whole, list(zip(*[c.tolist() for c in m])))
        cold = _after(cold, m)
    return whole, cold


def _chain(at: str):
    """UDF for the entry state of every part of a row; null where the recording begins."""

    def walk(parts, *boxed):
        items = parts.values
        given = boxed[0].as_py() if boxed else None
        state = _cold(given[0]) if given else None
        places, cold, out = items.field(at).to_pylist(), items.field("cold"), []
        for i, m in enumerate(_maps(items)):
            out.append((places[i], state))
            state = _cold(cold[i].as_py()) if state is None else _after(state, m)
        return out, 4 * len(out)

    def assemble(rows):
        entries = pa.StructArray.from_arrays(
            [pa.array([p for r in rows for p, _ in r], pa.int64()), states([x for r in rows for _, x in r])], ["at", "entry"]
        )
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return by_row(walk, assemble, f"array<struct<at:bigint,entry:{STATE_TYPE}>>")


def slice_entries(maps: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """(keys, slice, entry) from (keys, slice, map, cold).

    ``cold`` is how a walk leaves the slice when the recording begins there.  ``entry`` is
    null for the first slice of a recording.
    """
    keys = list(keys)
    blocks = (
        known(maps, [*keys, SLICE])
        .withColumn("_block", block_number())
        .groupBy(*keys, "_block")
        .agg(_ordered_by(SLICE).alias("parts"))
    )
    compose_block, block_entries, entries = mapped(_compose_block), _chain("_block"), _chain(SLICE)
    whole = blocks.select(*keys, "_block", compose_block("parts").alias("whole"))
    chain = (
        whole.select(*keys, "_block", "whole.map", "whole.cold")
        .groupBy(*keys)
        .agg(_ordered_by("_block").alias("parts"))
        .select(*keys, F.explode(block_entries("parts")).alias("e"))
        .select(*keys, F.col("e.at").alias("_block"), F.col("e.entry").alias("_entry"))
    )
    boxed = F.when(F.col("_entry").isNotNull(), F.array("_entry")).otherwise(F.array().cast(f"array<{STATE_TYPE}>"))
    return (
        blocks.join(chain.hint("shuffle_hash"), [*keys, "_block"])
        .select(*keys, F.explode(entries("parts", boxed)).alias("e"))
        .select(*keys, F.col("e.at").alias(SLICE), F.col("e.entry").alias("entry"))
    )


def _ordered_by(position: str):
    """Collected (position, map, cold), sorted by position (unique within the group)."""
    return F.array_sort(F.collect_list(F.struct(position, "map", "cold")))


# ---------------------------------------------------------------- closing buckets


def closing_map(ends: np.ndarray, span: int) -> list[tuple]:
    """State = where the open bucket began; it closes at the first end >= state + span."""
    peaks = np.maximum.accumulate(ends)
    is_peak = np.r_[True, peaks[1:] > peaks[:-1]]
    tops = peaks[is_peak]
    at_last_word = np.flatnonzero(is_peak) == len(ends) - 1
    n = len(tops)
    # where the walk goes from each top, how often it closes on the way, and the last top it closes at
    onward = np.append(np.searchsorted(tops, tops + span), n)
    last, closes = np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0)
    while (onward[:n] < n).any():  # pointers double
        further = onward < n
        last[further] = last[onward[further]]
        closes[further] += closes[onward[further]]
        onward[further] = onward[onward[further]]
    leave, closes, fresh = tops[last[:n]], closes[:n], at_last_word[last[:n]]
    changes = np.flatnonzero(np.r_[True, (leave[1:] != leave[:-1]) | (closes[1:] != closes[:-1]) | (fresh[1:] != fresh[:-1])])
    lo = np.append(LOWEST, tops - span + 1)
    pieces = [(int(lo[i]), False, int(leave[i]), int(closes[i]), bool(fresh[i])) for i in changes]
    pieces.append((int(lo[n]), True, 0, 0, False))
    return compact(pieces)


def closing_walk(ends: np.ndarray, state: int, closed: int, fresh: bool, span: int):
    """Bucket number, bucket start and first-word flag of every word."""
    peaks = np.maximum.accumulate(ends)
    n = len(ends)
    number, began, first = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    at = 0
    while at < n:
        stop = int(np.searchsorted(peaks, state + span))
        upto = min(stop + 1, n)
        number[at:upto], began[at:upto] = closed, state
        first[at] = fresh
        if stop >= n:
            break
        state, closed, fresh, at = int(ends[stop]), closed + 1, True, upto
    return number, began, first


def splitting_map(starts: np.ndarray, ends: np.ndarray, near: int, far: int) -> list[tuple]:
    """State = where the open bucket began; a word with near <= end - state <= far starts a new one.

    Words are taken from the last to the first; each overwrites what the map says for the states that it
    splits.  The pieces stand in descending order, so that the changes, which follow the words'
    times, happen at the end of the lists.
    """
    below = [-LOWEST]  # the pieces' first states, negated
    what: list[tuple] = [(True, 0, 0, False)]
    for start, end in zip(starts[::-1].tolist(), ends[::-1].tolist()):
        shift, value, closes, _ = what[bisect.bisect_left(below, -start)]
        state = start + value if shift else value
        lo, hi = end - far, end - near
        after = bisect.bisect_left(below, -(hi + 1))  # the piece that holds hi + 1, from which it goes on above
        until = bisect.bisect_right(below, -lo)  # pieces from here on begin below lo
        rest = what[after]
        top = [] if below[after] == -(hi + 1) else [-(hi + 1)]
        keep = after + 1 if not top else after
        # pieces that begin in lo..hi go; the one that holds hi + 1 keeps its part above
        below[keep:until] = [*top, -lo]
        what[keep:until] = [*([rest] if top else []), (False, state, closes + 1, False)]
    return compact([(-x, *w) for x, w in zip(reversed(below), reversed(what))])


def splitting_walk(starts: np.ndarray, ends: np.ndarray, state: int, splits: int, cold: bool, near: int, far: int):
    n = len(ends)
    number, began, first = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    at = 0
    if cold and n:
        first[0], number[0], began[0], at = True, splits, state, 1
    while at < n:
        low, width, found = at, 64, n
        while low < n and found == n:  # the next word that splits is seldom far
            away = ends[low : low + width] - state
            hits = np.flatnonzero((near <= away) & (away <= far))
            if len(hits):
                found = low + int(hits[0])
            low, width = low + width, 2 * width
        number[at:found], began[at:found] = splits, state
        if found == n:
            break
        state, splits = int(starts[found]), splits + 1
        number[found], began[found], first[found] = splits, state, True
        at = found + 1
    return number, began, first, state, splits
