"""Steps of the chunk planners on one slice of a recording (see folds for the idea).

State = the position the next chunk starts from, in ms.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

from cadenza import folds

DONE = 2**61
SEARCH_MS = 5000
BREAK_BEFORE_MS, BREAK_AFTER_MS = 5000, 10000


def nearest_splits(pos: np.ndarray, starts, ends, length: int, chunk: int, overlap: int, shortest: int):
    """For each position: doubled split point, next position, index of the silence used (-1: none, -2: end)."""
    goal = pos + chunk
    used = np.full(len(pos), -1, np.int64)
    if len(starts):
        mids = starts + ends
        lo = np.searchsorted(starts, np.maximum(pos + shortest, goal - SEARCH_MS))
        hi = np.searchsorted(starts, np.minimum(goal + SEARCH_MS, length), side="right") - 1
        found = lo <= hi
        at = np.clip(np.searchsorted(mids, 2 * goal), 0, len(mids) - 1)
        right = np.clip(at, lo, np.maximum(hi, lo)).clip(0, len(mids) - 1)
        left = np.clip(at - 1, lo, np.maximum(hi, lo)).clip(0, len(mids) - 1)
        closer = np.where(np.abs(mids[left] - 2 * goal) <= np.abs(mids[right] - 2 * goal), left, right)
        used = np.where(found, closer, -1)
        split2 = np.where(found, mids[closer], 2 * goal)
    else:
        split2 = 2 * goal
    last = goal >= length - shortest
    split2 = np.where(last, 2 * length, split2)
    return split2, np.where(last, DONE, split2 // 2 - overlap), np.where(last, -2, used)


def nearest_split(pos: int, starts: list, ends: list, length: int, chunk: int, overlap: int, shortest: int) -> tuple[int, int]:
    """Doubled split point and next position, as ``nearest_splits`` finds them, for one position."""
    goal = pos + chunk
    if goal >= length - shortest:
        return 2 * length, DONE
    lo = bisect_left(starts, max(pos + shortest, goal - SEARCH_MS))
    hi = bisect_right(starts, min(goal + SEARCH_MS, length)) - 1
    split2 = 2 * goal
    if lo <= hi:
        at = bisect_left(range(len(starts)), 2 * goal, key=lambda i: starts[i] + ends[i])
        left, right = (starts[i] + ends[i] for i in (min(max(at - 1, lo), hi), min(max(at, lo), hi)))
        split2 = left if abs(left - 2 * goal) <= abs(right - 2 * goal) else right
    return split2, split2 // 2 - overlap


def split_map(begin: int, end: int, starts, ends, length: int, chunk: int, overlap: int, shortest: int) -> list[tuple]:
    """Where a plan that enters [begin, end) at any position leaves it."""
    reach, near = chunk + SEARCH_MS, max(shortest, chunk - SEARCH_MS)
    mids = starts + ends
    edges = np.concatenate(
        [
            [begin],
            starts - reach,
            starts - near + 1,
            (mids[:-1] + mids[1:]) // 4 - chunk + 1,
            [length - shortest - chunk],
        ]
    ).astype(np.int64)
    edges = np.unique(edges[(edges >= begin) & (edges < end)])
    _, after, used = nearest_splits(edges, starts, ends, length, chunk, overlap, shortest)
    step = [(folds.LOWEST, True, 0, 0, False)]
    for p, nxt, u in zip(edges.tolist(), after.tolist(), used.tolist()):
        step.append((p, True, nxt - p, 1, False) if u == -1 else (p, False, nxt, 1, False))
    step.append((end, True, 0, 0, False))
    step = folds.compact(step)
    whole = step
    while True:  # steps double
        further = folds.compose(whole, whole)
        if further == whole:
            return whole
        whole = further


def split_walk(pos: int, number: int, end: int, starts, ends, length: int, chunk: int, overlap: int, shortest: int):
    """Split points (number, doubled ms) made from positions below ``end``; and how the walk leaves."""
    out = []
    starts, ends = np.asarray(starts).tolist(), np.asarray(ends).tolist()
    while pos < end:
        split2, pos = nearest_split(pos, starts, ends, length, chunk, overlap, shortest)
        number += 1
        out.append((number, split2))
    return out, pos, number


def break_points(pos: np.ndarray, starts, ends, length: int, target: int) -> np.ndarray:
    """Middle of the longest silence around each target end, else the target itself."""
    goal = pos + target
    lo, hi = np.maximum(goal - BREAK_BEFORE_MS, pos), np.minimum(goal + BREAK_AFTER_MS, length)
    best, widest = goal.copy(), np.zeros(len(pos), np.int64)
    if len(starts):
        first = np.searchsorted(ends, lo, side="right")
        for k in range(int((np.searchsorted(starts, hi) - first).max(initial=0))):
            i = np.minimum(first + k, len(starts) - 1)
            a, b = np.maximum(starts[i], lo), np.minimum(ends[i], hi)
            wider = (first + k < len(starts)) & (b - a > widest)
            best = np.where(wider, a + (b - a) // 2, best)
            widest = np.where(wider, b - a, widest)
    return np.minimum(np.where(lo < hi, best, goal), length)


def break_point(pos: int, starts: list, ends: list, length: int, target: int) -> int:
    """``break_points`` of one position."""
    goal = pos + target
    lo, hi = max(goal - BREAK_BEFORE_MS, pos), min(goal + BREAK_AFTER_MS, length)
    best, widest = goal, 0
    if lo < hi:
        for i in range(bisect_right(ends, lo), bisect_left(starts, hi)):
            a, b = max(starts[i], lo), min(ends[i], hi)
            if b - a > widest:
                best, widest = a + (b - a) // 2, b - a
    return min(best, length)


def break_forms(low: int, high: int, starts, ends, length: int, target: int):
    """How the break point depends on the position, for positions low to high - 1.

    Yields (from, to, kind, value): the break is ``value`` (kind 0), the position plus ``value`` (1), or half of
    that (2).  Between the positions where the search range meets an end of a silence, the part of each
    silence inside the range grows or shrinks with the position or stays; the widest is followed
    along these lines.
    """
    left, right = max(target - BREAK_BEFORE_MS, 0), target + BREAK_AFTER_MS
    first, stop = np.searchsorted(ends, low + left, side="right"), np.searchsorted(starts, min(high + right, length))
    s, e = starts[first:stop], ends[first:stop]
    edges = np.concatenate([[low, high, length - right, length - left, length - target], s - left, e - left, s - right, e - right]).astype(np.int64)
    edges = np.unique(np.concatenate([edges, edges + 1]))
    edges = edges[(edges >= low) & (edges <= high)].tolist()
    for at, end in zip(edges, edges[1:]):
        while at < end:
            lo, hi = at + left, min(at + right, length)
            goal = (1, target) if at + target <= length else (0, length)
            if lo >= hi:
                yield at, end, *goal
                break
            moves = 0 if at + right >= length else 1
            i, j = int(np.searchsorted(e, lo, side="right")), int(np.searchsorted(s, hi))
            a, b = np.maximum(s[i:j], lo), np.minimum(e[i:j], hi)
            width, inner, outer = b - a, s[i:j] <= lo, e[i:j] >= hi
            slope = np.where(outer, moves, 0) - inner
            c = int(np.argmax(width)) if j > i else -1
            if c < 0 or width[c] <= 0:
                # none is inside; one may come in at the next edge only
                upto = end if c < 0 or (slope <= 0).all() else at + 1
                yield at, upto, *goal
                at = upto
                continue
            faster = slope - slope[c]
            behind = width[c] - width
            # a later silence must become wider, an earlier one as wide
            until = np.where(np.arange(j - i) > c, behind // np.maximum(faster, 1) + 1, -(-behind // np.maximum(faster, 1)))
            until = until[faster > 0]
            upto = min(end, at + max(1, int(until.min()))) if len(until) else end
            shrinks = int(width[c]) if slope[c] < 0 else 0  # it must stay inside
            if shrinks:
                upto = min(upto, at + max(1, shrinks))
            x, y = (left if inner[c] else int(s[i + c])), (right if outer[c] and moves else int(b[c]))
            kind = int(bool(inner[c])) + int(bool(outer[c] and moves))
            yield (at, upto, 0, (x + y) // 2) if kind == 0 else (at, upto, 2, x + y) if kind == 1 else (at, upto, 1, (x + y) // 2)
            at = upto


def break_map(begin: int, end: int, starts, ends, length: int, target: int, shortest: int) -> list[tuple]:
    """Where a plan that enters [begin, end) leaves it; entries lie within one target plus the search range of ``begin``.

    Ranges of entries are walked together: after any number of steps the position is a constant or
    (entry + value) >> halvings.  Ranges end where the form of a step changes, so that the work
    follows the silences, not the milliseconds.
    """
    stop = min(end, length)
    last = min(end, length, begin + target + BREAK_AFTER_MS) + 1
    known: dict[int, tuple[int, int]] = {}
    s, e = np.asarray(starts).tolist(), np.asarray(ends).tolist()

    def walked(pos: int) -> tuple[int, int]:
        path = []
        while pos < stop and pos not in known:
            path.append(pos)
            pos = break_point(pos, s, e, length, target)
        final, kept = known.get(pos, (pos, 0))
        for p in reversed(path):
            kept += pos - p >= shortest
            known[p] = final, kept
            pos = p
        return final, kept

    todo, done = [(begin, last, 0, 0, 0)], []
    while todo:
        lo, hi, halved, value, kept = todo.pop()
        a, b = (lo + value) >> halved, (hi - 1 + value) >> halved
        if a >= stop:
            done.append((lo, hi, halved, value, kept))
        elif a == b:
            final, more = walked(a)
            done.append((lo, hi, -1, final, kept + more))
        else:
            if b >= stop:
                at = (stop << halved) - value
                done.append((at, hi, halved, value, kept))
                hi, b = at, stop - 1
            for x, y, kind, z in break_forms(a, b + 1, starts, ends, length, target):
                # chunks that begin before ``cut`` are long enough
                cut = z - shortest + 1 if kind == 0 else z - 2 * shortest + 1 if kind == 2 else y if z >= shortest else x
                for u, v in ((x, min(y, cut)), (max(x, cut), y)):
                    if u >= v:
                        continue
                    first, until, more = max(lo, (u << halved) - value), min(hi, (v << halved) - value), kept + (u < cut)
                    if kind == 0:
                        final, further = walked(z)
                        done.append((first, until, -1, final, more + further))
                    else:
                        todo.append((first, until, halved + (kind == 2), value + (z << halved), more))
    pieces = [(folds.LOWEST, True, 0, 0, False)]
    for lo, hi, halved, value, kept in sorted(done):
        if halved < 0:
            pieces.append((lo, False, DONE if value >= length else value, kept, False))
        elif halved == 0 and hi - 1 + value < length:
            pieces.append((lo, True, value, kept, False))
        else:
            at = lo
            while at < hi:
                pos = (at + value) >> halved
                pieces.append((at, False, DONE if pos >= length else pos, kept, False))
                at = hi if pos >= length else ((pos + 1) << halved) - value
    pieces.append((last, True, 0, 0, False))
    return folds.compact(pieces)


def break_walk(pos: int, number: int, end: int, starts, ends, length: int, target: int, shortest: int):
    """Kept chunks (number, start, stop) begun below ``end``; and how the walk leaves."""
    out = []
    starts, ends = np.asarray(starts).tolist(), np.asarray(ends).tolist()
    while pos < min(end, length):
        stop = break_point(pos, starts, ends, length, target)
        if stop - pos >= shortest:
            out.append((number, pos, stop))
            number += 1
        pos = stop
    return out, (DONE if pos >= length else pos), number
