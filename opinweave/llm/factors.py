"""Sampled suffixes of texts and their longest previous factors, in numpy.

A window is ``span`` bytes. Its anchor is the leftmost of its ``gram``-byte strings with the least
hash, so equal windows have equal anchors at equal places; an anchor serves a range of window
starts. Windows are only compared with windows of the same anchor and the same place in it.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))
_STEP = np.uint64(0xE7037ED1A0B428DB)
CHUNK = 1 << 20


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, from those of half the length."""
    out, have, done = None, _VALUE[raw], 0
    width, rest = 1, gram
    factor = int(_STEP)
    while rest:
        if rest & 1:
            if out is None:
                out, done = have, width
            else:
                n = len(raw) - done - width + 1
                out = out[:n] * np.uint64(pow(factor, width, 1 << 64)) + have[done : done + n]
                done += width
        rest >>= 1
        if rest:
            n = len(have) - width
            have = have[:n] * np.uint64(pow(factor, width, 1 << 64)) + have[width : width + n]
            width *= 2
    return mix64(out)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    have, step = keys, 1
    while step * 2 <= width:
        have = np.minimum(have[: len(have) - step], have[step:])
        step *= 2
    if step < width:
        n = len(keys) - width + 1
        have = np.minimum(have[:n], have[width - step : width - step + n])
    return have


def anchors(raw: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """``hash, place, first, last``: anchors and the range of window starts of each.

    ``raw`` holds texts one after another; windows never cross their ``offsets``.
    """
    found = []
    for at in range(0, max(len(raw) - span + 1, 0), CHUNK):
        piece = raw[at : at + CHUNK + span - 1]
        n = len(piece) - span + 1
        hashes = _gram_hashes(piece, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        least = _sliding_least((hashes & ~low) | place, span - gram + 1)[:n]
        least = (least & low).astype(np.int64)
        valid = np.ones(n, bool)
        lo, hi = np.searchsorted(offsets, [at, at + len(piece)], side="left")
        for end in offsets[max(lo, 1) : hi + 1].tolist():  # windows that start too near an end
            valid[max(0, end - span + 1 - at) : max(0, end - at)] = False
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        stop = np.ones(n, bool)
        stop[:-1] = (least[1:] != least[:-1]) | ~valid[1:]
        last = np.flatnonzero(stop & valid)
        found.append((hashes[least[first]], least[first] + at, first + at, last + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges one after another, and their offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[at], offsets


def smaller_neighbours(rank: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest earlier and the nearest later one of its run with a smaller rank.

    -1 where there is none. Pointers jump over entries known to be larger, all at once.
    """
    n = len(rank)

    def previous(r: np.ndarray, g: np.ndarray) -> np.ndarray:
        to = np.arange(n) - 1
        active = np.flatnonzero(to >= 0)
        while active.size:
            at = to[active]
            gone = g[at] != g[active]
            to[active[gone]] = -1
            active, at = active[~gone], at[~gone]
            larger = r[at] > r[active]
            active, at = active[larger], at[larger]
            to[active] = to[at]
            active = active[to[active] >= 0]
        return to

    back = previous(rank[::-1], run[::-1])[::-1]
    return previous(rank, run), np.where(back >= 0, n - 1 - back, -1)


def removed(
    group: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray,
    data: np.ndarray, offsets: np.ndarray, span: int, gram: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sampled suffix the first and last window start, relative to its anchor, that recurs,
    and how many windows do.

    ``group`` is the anchor's hash, ``rank`` the order of the places; a suffix covers the window
    starts ``-left`` to ``-right`` (``left >= right >= 0``) and ``data`` its bytes. Suffixes are
    sorted by what follows the anchor; each step to the left then sorts by one more byte and the
    order so far. Entries of equal windows stand together in that order, and a window has an
    earlier match if a smaller rank precedes or follows it there: its longest previous factor is
    ``span`` at least. Returns ``first > last`` for none.
    """
    n = len(group)
    reach = span - gram
    width = reach + span
    table = np.zeros((n, width), np.uint8)
    lengths = np.diff(offsets)
    column = np.arange(len(data)) - np.repeat(offsets[:-1], lengths) + np.repeat(reach - left, lengths)
    table[np.repeat(np.arange(n), lengths), column] = data
    first, last, found = np.full(n, 1, np.int64), np.full(n, 0, np.int64), np.zeros(n, np.int64)
    after = np.ascontiguousarray(table[:, reach:]).view(f"S{span}").ravel()
    _, group = np.unique(group, return_inverse=True)
    order = np.lexsort([after, group])
    for o in range(reach + 1):
        if o:  # one more byte to the left
            byte = table[order, reach - o].astype(np.int64)
            order = order[np.argsort((group[order] << 8) | byte, kind="stable")]
        live = order[(left[order] >= o) & (right[order] <= o)]
        if len(live) < 2:
            continue
        same = group[live[1:]] == group[live[:-1]]
        i = np.flatnonzero(same)
        lo = reach - o
        equal = np.zeros(len(live), bool)
        for k in range(0, len(i), 1 << 16):
            part = i[k : k + (1 << 16)]
            equal[part + 1] = (table[live[part], lo : lo + span] == table[live[part + 1], lo : lo + span]).all(axis=1)
        run = np.cumsum(~equal)
        in_run = np.zeros(len(live), bool)
        in_run[1:] |= equal[1:]
        in_run[:-1] |= equal[1:]
        j = np.flatnonzero(in_run)
        if not len(j):
            continue
        before, behind = smaller_neighbours(rank[live[j]], run[j])
        dup = live[j[(before >= 0) | (behind >= 0)]]
        none = first[dup] > last[dup]
        last[dup[none]] = -o
        first[dup] = -o
        found[dup] += 1
    return first, last, found
