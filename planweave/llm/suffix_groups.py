"""Suffix arrays of many strings at once by the linear grouping construction.

Phase 1 keeps the suffixes of every string in groups, ordered by the string that a group's suffixes have in common, which grows into their
Lyndon prefix. Groups are processed in descending order: each of a group's suffixes looks up its previous smaller suffix (the nearest one before
it in a lower group), and suffixes that are looked up move up within their old group, further the more often they were. Phase 2 walks
along the suffix array and emits each group's suffixes in order: behind suffix i come i-1 and its chain of previous smaller suffixes, each
taking the next place of its group. Nothing is renamed and there is no recursion.

The strings are independent, so a step handles the current group of every string together in arrays. The number of steps is that of
the longest string, and the work is linear in the bytes.
"""

from __future__ import annotations

import numpy as np


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] numbers, then start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays, one after the other, of strings that lie one after the other in ``symbols``.

    Every string ends with the symbol 0, which is nowhere else. The result holds places in ``symbols``.
    """
    count = len(symbols)
    if not count:
        return np.zeros(0, np.int32)
    lengths = np.asarray(lengths, np.int64)
    off = (np.cumsum(lengths) - lengths + 1).astype(np.int32)  # all places are shifted by one: place 0 is in front of everything
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    key = owner * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    arr = np.zeros(count + 1, np.int32)
    arr[1:] = order + 1
    place = np.zeros(count + 1, np.int32)
    place[arr[1:]] = np.arange(1, count + 1, dtype=np.int32)
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) + 1
    sizes = np.diff(np.append(fresh, count + 1))
    group = np.zeros(count + 1, np.int32)  # a group's name is its first place in arr
    group[arr[1:]] = np.repeat(fresh, sizes)
    size = np.zeros(count + 2, np.int32)
    size[fresh] = sizes
    first_of = np.zeros(count + 2, np.int32)  # by a group's last place
    first_of[fresh + sizes - 1] = fresh
    prev = np.arange(-1, count, dtype=np.int32)
    moved_mark = np.zeros(count + 2, bool)
    left = off - 1  # of each string: the place in front of it
    end = (off + lengths - 1).astype(np.int32)
    live = np.arange(len(lengths))
    while len(live):
        last = end[live]
        g = first_of[last]
        n = last - g + 1
        members = arr[_spread(g, n)]
        mine, floor = np.repeat(g, n), np.repeat(left[live], n)
        todo = np.arange(len(members))
        at = members - 1
        while True:  # places between a suffix and prev[suffix] are in groups no lower than its own, so it may jump along
            up = group[at] >= mine[todo]
            if not up.any():
                break
            todo, at = todo[up], prev[at[up]]
            prev[members[todo]] = at
        end[live] = g - 1
        live = live[g - 1 > left[live]]
        parents = prev[members]
        parents = parents[parents > floor]
        if not len(parents):
            continue
        parents.sort()
        cut = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        times = np.diff(np.append(cut, len(parents)))
        parents = parents[cut]
        old = group[parents]
        by = np.lexsort((times, old))
        parents, times, old = parents[by], times[by], old[by]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        heads = np.flatnonzero(new_old)
        moved = np.diff(np.append(heads, len(old)))
        names, total = old[heads], size[old[heads]]
        keep = total - moved
        slots = _spread(names + keep, moved)  # the last places of the old groups
        # swap the moved suffixes into these slots
        now = place[parents]
        moved_mark[now] = True
        evict = slots[~moved_mark[slots]]
        moved_mark[now] = False
        inside = now >= np.repeat(names + keep, moved)
        vacant = np.sort(now[~inside])
        out = arr[evict]
        arr[vacant] = out
        place[out] = vacant
        arr[slots] = parents
        place[parents] = slots
        step = np.flatnonzero(new_old | np.concatenate([[True], times[1:] != times[:-1]]))
        step_size = np.diff(np.append(step, len(old)))
        step_name = slots[step]
        size[names] = keep
        kept = keep > 0
        first_of[(names + keep - 1)[kept]] = names[kept]
        size[step_name] = step_size
        first_of[step_name + step_size - 1] = step_name
        group[parents] = np.repeat(step_name, step_size)

    sa = np.zeros(count + 1, np.int32)
    place[:] = 0  # from here on: whether a suffix is placed
    free = np.arange(count + 2, dtype=np.int32)
    ends = (off + lengths - 1).astype(np.int32)
    sa[off] = ends
    place[ends] = 1
    live = np.argsort(-lengths, kind="stable")
    how_many = np.searchsorted(-lengths[live], -np.arange(int(lengths.max())), side="left")  # strings longer than i
    start, low = off[live], left[live]
    for i, k in enumerate(how_many):
        j, floor = sa[start[:k] + i] - 1, low[:k]
        while True:
            on = (j > floor) & (place[j] == 0)
            if not on.any():
                break
            j, floor = j[on], floor[on]
            name = group[j]
            slot = free[name]
            sa[slot] = j
            place[j] = 1
            free[name] = slot + 1
            j = prev[j]
    return sa[1:] - 1
