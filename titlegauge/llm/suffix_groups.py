"""Suffix arrays by linear grouping, for many small texts at once.

The construction has two phases. The first sorts the suffixes into groups by their Lyndon prefix. It
starts with a group per first symbol and takes the groups in descending order. For each suffix of the
current group it follows previous-smaller pointers to the nearest earlier suffix of a lower group;
the context of that suffix ends where the current one begins, so it grows by the current group's
context, once for each member that points to it. Such suffixes leave their group for new groups
directly above it, ordered by how often the context was appended. The second phase takes the suffixes
in ascending order and, from the one before each, follows the same pointers and appends the suffixes
it meets to their groups. Neither phase renames symbols or recurses.

All texts of a batch advance together, each by its own current group, so that a step works on arrays.
"""

from __future__ import annotations

import numpy as np


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    ahead = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(ahead - begin, size)


def _group_suffixes(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each position, named by the first rank it covers; previous-smaller pointers).

    ``begin`` and ``end`` bound the texts. The position before each begin is a guard of no text.
    """
    n = len(symbols)
    lane = np.zeros(n, np.int64)
    lane[begin] = 1
    lane = np.cumsum(lane) - 1
    inside = np.zeros(n, bool)
    inside[_ranges(begin, end - begin)] = True
    position = np.flatnonzero(inside)
    order = position[np.lexsort((symbols[position], lane[position]))]
    ranked = np.full(n, -1, np.int64)
    ranked[position] = order  # texts are contiguous, so ranks of a text are its positions
    new = np.ones(len(order), bool)
    new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (lane[order[1:]] != lane[order[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    group = np.full(n, -1, np.int64)
    group[order] = np.repeat(position[first], sizes)
    place = np.full(n, -1, np.int64)
    place[order] = position
    size_of = np.zeros(n, np.int64)
    size_of[position[first]] = sizes
    previous = np.full(n, -1, np.int64)
    cursor = end.copy()
    while True:
        active = np.flatnonzero(cursor > begin)
        if not len(active):
            return group, previous
        top = group[ranked[cursor[active] - 1]]
        members = ranked[_ranges(top, cursor[active] - top)]
        own = np.repeat(top, cursor[active] - top)
        cursor[active] = top
        at = members - 1
        walking = np.flatnonzero(group[at] >= own)
        while len(walking):
            here = at[walking]
            # A member of the same group has the same pointer as what lies before it.
            at[walking] = np.where(group[here] > own[walking], previous[here], here - 1)
            walking = walking[group[at[walking]] >= own[walking]]
        previous[members] = at
        grows = np.sort(at[group[at] >= 0])
        if not len(grows):
            continue
        edge = np.flatnonzero(np.r_[True, grows[1:] != grows[:-1]])
        moved, times = grows[edge], np.diff(np.append(edge, len(grows)))
        _split(moved, times, group, ranked, place, size_of)


def _split(moved, times, group, ranked, place, size_of) -> None:
    """Move suffixes out of their groups into new ones directly above, by ``times`` ascending."""
    old = group[moved]
    order = np.lexsort((times, old))
    moved, times, old = moved[order], times[order], old[order]
    edge = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
    left = np.diff(np.append(edge, len(old)))
    source = old[edge]
    upper = source + size_of[source] - left  # where the new groups begin
    target = _ranges(upper, left)
    # Suffixes that stay but lie in the upper part take the places that moved ones leave below it.
    flag = np.zeros(0, bool)
    border = np.repeat(upper, left)
    vacated = place[moved]
    in_upper = vacated >= border
    staying = ranked[target]
    flag = np.isin(staying, moved, assume_unique=True)
    free = np.sort(vacated[~in_upper])
    displaced = staying[~flag]
    ranked[free] = displaced
    place[displaced] = free
    ranked[target] = moved
    place[moved] = target
    new = np.ones(len(moved), bool)
    new[1:] = (old[1:] != old[:-1]) | (times[1:] != times[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(moved)))
    size_of[source] -= left
    group[moved] = np.repeat(target[starts], sizes)
    size_of[target[starts]] = sizes


def _order_groups(group: np.ndarray, previous: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of each text in ascending order, at the ranks begin .. end - 1 of the text."""
    n = len(group)
    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    done = group < 0
    # The end mark is the smallest suffix of its text.
    out[begin] = end - 1
    done[end - 1] = True
    rank, at = begin + 1, end - 2
    lanes = np.arange(len(begin))
    while len(lanes):
        fresh = ~done[at]
        here = at[fresh]
        slot = group[here]
        out[front[slot]] = here
        front[slot] += 1
        done[here] = True
        # After a suffix its pointer; where the chain ends, the suffix before the next rank.
        stay = (rank < end[lanes]) | fresh
        ahead = np.where(fresh, at, out[np.minimum(rank, end[lanes] - 1)] - 1)
        ahead[fresh] = previous[here]
        rank = rank + ~fresh
        lanes, rank, at = lanes[stay], rank[stay], ahead[stay]
    return out


def suffix_arrays(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The suffix array of each text (arrays of numbers from 0), without its end mark."""
    texts = [np.asarray(t, np.int64) for t in texts]
    full = [i for i, t in enumerate(texts) if len(t)]
    result = [np.zeros(0, np.int64) for _ in texts]
    if not full:
        return result
    sizes = np.array([len(texts[i]) for i in full])
    # Layout of a text: guard, symbols from 1, end mark 0.
    begin = np.cumsum(sizes + 2) - sizes - 1
    end = begin + sizes + 1
    symbols = np.full(int(end[-1]), -1, np.int64)
    for i, a in zip(full, begin, strict=True):
        symbols[a : a + len(texts[i])] = texts[i] + 1
        symbols[a + len(texts[i])] = 0
    group, previous = _group_suffixes(symbols, begin, end)
    order = _order_groups(group, previous, begin, end)
    for i, a, b in zip(full, begin, end, strict=True):
        result[i] = order[a + 1 : b] - a
    return result
