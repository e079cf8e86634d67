"""Suffix arrays of many texts at once, in linear work by grouping, without recursive renaming.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups are taken from the greatest
to the smallest; each suffix of a group points to the nearest earlier suffix of a smaller group, and
the suffixes pointed to move, by how often they are, into new groups right behind their old ones.
Second phase: the order of each group's suffixes follows from the order already found, through the
same previous-smaller pointers.

The texts of a batch are handled in step: a step takes the greatest group left (later: the next slot)
of every text, in array operations over all of them. There are as many steps as the text of most
groups has groups, so texts of like length belong into one batch.
"""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def _grouped(symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots' suffixes, each suffix's first slot of its group, and sizes of groups by first slot, by first symbol.

    Place 0 of each text is no suffix: it stands before the text and is in a group below all others.
    """
    lengths = np.diff(offs)
    text = np.repeat(np.arange(len(lengths)), lengths)
    by = text * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(by, kind="stable")
    by = by[order]
    new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    n = np.diff(np.concatenate([new, [len(order)]]))
    group, size = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
    group[order] = np.repeat(new, n)
    size[new] = n
    return order, group, size


def suffix_arrays(symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of each text symbols[offs[i]:offs[i + 1]] in order, text after text.

    The last symbol of a text must be 1 and smaller than all its others.
    """
    lengths = np.diff(offs)
    count = len(lengths)
    # a place before each text, of symbol 0
    starts = offs[:-1] + np.arange(count)
    padded = np.zeros(len(symbols) + count, symbols.dtype)
    padded[ranges(starts + 1, lengths)] = symbols
    order, group, size = _grouped(padded, np.concatenate([starts, [len(padded)]]))
    slot = np.empty(len(order), np.int64)
    slot[order] = np.arange(len(order))
    pointer = np.zeros(len(order), np.int64)
    moving = np.zeros(len(order), bool)
    group[starts] = -1

    end = starts + lengths  # last slot that is not taken yet
    floor = starts
    while len(end):
        first = group[order[end]]
        own = end - first + 1
        members = order[ranges(first, own)]
        limit = np.repeat(first, own)
        before = members - 1
        live = np.flatnonzero(group[before] > limit)
        while len(live):
            at = pointer[before[live]]
            before[live] = at
            live = live[group[at] > limit[live]]
        pointer[members] = before
        live = np.flatnonzero(group[before] == limit)
        while len(live):  # over suffixes of the same group, in doubling steps
            at = pointer[before[live]]
            before[live] = at
            pointer[members[live]] = at
            live = live[group[at] == limit[live]]

        hit = np.sort(before[group[before] >= 0])
        if len(hit):
            new = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]]))
            times = np.diff(np.concatenate([new, [len(hit)]]))
            movers = hit[new]
            old = group[movers]
            by = np.argsort(old * (len(before) + 1) - times)  # by group, most often first
            movers, old, times = movers[by], old[by], times[by]
            head = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            many = np.diff(np.concatenate([head, [len(old)]]))
            top = old[head] + size[old[head]]  # one beyond the group's last slot
            target = np.repeat(top + head, many) - 1 - np.arange(len(old))
            # what stands on the targets and stays goes to the slots that the movers leave
            was = slot[movers]
            left = was[was < np.repeat(top - many, many)]
            moving[movers] = True
            there = order[target]
            other = there[~moving[there]]
            moving[movers] = False
            order[left], slot[other] = other, left
            order[target], slot[movers] = movers, target
            # a new group for each number of times
            size[old[head]] -= many
            cut = np.flatnonzero(np.concatenate([(old[1:] != old[:-1]) | (times[1:] != times[:-1]), [True]]))
            n = np.diff(np.concatenate([[-1], cut]))
            size[target[cut]] = n
            group[movers] = np.repeat(target[cut], n)
        end = first - 1
        live = end > floor
        if not live.all():
            end, floor = end[live], floor[live]

    result, free = np.full(len(order), -1, np.int64), np.arange(len(order))
    placed = np.zeros(len(order), bool)
    placed[starts] = True
    result[starts + 1] = starts + lengths  # the last suffix is the least
    placed[starts + lengths] = True
    text = np.argsort(-lengths, kind="stable")
    begin, longest = starts[text], lengths[text]
    for i in range(1, int(lengths.max(initial=0)) + 1):
        some = np.searchsorted(-longest, -i, "right")  # texts with an i-th slot
        s = result[begin[:some] + i] - 1
        s = s[~placed[s]]
        while len(s):
            g = group[s]
            to = free[g]
            result[to] = s
            free[g] = to + 1
            placed[s] = True
            s = pointer[s]
            s = s[~placed[s]]
    kept = np.ones(len(result), bool)
    kept[starts] = False
    return result[kept] - np.repeat(starts + 1, lengths)
