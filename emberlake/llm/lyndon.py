"""Suffix arrays of many short strings at once, by grouping suffixes on their Lyndon prefixes.

First the suffixes of each string are grouped by their first character. Groups are taken in descending order. In a group
every suffix has a previous smaller one: the nearest to its left in a lower group. These are found on a list of suffixes
that aren't done, where a run of members of the group has one of them on its left; it moves to a new group right above
its own, the higher the longer the run, as its Lyndon prefix grows by that of the group as often. In the end the groups
are in the order of their Lyndon prefixes. Then suffixes are emitted in order: from the one emitted before each place,
along its previous smaller pointers, each takes the next free place of its group. Nothing is renamed, no string is sorted
again, and the work is linear in the strings.

All strings are worked on in step: a round takes the highest group of each of them, in numpy, so its cost is that of their
members and not of Python's loop. So strings of about one length go together.
"""

from __future__ import annotations


def grouped(text, starts):
    """Phase one: (gstart, prev) of each suffix; ``text`` holds strings one after the other, each with its least code at its end alone.

    ``gstart`` is the first place of a suffix's group in the order of all suffixes, ``prev`` its previous smaller suffix in its
    string, len(text) if there is none.
    """
    import numpy as np

    n = len(text)
    ends = np.append(starts[1:], n)
    string = np.repeat(np.arange(len(starts)), ends - starts)
    key = string * (int(text.max(initial=0)) + 1) + text
    order = np.argsort(key, kind="stable")
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    size = np.diff(np.append(first, n))
    gstart = np.empty(n + 1, np.int64)
    gstart[order] = np.repeat(first, size)
    gend = np.zeros(n + 1, np.int64)
    gend[first] = first + size
    left, right = np.arange(-1, n), np.arange(1, n + 2)  # n: no neighbour
    left[starts], right[ends - 1] = n, n
    prev = np.full(n, n)
    todo, low = ends.copy(), starts.copy()
    into, outof = np.zeros(n, bool), np.zeros(n, bool)
    while len(todo):
        begin = gstart[order[todo - 1]]
        many = todo - begin
        if len(many) == (total := int(many.sum())):
            members = order[begin]  # one of each string: in the order of strings already
        else:
            members = np.sort(order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(total)])
        before = left[members]
        heads = np.flatnonzero(np.append(True, before[1:] != members[:-1]))
        runs = np.diff(np.append(heads, total))
        ahead, behind = before[heads], right[members[np.append(heads[1:], total) - 1]]
        prev[members] = np.repeat(ahead, runs)
        right[ahead], left[behind] = behind, ahead
        some = ahead < n
        up, runs = ahead[some], runs[some]
        if len(up):
            key = gstart[up] * (n + 1) + runs
            by = np.argsort(key, kind="stable")
            up, key = up[by], key[by]
            group = gstart[up]
            g0 = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            moved = np.diff(np.append(g0, len(up)))
            old = group[g0]
            top = gend[old]
            to = np.repeat(top - np.cumsum(moved), moved) + np.arange(len(up))
            at = slot[up]
            into[to], outof[at] = True, True
            holes, others = at[~into[at]], order[to[~outof[to]]]
            into[to], outof[at] = False, False
            order[holes], slot[others] = others, holes
            order[to], slot[up] = up, to
            s0 = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(s0, len(up)))
            gend[old] = top - moved
            gend[to[s0]] = to[s0] + size
            gstart[up] = np.repeat(to[s0], size)
        todo = begin
        if (done := todo <= low).any():
            todo, low = todo[~done], low[~done]
    return gstart[:n], prev


def suffix_array(text, starts):
    """The suffixes of each string in order: places from a string's start on hold its own suffixes.

    ``text`` has small non-negative codes; each string ends with a code that is less than all its others.
    """
    import numpy as np

    n = len(text)
    gstart, prev = grouped(text, starts)
    ends = np.append(starts[1:], n)
    free = np.arange(n)  # the next free place of the group that begins there
    done = np.zeros(n + 1, bool)
    done[n] = True
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    out = np.full(n, -1)
    out[starts] = ends - 1
    done[ends - 1] = True
    free[gstart[ends - 1]] += 1
    place, stop = starts.copy(), ends.copy()
    suffix = ends - 2
    suffix[ends - starts == 1] = n
    while len(place):
        go = np.flatnonzero(~done[suffix])
        s = suffix[go]
        g = gstart[s]
        f = free[g]
        out[f] = s
        free[g] = f + 1
        done[s] = True
        suffix[go] = prev[s]
        turn = np.flatnonzero(done[suffix])  # these chains have ended: on to the next place
        place[turn] += 1
        if (over := place == stop).any():
            place, stop, suffix = place[~over], stop[~over], suffix[~over]
            turn = np.flatnonzero(done[suffix])
        emitted = out[place[turn]]
        suffix[turn] = np.where(is_start[emitted], n, emitted - 1)
    return out
