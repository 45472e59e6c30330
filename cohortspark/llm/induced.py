"""Suffix and common-prefix arrays by recursive induced sorting with disk-backed priority queues.

Only the leftmost suffixes of each ascending stretch ("seeds") are sorted by recursion; all others follow by induction. A pass walks through
the order as it grows: every suffix it meets puts its left neighbour, if that is of the wanted type, into a priority queue keyed by the
neighbour's character; entries of one key keep their order of arrival, which is their order among suffixes. A queue entry
is a tuple (place, common prefix with the entry before it under its key): the value is one more than the smallest common prefix met since
that key's last entry, so prefixes are carried along and never compared again. Recursion works on the names of the seeds' stretches;
names beyond ``base`` are written as several digits, so each level walks a small alphabet and handles whole buckets with numpy. The recursion
ends where at most ``direct`` names are left: those fit in memory and are ranked by stretches of doubling length.

A queue beyond ``array`` bytes lies in an unnamed mapped file, each key's entries together, so it is written and read in sequence key by
key. These files are private scratch of one task, like a spill, and vanish with it, also if it fails; nothing is passed on by them. ``depth`` bounds the common prefixes: longer ones are reported as ``depth``.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

#: numbers are 32 bits wide: a shard is far below 2^31 characters
_KIND = np.int32
_FAR = _KIND(1 << 30)


@dataclass(frozen=True)
class Plan:
    #: bytes of a queue kept in memory, largest alphabet of a level
    array: int = 256 << 20
    base: int = 2048
    #: names of a level that are ranked in memory instead of by another level
    direct: int = 1 << 19


def empty(n: int, plan: Plan) -> np.ndarray:
    if n * 4 <= plan.array:
        return np.empty(n, dtype=_KIND)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype=_KIND, mode="w+", shape=(n,))


class Queue:
    """A priority queue of (place, common prefix) by key, first in first out inside a key.

    How many entries each key will have is known beforehand, so every key has its own stretch of one array, in memory or on disk; what was
    popped stays there, so the stretches in order of keys are the result. Keys must be popped in rising order.
    """

    def __init__(self, sizes: np.ndarray, plan: Plan):
        self.begin = np.append(0, np.cumsum(sizes))
        self.head, self.tail = self.begin[:-1].copy(), self.begin[:-1].copy()
        self.places, self.prefixes = empty(int(self.begin[-1]), plan), empty(int(self.begin[-1]), plan)

    def push(self, keys: np.ndarray, places: np.ndarray, prefixes: np.ndarray | int) -> None:
        """Entries sorted by key."""
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        many, own = np.diff(np.append(first, len(keys))), keys[first]
        at = np.arange(len(keys)) + np.repeat(self.tail[own] - first, many)
        self.places[at], self.prefixes[at] = places, prefixes
        self.tail[own] += many

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries that wait under a key."""
        a, b = self.head[key], self.tail[key]
        self.head[key] = b
        return self.places[a:b], self.prefixes[a:b]


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of values[low..high], ends included, for many ranges."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=_KIND)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = level == k
        if own.any():
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
    return out


def _induced(
    keys: np.ndarray, wanted: np.ndarray, run: np.ndarray, places: np.ndarray, prefixes: np.ndarray | None, plan: Plan
) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes in order of ``keys``, induced from ``places`` (sorted, after the wanted ones of their key), with prefixes."""
    size = int(keys.max()) + 1
    sizes = np.bincount(keys[wanted], minlength=size)
    queue = Queue(sizes, plan)
    cut = np.searchsorted(keys[places], np.arange(size + 1))
    if size <= 1 << 16:
        keys = keys.astype(np.uint16)  # sorted by radix
    since = np.full(size, -1, dtype=_KIND)  # smallest prefix since a key's last entry; -1: none yet

    def pass_on(at: np.ndarray, prefix: np.ndarray | None) -> None:
        left = at - 1
        hit = np.flatnonzero((at > 0) & wanted[left])
        if prefix is None:
            if len(hit):
                key = keys[left[hit]]
                order = np.argsort(key, kind="stable")
                queue.push(key[order], left[hit][order], 0)
            return
        before = since.copy()
        np.minimum(since, prefix.min(), out=since)
        if not len(hit):
            return
        key = keys[left[hit]]
        order = np.argsort(key, kind="stable")
        key, hit = key[order], hit[order]
        first = np.append(True, key[1:] != key[:-1])
        low = np.where(first, 0, np.append(0, hit[:-1]) + 1)
        value = _least_between(prefix, low, hit)
        # before this block's first entry of a key: what came since its last one
        value[first] = np.minimum(value[first], before[key[first]])
        last = np.append(first[1:], True)
        after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], _FAR)
        since[key[last]] = after[hit[last] + 1]
        queue.push(key, left[hit], value + 1)

    for key in np.flatnonzero((sizes > 0) | (np.diff(cut) > 0)).tolist():
        latest = -1
        while True:
            at, prefix = queue.pop(key)
            if not len(at):
                break
            pass_on(at, None if prefixes is None else prefix)
            latest = int(at[-1])
        a, b = cut[key], cut[key + 1]
        if a < b and prefixes is None:
            pass_on(places[a:b], None)
        elif a < b:
            prefix = prefixes[a:b].copy()
            # two suffixes of one first character and different types differ where the shorter run ends
            prefix[0] = min(run[latest], run[places[a]]) if latest >= 0 else 0
            pass_on(places[a:b], prefix)
    return queue.places, queue.prefixes


def _both(text: np.ndarray, rising: np.ndarray, run: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray | None, plan: Plan):
    """Falling suffixes in order from the sorted seeds, then rising ones from those; each with prefixes."""
    falls, fall_common = _induced(text, ~rising, run, seeds, prefixes, plan)
    turned = text.max() - text
    back = None if prefixes is None else np.append(_KIND(0), fall_common[:0:-1])
    wanted = rising.copy()
    wanted[-1] = False  # the sentinel follows nothing
    rises, rise_common = _induced(turned, wanted, run, falls[::-1], back, plan)
    rises = np.append(rises, _KIND(len(text) - 1))[::-1]
    # prefixes of neighbours, read in the other direction
    rise_common = np.append(_KIND(0), np.append(rise_common, _KIND(0))[:0:-1])
    return falls, fall_common, rises, rise_common


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffix pairs that agree on ``known`` characters already, up to ``depth``."""
    out, n = np.minimum(known, depth), len(text)
    active = np.flatnonzero((out < depth) & (a != b))
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        active = active[(np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
        out[active] += 1
        active = active[out[active] < depth]
    return out


def _equal_neighbours(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each stretch equals the one before it."""
    same = np.zeros(len(first), dtype=bool)
    at = np.flatnonzero(length[1:] == length[:-1]) + 1
    block = 1 << 20
    for a in range(0, len(at), block):
        part = at[a : a + block]
        n = length[part]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        ok = text[np.repeat(first[part], n) + step] == text[np.repeat(first[part - 1], n) + step]
        same[part] = np.logical_and.reduceat(ok, begin)
    return same


def _doubled(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``suffix_array`` returns, for a text that fits in memory: ranks of stretches of 1, 2, 4, ... characters."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(_KIND)
    ranks, width = [rank], 1
    while int(rank.max()) + 1 < n:
        key = rank.astype(np.int64) * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, dtype=_KIND)
        rank[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
        ranks.append(rank)
        width *= 2
    order = np.empty(n, dtype=_KIND)
    order[rank] = np.arange(n, dtype=_KIND)
    common = np.zeros(n, dtype=_KIND)
    # the ends differ, so equal stretches lie inside the text
    for k in range(len(ranks) - 2, -1, -1):
        same = ranks[k][order[1:] + common[1:]] == ranks[k][order[:-1] + common[1:]]
        common[1:] += same.astype(_KIND) << k
    return order, np.minimum(common, depth)


def suffix_array(text: np.ndarray, depth: int = 1 << 30, plan: Plan = Plan()) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in order, common prefix of each with the one before it).

    ``text`` holds integers from 0 and must end with its only 0.
    """
    text, n = np.asarray(text, dtype=_KIND), len(text)
    if n >= 1 << 31:
        raise ValueError("a shard holds 2^31 characters at most")
    if n == 1:
        return np.zeros(1, dtype=_KIND), np.zeros(1, dtype=_KIND)
    step = np.append(np.diff(text), _KIND(1))
    at = np.arange(n, dtype=_KIND)
    change = np.where(step != 0, at, _KIND(n - 1))
    end = np.minimum.accumulate(change[::-1])[::-1]  # where the run of this character ends
    rising, run = step[end] > 0, end - at + 1
    del step, at, change, end
    seeds = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(_KIND)
    if len(seeds) > 1:
        ordered, prefixes = _seeds(text, rising, run, seeds, depth, plan)
    else:
        ordered, prefixes = seeds, np.zeros(1, dtype=np.int64)
    falls, fall_common, rises, rise_common = _both(text, rising, run, ordered, prefixes, plan)
    places, common = np.concatenate([falls, rises]), np.concatenate([fall_common, rise_common])
    del falls, rises, fall_common, rise_common
    key = text[places] * 2 + rising[places]
    order = np.argsort(key, kind="stable")
    places, common, key = places[order], common[order], key[order]
    turn = np.flatnonzero((key[1:] == key[:-1] + 1) & (key[:-1] % 2 == 0)) + 1
    common[turn] = np.minimum(run[places[turn]], run[places[turn - 1]])
    return places, np.minimum(common, depth)


def _seeds(
    text: np.ndarray, rising: np.ndarray, run: np.ndarray, seeds: np.ndarray, depth: int, plan: Plan
) -> tuple[np.ndarray, np.ndarray]:
    """The seed suffixes in order, with prefixes: by their stretches, and by recursion on the stretches' names."""
    start = seeds[np.argsort(text[seeds], kind="stable")]
    _, _, rises, _ = _both(text, rising, run, start, None, plan)
    is_seed = np.zeros(len(text), dtype=bool)
    is_seed[seeds] = True
    by_stretch = rises[is_seed[rises]]
    number = np.searchsorted(seeds, by_stretch)
    length = np.append(np.diff(seeds) + 1, 1)
    same = _equal_neighbours(text, by_stretch, length[number])
    name = np.cumsum(~same) - 1
    if not same.any():
        return by_stretch, _neighbours(text, by_stretch, np.zeros(len(seeds), dtype=np.int64), depth)
    names = np.empty(len(seeds), dtype=np.int64)
    names[number] = name
    if len(names) <= plan.direct:
        return _placed(text, seeds, *_doubled(names, depth), depth)
    most, digits = int(name[-1]), 1
    while plan.base**digits <= most:
        digits += 1
    if digits * len(seeds) >= len(text):
        digits = 1  # would not get shorter: one large alphabet then
    if digits > 1:
        # equal ranges for all digits: a small first digit would make every name a stretch of its own again
        base = 1
        while base**digits <= most:
            base += 1
        scale = base ** np.arange(digits - 1, -1, -1)
        inner = np.append((names[:-1, None] // scale % base + 1).ravel(), 0)
    else:
        inner = names
    order, common = suffix_array(inner, min(depth * digits, 1 << 30), plan)
    if digits > 1:
        whole = np.flatnonzero(order % digits == 0)
        common = np.minimum.reduceat(common, np.append(0, whole[:-1] + 1)) // digits
        order = order[whole] // digits
    return _placed(text, seeds, order, common, depth)


def _placed(text: np.ndarray, seeds: np.ndarray, order: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed suffixes in the order of their names, with common prefixes in characters."""
    ends = np.append(seeds, len(text))
    known = ends[np.minimum(order + common, len(seeds))] - seeds[order]
    return seeds[order], _neighbours(text, seeds[order], known, depth)


def _neighbours(text: np.ndarray, order: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(order), dtype=np.int64)
    out[1:] = _extended(text, order[1:], order[:-1], known[1:], depth)
    return out
