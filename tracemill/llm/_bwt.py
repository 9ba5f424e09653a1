"""Strings of a given length that occur more than once in a few megabytes of text, from its Burrows-Wheeler transform.

Intervals of the suffix order are expanded breadth first by a character in front. An interval that is new to its right
end fixes the common prefix there: after round l, all common prefixes of length l are known, in increasing order. The
rounds stop at the minimum length; suffixes between which nothing is known by then share at least that much.
"""

from __future__ import annotations

import numpy as np

SEPARATOR, MARK = 0, 300


#: Texts of up to this many characters are sorted as packed numbers: two ranks and a position in 63 bits.
PACKED = 1 << 21


def _order_of(first: np.ndarray, then: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of (first, then), and where a new pair begins. bits: of ``then``."""
    n = len(first)
    key = first if then is None else first << np.uint64(bits) | then
    if n <= PACKED and (then is None or bits <= 21):
        packed = np.sort(key << np.uint64(21) | np.arange(n, dtype=np.uint64))
        order, ordered = (packed & np.uint64(PACKED - 1)).astype(np.int64), packed >> np.uint64(21)
    else:
        order = np.argsort(key)
        ordered = key[order]
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return order, new


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` characters at least, by doubling."""
    n = len(text)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text
    known = 4
    key = padded[:n] << np.uint64(27) | padded[1 : n + 1] << np.uint64(18) | padded[2 : n + 2] << np.uint64(9) | padded[3 : n + 3]
    order, new = _order_of(key, None, 0)
    bits = max(1, (n + 1).bit_length()) if n > PACKED else 21
    while known < depth and not new.all():
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new) - 1
        then = np.zeros(n, np.uint64)
        then[: n - known] = rank[known:]
        order, new = _order_of(rank, then, bits)
        known *= 2
    return order


def shared_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, split): the suffix order, and where two neighbours in it share less than ``length`` characters.

    Character 0 separates texts and is part of no string; a suffix with fewer than ``length`` characters before its
    separator may be left unsplit from its neighbour after it.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the first text follows the last separator
    sizes = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
    begin = np.cumsum(sizes) - sizes
    step = np.argsort(before, kind="stable")
    last = np.empty(n, np.int64)  # where the suffix with the character in front stands
    last[step] = np.arange(n)
    split = np.zeros(n + 1, bool)
    split[: sizes[SEPARATOR] + 1] = True
    split[n] = True
    chars = np.flatnonzero(sizes)
    chars = chars[chars != SEPARATOR]
    low, high = begin[chars], begin[chars] + sizes[chars]  # half open
    split[high] = True
    for _ in range(1, length):
        if not len(low):
            break
        width = high - low
        if len(low) and int(width.sum()) == 0:
            break
        which = np.repeat(np.arange(len(low)), width)
        at = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        real = before[at] != SEPARATOR
        at, which = at[real], which[real]
        to = last[at]
        if n <= 1 << 31:
            packed = np.sort(to.astype(np.uint64) << np.uint64(32) | np.arange(len(to), dtype=np.uint64))
            by = (packed & np.uint64((1 << 32) - 1)).astype(np.int64)
        else:
            by = np.argsort(to)
        to, which, char = to[by], which[by], before[at][by]
        if not len(to):
            break
        cut = np.flatnonzero((np.diff(to) != 1) | (np.diff(which) != 0) | (np.diff(char.astype(np.int64)) != 0)) + 1
        low, high = to[np.r_[0, cut]], to[np.r_[cut - 1, len(to) - 1]] + 1
        new = ~split[high]
        low, high = low[new], high[new]
        split[high] = True
    return order, split[:n]


def repeated_windows(bodies: list[bytes], place: np.ndarray, length: int, kind: np.ndarray | None = None, mark: np.ndarray | None = None) -> list[np.ndarray]:
    """For each body the offsets at which a string of ``length`` characters begins that also begins elsewhere.

    place: for each body a number, such that offset o of a body is the place place + o; one place may occur in two
    bodies, and does not count as elsewhere. kind: strings of bodies of different kinds are different strings.
    mark: for each body an offset at which one more character stands, which no byte equals; ``length`` counts it.
    """
    extra = 0 if mark is None else 1
    sizes = np.array([len(b) for b in bodies]) + extra
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(bodies), np.uint16)
    for n, (at, body) in enumerate(zip(begin.tolist(), bodies, strict=True)):
        cut = len(body) if mark is None else int(mark[n])
        raw = np.frombuffer(body, np.uint8)
        text[at : at + cut] = raw[:cut]
        text[at + cut + extra : at + extra + len(body)] = raw[cut:]
        text[at : at + len(body) + extra] += 1
    if mark is not None:
        text[begin + mark] = MARK
    order, split = shared_prefixes(text, length)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)[order]
    offset = order - begin[owner]
    group = np.cumsum(split) - 1
    whole = np.flatnonzero(sizes[owner] - offset >= length)
    owner, offset, group = owner[whole], offset[whole], group[whole]
    if kind is not None:
        _, group = np.unique(group << 32 | kind[owner], return_inverse=True)
    where = place[owner] + offset
    least, most = np.full(group.max(initial=0) + 1, np.iinfo(np.int64).max), np.full(group.max(initial=0) + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, group, where)
    np.maximum.at(most, group, where)
    found = least[group] < most[group]
    owner, offset = owner[found], offset[found]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    return np.split(offset, np.searchsorted(owner, np.arange(1, len(bodies))))
