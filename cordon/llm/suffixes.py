"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of text."""

from __future__ import annotations

import numpy as np

SMALL = 1024  # alphabets up to this are induced a whole bucket at a time, larger ones symbol by symbol


def kinds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and where leftmost smaller ones start."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(differs, np.arange(n - 1))
    smaller = np.ones(n, bool)
    smaller[:-1] = t[differs[at]] < t[differs[at] + 1]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induced(t: np.ndarray, k: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order induced from ``seeds`` (leftmost smaller suffixes in order): larger suffixes from the left, then
    smaller ones from the right. A bucket is induced from as one block, again while it adds to itself."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    heads = tails - counts
    out = np.full(n, -1, np.int64)
    kind = np.uint16 if k <= SMALL else np.int64
    by = seeds[np.argsort(t[seeds].astype(kind), kind="stable")]
    n_seeds = np.bincount(t[seeds], minlength=k)
    firsts = np.cumsum(n_seeds) - n_seeds
    out[(tails - n_seeds)[t[by]] + np.arange(len(by)) - firsts[t[by]]] = by
    put = heads.copy()

    def left(block: np.ndarray) -> None:
        j = block[block > 0] - 1
        j = j[~smaller[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c.astype(kind), kind="stable")
            j, c, added = j[order], c[order], np.bincount(c, minlength=k)
            out[put[c] + np.arange(len(j)) - (np.cumsum(added) - added)[c]] = j
            put[:] += added

    for c in np.flatnonzero(counts):
        lo = heads[c]
        while lo < put[c]:
            lo, block = put[c], out[lo : put[c]]
            left(block)
        left(out[tails[c] - n_seeds[c] : tails[c]])
    ends, put = put, tails.copy()

    def right(block: np.ndarray) -> None:
        j = block[block > 0] - 1
        j = j[smaller[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c.astype(kind), kind="stable")
            j, c, added = j[order], c[order], np.bincount(c, minlength=k)
            out[put[c] - 1 - np.arange(len(j)) + (np.cumsum(added) - added)[c]] = j
            put[:] -= added

    for c in np.flatnonzero(counts)[::-1]:
        hi = tails[c]
        while put[c] < hi:
            hi, block = put[c], out[put[c] : hi][::-1]
            right(block)
        right(out[heads[c] : ends[c]][::-1])
    out[0] = n - 1
    return out


def induced_singly(t: np.ndarray, k: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same for a large alphabet, whose buckets hold a suffix or two each."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    tails = np.cumsum(counts)
    text, small, out = t.tolist(), smaller.tolist(), [-1] * n
    put = tails.tolist()
    for j in seeds[::-1].tolist():
        c = text[j]
        put[c] -= 1
        out[put[c]] = j
    put = (tails - counts).tolist()
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not small[j]:
            c = text[j]
            out[put[c]] = j
            put[c] += 1
    put = tails.tolist()
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and small[j]:
            c = text[j]
            put[c] -= 1
            out[put[c]] = j
    out[0] = n - 1
    return np.array(out, np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` (whole numbers below ``k``, ending in its only 0) in order."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    smaller, starts = kinds(t)
    induce = induced if k <= SMALL else induced_singly
    first = np.zeros(len(t), bool)
    first[starts] = True
    rough = induce(t, k, smaller, starts)
    rough = rough[first[rough]]  # leftmost smaller substrings in order
    end = np.full(len(t), len(t), np.int64)
    end[starts[:-1]] = starts[1:] + 1
    wide = t.astype(np.uint16 if k <= SMALL else np.uint32)
    body, size = wide.tobytes(), wide.itemsize
    names, name, last = np.zeros(len(t), np.int64), -1, None
    spots = list(zip((rough * size).tolist(), (end[rough] * size).tolist(), strict=True))
    given = []
    for lo, hi in spots:
        piece = body[lo:hi]
        if piece != last:
            name, last = name + 1, piece
        given.append(name)
    names[rough] = given
    if name + 1 < len(starts):
        rough = starts[suffix_array(names[starts], name + 1)]
    return induce(t, k, smaller, rough)


def common_prefixes(body: bytes, order: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, before, length) by start, of the suffixes in ``order``: the one before it in order, and how far both
    agree, up to ``enough``. A prefix loses at most one byte from a start to the next, if both next ones are there."""
    there = np.zeros(len(body) + 1, bool)
    there[order] = True
    sequence = np.argsort(order[1:])
    starts, before = order[1:][sequence], order[:-1][sequence]
    carried = np.zeros(len(starts), bool)
    carried[1:] = (starts[1:] == starts[:-1] + 1) & there[before[:-1] + 1]
    lengths, length = [], 0
    for p, q, on in zip(starts.tolist(), before.tolist(), carried.tolist(), strict=True):
        length = length - 1 if on and length else 0
        if length < enough and body[p + length : p + enough] == body[q + length : q + enough]:
            length = enough
        while length + 32 <= enough and body[p + length : p + length + 32] == body[q + length : q + length + 32]:
            length += 32
        while length < enough and body[p + length] == body[q + length]:
            length += 1
        lengths.append(length)
    return starts, before, np.array(lengths, np.int64)


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece, the starts of its ``length``-byte strings that also start elsewhere in the pieces."""
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces], np.int64)
    body = b"\x00".join(pieces) + b"\x00"
    at = np.cumsum(sizes + 1) - sizes - 1
    t = np.frombuffer(body, np.uint8).astype(np.int64) + 2
    t[at + sizes] = 1
    order = suffix_array(np.append(t, 0), 258)[1:]
    room = np.repeat(at + sizes, sizes + 1) - np.arange(len(body))
    order = order[room[order] >= length]  # suffixes that agree in ``length`` bytes have no shorter ones between them
    start, before, common = common_prefixes(body, order, length)
    same = common >= length
    found = np.zeros(len(body), bool)
    found[start[same]] = True
    found[before[same]] = True
    return [np.flatnonzero(found[a : a + n]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
