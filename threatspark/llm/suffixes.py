"""Front-coded sorted suffix runs and their merge by an LCP loser tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


def common(x: bytes, y: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, the first ``at`` bytes known to agree."""
    most = min(len(x), len(y))
    step = 64
    while at < most:
        a, b = x[at:at + step], y[at:at + step]
        if a == b[:len(a)] and len(a) == len(b):
            at += step
            continue
        n = min(len(a), len(b))
        diff = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return at + (n if not diff else n - 1 - (diff.bit_length() - 1) // 8)
    return most


def front_code(ordered: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix lengths, tail lengths, tails) of sorted strings; lengths as 32-bit integers."""
    lcp, size, tails, last = [], [], [], b""
    for s in ordered:
        n = common(last, s)
        lcp.append(n)
        tails.append(s[n:])
        size.append(len(s) - n)
        last = s
    return np.array(lcp, "<u4").tobytes(), np.array(size, "<u4").tobytes(), b"".join(tails)


def decoded(lcp: bytes, size: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, string) of a front-coded run."""
    last, at = b"", 0
    for n, m in zip(np.frombuffer(lcp, "<u4").tolist(), np.frombuffer(size, "<u4").tolist(), strict=True):
        last = last[:n] + tails[at:at + m]
        at += m
        yield n, last


def merged(runs: list[Iterable[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Merge sorted runs of (common prefix with the one before, string, payload).

    Yields the same triple in the order of all. Every head knows its common
    prefix with the last string that left the tree: the head with the longer one is
    smaller, and only when two are equal are bytes compared, from there on. So no
    prefix that is known to agree is compared again.
    """
    its = [iter(r) for r in runs]
    size = 1
    while size < len(its):
        size *= 2
    head: list = [next(it, None) for it in its] + [None] * (size - len(its))
    known = [0] * size
    loser = [0] * size

    def match(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's common prefix with the winner."""
        if head[i] is None:
            return j, i
        if head[j] is None or known[i] > known[j]:
            return i, j
        if known[j] > known[i]:
            return j, i
        x, y = head[i][1], head[j][1]
        n = common(x, y, known[i])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            if n == len(x) == len(y) and j < i:
                known[i] = n
                return j, i
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    winner = list(range(size))
    width, level = size, winner
    while width > 1:
        width //= 2
        up = []
        for k in range(width):
            w, lost = match(level[2 * k], level[2 * k + 1])
            loser[width + k] = lost
            up.append(w)
        level = up
    w = level[0]
    while head[w] is not None:
        yield known[w], head[w][1], head[w][2]
        head[w] = next(its[w], None)
        if head[w] is not None:
            known[w] = head[w][0]
        node = (w + size) // 2
        while node:
            w, loser[node] = match(w, loser[node])
            node //= 2
