"""Line diffs between versions: a longest common subsequence under a size cap.

Operations are (op, n, lines): S keeps n lines, X drops n lines, I inserts lines. The table of
lengths is filled by vectors along anti-diagonals, so Python runs once for each diagonal.
"""

from __future__ import annotations

import numpy as np

from . import costs

Op = tuple[str, int, list[str]]


def too_large(old: list[str], new: list[str]) -> bool:
    return (len(old) + 1) * (len(new) + 1) > costs.DIFF_CELLS


def _suffix_lengths(old: list[str], new: list[str]) -> np.ndarray:
    """dp[i, j]: common length of old[i:] and new[j:]."""
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(x, len(codes)) for x in old], dtype=np.int64)
    b = np.array([codes.setdefault(x, len(codes)) for x in new], dtype=np.int64)
    n, m = len(a), len(b)
    dp = np.zeros((n + 1, m + 1), dtype=np.int32)
    for d in range(n + m - 2, -1, -1):
        i = np.arange(max(0, d - m + 1), min(n - 1, d) + 1)
        j = d - i
        dp[i, j] = np.where(a[i] == b[j], dp[i + 1, j + 1] + 1, np.maximum(dp[i + 1, j], dp[i, j + 1]))
    return dp


def diff(old: list[str], new: list[str]) -> list[Op]:
    dp = _suffix_lengths(old, new)
    ops: list[Op] = []

    def add(op: str, line: str | None = None):
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + 1, ops[-1][2] + ([line] if line is not None else []))
        else:
            ops.append((op, 1, [line] if line is not None else []))

    i = j = 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            add("S")
            i, j = i + 1, j + 1
        elif i < len(old) and (j == len(new) or dp[i + 1, j] >= dp[i, j + 1]):
            add("X")
            i += 1
        else:
            add("I", new[j])
            j += 1
    return ops


def apply(old: list[str], ops: list[Op]) -> list[str]:
    out, at = [], 0
    for op, n, lines in ops:
        if op == "S":
            out += old[at : at + n]
            at += n
        elif op == "X":
            at += n
        else:
            out += lines
    return out


def diff_bytes(ops: list[Op]) -> int:
    """Size of a diff view: its reference, and each operation with its lines."""
    total = costs.DIFF
    for op, n, lines in ops:
        total += 1 + costs.number(costs.SAME if op == "S" else costs.DELETE, n)
        total += sum(1 + len(x.encode("utf-8", "surrogatepass")) for x in lines)
    return total
