"""Suffix arrays of many word sequences at once, by prefix doubling in flat arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Suffixes(NamedTuple):
    """Suffix array of several word sequences, one after the other."""

    order: np.ndarray            # positions, by group, then in the order of their suffixes
    common: np.ndarray           # words that a suffix shares with the one before it in ``order``; 0 at a group's first
    ranks: list[np.ndarray]      # ranks by the first 1, 2, 4, ... words: equal for equal runs of one group


def suffix_array(ids: np.ndarray, first: np.ndarray, group: np.ndarray | None = None, depth: int | None = None) -> Suffixes:
    """Of sequences ``ids[first[d]:first[d + 1]]``; suffixes end with their sequence, and only those of one group are compared.

    ``group``: an ascending number for each sequence (none: each is a group of its own).  ``depth``: words up to
    which the order and common lengths must be right (none: all).
    """
    n = len(ids)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)) if group is None else group, size)
    end = np.repeat(first[1:], size)
    depth = int(size.max(initial=0)) if depth is None else depth
    key = owner * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    opens = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[:n])
    many = np.diff(np.append(opens, n))
    rank[order] = np.repeat(opens, many)                       # a rank is the first place of its group
    active = order[np.repeat(many > 1, many)]                  # sorted by rank
    ranks, step = [rank], 1
    while len(active) and step < depth:
        old = rank[active].astype(np.int64)
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)].astype(np.int64), -1)
        by = np.argsort(old * (n + 1) + second + 1, kind="stable")
        active, old, second = active[by], old[by], second[by]
        opens = np.append(True, old[1:] != old[:-1])
        fresh = opens | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(active))
        before = np.maximum.accumulate(np.where(opens, at, 0))
        inside = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[active] = old + inside - before
        ranks.append(rank)
        many = np.diff(np.append(np.flatnonzero(fresh), len(active)))
        active = active[np.repeat(many > 1, many)]
        step *= 2
    order = np.argsort(rank, kind="stable")
    return Suffixes(order, _common(order, owner, end, ranks), ranks)


def _common(order: np.ndarray, owner: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common-prefix lengths of neighbours, from the ranks by powers of two, longest first."""
    out = np.zeros(len(order), np.int64)
    here = np.flatnonzero(owner[order[1:]] == owner[order[:-1]]) + 1
    p, q = order[here - 1].copy(), order[here].copy()
    stop_p, stop_q = end[p], end[q]
    room = np.minimum(stop_p - p, stop_q - q)
    for level in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero((p < stop_p) & (q < stop_q))
        same = live[ranks[level][p[live]] == ranks[level][q[live]]]
        out[here[same]] += 1 << level
        p[same] += 1 << level
        q[same] += 1 << level
    out[here] = np.minimum(out[here], room)                    # equal suffixes end together
    return out
