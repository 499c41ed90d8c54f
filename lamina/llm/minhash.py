"""Near-duplicate sets: the sets themselves verify every link. MinHash bands could find candidates; the pipeline takes SimHash's.

Two sets of Jaccard similarity s share the least hash under a random order with probability s, whatever their sizes,
so all ``ROWS`` of one of ``BANDS`` bands agree with probability 1 - (1 - s ** ROWS) ** BANDS.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Least hashes of a band, and bands: a pair at exactly 0.8 shares none with a probability of 1.3e-7.
ROWS, BANDS = 5, 40
#: Near-duplicates have ``PART`` / ``OF`` of their union in common, or more.
PART, OF = 4, 5
#: Hashes that are put in all orders at once.
CHUNK = 1024
ORDERS = np.random.default_rng(5).integers(0, 2**64, ROWS * BANDS, U) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes, different for different bands; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(ORDERS), 2**64 - 1, U)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK, None] * ORDERS).min(0))
    key = np.arange(1, BANDS + 1, dtype=U)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * U(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, each hash once, are near-duplicates."""
    return (PART + OF) * len(np.intersect1d(a, b, assume_unique=True)) >= PART * (len(a) + len(b))


def verified(keys: list, sets: list[np.ndarray]) -> list[tuple]:
    """Pairs of ``keys`` that join exactly what all pairs of similar sets join; each has been checked on the two whole sets.

    ``sets`` hold each hash once and aren't empty. Every pair is checked, except where the sizes alone rule it
    out or links found before already join the two.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    distinct, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    own, mark, group = [flat[a:b] for a, b in zip(starts, starts[1:])], np.zeros(len(distinct), np.int64), np.arange(len(order))
    out = []
    for u in range(len(order)):
        end = int(np.searchsorted(sizes, sizes[u] * OF // PART, side="right"))
        others = u + 1 + np.flatnonzero(group[u + 1 : end] != group[u])
        if not len(others):
            continue
        mark[own[u]] = 1
        at = np.r_[0, np.cumsum(sizes[others])[:-1]]
        tokens = flat[starts[u + 1] : starts[end]] if len(others) == end - u - 1 else np.concatenate([own[v] for v in others])
        shared = np.add.reduceat(mark[tokens], at)
        mark[own[u]] = 0
        linked = others[(PART + OF) * shared >= PART * (sizes[u] + sizes[others])]
        if len(linked):
            group[np.isin(group, group[linked])] = group[u]
            out += [(keys[order[u]], keys[order[v]]) for v in linked]
    return out
