"""BagMinHash signatures of weighted sets.

The weights are whole numbers. An element's points are a Poisson process over time and weight,
taken apart as a hierarchy: the process over [0, 2^L) is split at its middle, its lower half
again, and so on down to [0, 1). The upper halves, [1, 2), [2, 4), [4, 8) ..., are independent
processes whose rate is their width, and those above the weight are never drawn. A point has an
arrival time, a component of the signature and a level, all from the hashes of element and
interval. In the one interval that the weight cuts, the level's binary digits are the choices of
its further splits, and points in the halves beyond the weight are dropped, half of the drawn
ones at most. A component of the signature is its earliest arrival, so two bags agree in a
component with a chance that is exactly their weighted Jaccard similarity (sum of minima over
sum of maxima of weights).

Points are drawn in order of arrival, up to a bound by the bag's whole weight. As soon as no
component is empty all later points lie beyond the current maximum, and the bag is done; others
go on a step further. So the work for a bag of n elements is about n + m ln m, whatever the weights.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.words import mix

COMPONENTS = 512
_SALT = np.uint64(0xA24BAED4963EE407)
_MOST_CELLS = 1 << 17
_MASK = (1 << 64) - 1


def bags(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, gram) with their counts, sorted; owners are ascending already."""
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return g[at], o[at], np.diff(np.append(at, len(g)))


def fingerprints(grams: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums a bag that equal bags share."""
    out = np.zeros((2, n), np.uint64)
    for k in range(2):
        np.add.at(out[k], owner, mix(mix(grams + np.uint64(k)) + counts.astype(np.uint64)))
    return out


def _nodes(grams: np.ndarray, owner: np.ndarray, counts: np.ndarray):
    """seed, owner, width, levels below the weight, of each interval that a weight reaches."""
    seeds, owners, widths, inside = [], [], [], []
    low, level = 0, 0
    while len(grams):
        width = max(1, low)
        seeds.append(mix(grams + np.uint64(level * int(_SALT) & _MASK)))
        owners.append(owner)
        widths.append(np.full(len(grams), width, np.int64))
        inside.append(np.minimum(counts - low, width))
        low += width
        level += 1
        more = counts > low
        grams, owner, counts = grams[more], owner[more], counts[more]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(seeds).astype(np.uint64), join(owners), join(widths), join(inside)


def signatures(grams: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """n x m arrival times (float64) for bags given as distinct (owner, gram) and counts; m is a
    power of 2. A bag without elements keeps infinite times."""
    out = np.full(n * m, np.inf)
    seeds, owners, widths, inside = _nodes(grams, owner, counts)
    if not len(seeds):
        return out.reshape(n, m)
    weight = np.bincount(owner, weights=counts, minlength=n)
    step = m / np.maximum(weight, 1) * 1.5
    bound = m / np.maximum(weight, 1) * np.log(m) + step
    reached = np.zeros(len(seeds))  # arrival of each node's latest point
    drawn = np.zeros(len(seeds), np.int64)  # points of each node so far
    todo = np.arange(len(seeds))
    while len(todo):
        while len(todo):
            expected = (bound[owners[todo]] - reached[todo]) * widths[todo]
            block = np.int64(2) ** np.ceil(np.log2(np.maximum(expected, 0) + 2)).astype(np.int64)
            going = []
            for size in np.unique(block):
                own = todo[block == size]
                for part in np.array_split(own, max(1, -(-len(own) * int(size) // _MOST_CELLS))):
                    going.append(_draw(out, m, part, int(size), seeds, owners, widths, inside, reached, drawn, bound))
            todo = np.concatenate(going)
        empty = np.isinf(out.reshape(n, m)).any(1) & (weight > 0)
        bound[empty] += step[empty]
        todo = np.flatnonzero(empty[owners])
    return out.reshape(n, m)


def _draw(out, m, nodes, size, seeds, owners, widths, inside, reached, drawn, bound) -> np.ndarray:
    """Draw points of the nodes until `size` more or past the bound; the nodes that need more.

    Arrivals are always summed from the first point on in the same order, so equal elements
    have bitwise equal arrivals in all bags."""
    if not len(nodes):
        return nodes
    seed, width = seeds[nodes], widths[nodes]
    h = mix(seed[:, None] + (drawn[nodes][:, None] + np.arange(1, size + 1)).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
    arrivals = np.add.accumulate(np.column_stack([reached[nodes], gaps]), axis=1)[:, 1:]
    counted = arrivals <= bound[owners[nodes]][:, None]
    more = counted[:, -1]
    n_counted = counted.sum(1)
    any_ = n_counted > 0
    # a node's state moves over the points that count; the next is drawn again if it goes on
    reached[nodes[any_]] = arrivals[any_, n_counted[any_] - 1]
    drawn[nodes] += n_counted
    part = np.flatnonzero(inside[nodes] < width)
    if len(part):
        level = (mix(h[part] ^ _SALT) >> np.uint64(8)) % width[part][:, None].astype(np.uint64)
        counted[part] &= level < inside[nodes[part]][:, None].astype(np.uint64)
    row, column = np.nonzero(counted)
    slot = owners[nodes[row]] * m + (h[row, column] & np.uint64(m - 1)).astype(np.int64)
    np.minimum.at(out, slot, arrivals[row, column])
    return nodes[more]


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """n x bands hashes of `rows` components each, with the band's number."""
    bits = np.ascontiguousarray(signature[:, : rows * bands]).view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


#: Buckets of a profile: about one for two shingles, within these.
FEWEST, MOST = 256, 1 << 14


def profiles(grams: np.ndarray, owner: np.ndarray, counts: np.ndarray, n: int) -> list[bytes]:
    """Of each bag how much weight falls into each bucket of the hashes, in a byte, and behind
    them, in 8 bytes, the sum of what goes beyond a byte."""
    weight = np.bincount(owner, weights=counts, minlength=n)
    bits = np.clip(np.ceil(np.log2(np.maximum(weight, 2) / 2)), np.log2(FEWEST), np.log2(MOST)).astype(np.int64)
    ends = np.cumsum(1 << bits)
    begin = ends - (1 << bits)
    slot = begin[owner] + (grams >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    held = np.bincount(slot, weights=counts, minlength=int(ends[-1]) if n else 0).astype(np.int64)
    low = np.minimum(held, 255).astype(np.uint8)
    over = np.add.reduceat(held - low, begin) if n else held
    return [low[a:b].tobytes() + int(x).to_bytes(8, "little") for a, b, x in zip(begin, ends, over, strict=True)]


class Profiles:
    """Profiles of many bags, to bound what they share with another one: never too low."""

    def __init__(self, raw: list[bytes]):
        self.fine = [np.frombuffer(x, np.uint8, len(x) - 8) for x in raw]
        self.over = np.array([int.from_bytes(x[-8:], "little") for x in raw], np.int64)
        self.coarse = np.array([folded(x, FEWEST) for x in self.fine])

    def most_shared(self, k: int, others: "Profiles", at: np.ndarray, enough: np.ndarray) -> np.ndarray:
        """An upper bound of the weight that bag k shares with each of the others `at`; where the
        coarse bound reaches `enough`, by finer buckets, if both have them."""
        more = np.minimum(self.over[k], others.over[at])
        out = np.minimum(self.coarse[k], others.coarse[at]).sum(1, dtype=np.int64) + more
        for i in np.flatnonzero(out >= enough):
            size = min(len(self.fine[k]), len(others.fine[at[i]]))
            if size > FEWEST:
                out[i] = np.minimum(folded(self.fine[k], size), folded(others.fine[at[i]], size)).sum(dtype=np.int64) + more[i]
        return out


def folded(profile: np.ndarray, size: int) -> np.ndarray:
    """The profile in fewer buckets."""
    return profile.reshape(size, -1).sum(1, dtype=np.uint16 if len(profile) // size < 257 else np.int64)
