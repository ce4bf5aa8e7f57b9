"""Word shingles: their hashes, minhash bands that propose pairs, and the exact Jaccard similarity of whole sets."""

from __future__ import annotations

import numpy as np

#: Keys of a set: BANDS of ROWS least values each. A pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8.
BANDS, ROWS = 15, 4
#: Words that are hashed at once.
BLOCK = 1 << 15
_RNG = np.random.default_rng(11)
_A, _B = _RNG.integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_A = _A | np.uint32(1)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def _words(text: str | None) -> list[bytes]:
    """A-Z are lowered, words stand between the six ASCII characters of white space; as bytes, nothing else is touched."""
    return (text or "").encode("utf-8").lower().split()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words in order, repeats included; a text of fewer words is one shingle, without words none.

    A shingle's words are joined by one blank.
    """
    import xxhash

    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([one(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.array([one(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self):
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE, np.uint64)), dtype=np.uint64)
                self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        return self.up, self.down


_powers = Powers()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: polynomials over random values of the bytes, from running sums.

    A text of fewer words than ``width`` is one shingle; without words there are none. Long texts are hashed block by block.
    """
    words = _words(text)
    found = []
    for i in range(0, max(1, len(words) - width + 1) if words else 0, BLOCK):
        part = words[i : i + BLOCK + width - 1]
        joined = np.frombuffer(b" ".join(part), np.uint8)
        up, down = _powers(len(joined) + 1)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
        gaps = np.flatnonzero(joined == 32)
        if len(part) <= width:
            first, end = np.zeros(1, int), np.array([len(joined)])
        else:
            first, end = np.r_[0, gaps[: len(part) - width] + 1], np.r_[gaps[width - 1 :], len(joined)]
        h = (sums[end] - sums[first]) * down[first]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        found.append(h ^ (h >> np.uint64(29)))
    if not found:
        return np.empty(0, np.uint64)
    every = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
    return every[np.r_[True, every[1:] != every[:-1]]]


def digest(shingles: np.ndarray, seed: int = 7) -> int:
    """One long for a set of hashes; 0 is that of texts without words alone."""
    import xxhash

    if not len(shingles):
        return 0
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed) or 1).view(np.int64)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One long for each band of a set's minhash signature."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        low = np.minimum(low, (_A * short[i : i + 1024] + _B).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)  # a band's number is in its key
    for r in range(ROWS):
        key = (key ^ low[r::ROWS]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar(sets: list[np.ndarray], least: float, asking: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links of sets of a Jaccard similarity of ``least`` or more.

    Without ``asking`` they join the sets as all such pairs would: from each set that has been reached, one pass over
    all that have not gives the sizes of its intersections with them. With it, only those sets ask, and a link goes
    to one set of each other ``label`` that they are similar to.
    """
    size = np.array([len(s) for s in sets])
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(terms) and int(terms.max()) + 1, np.int32)
    a: list[int] = []
    b: list[int] = []

    def like(pivot: int, others: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        own = terms[first[pivot] : first[pivot + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], begins)
        mark[own] = 0
        return common >= least * (size[pivot] + size[others] - common)

    def gather(others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[others]
        begins = np.r_[0, np.cumsum(n)[:-1]]
        return terms[np.arange(n.sum()) + np.repeat(first[others] - begins, n)], begins

    if asking is not None:
        everyone = np.arange(len(sets))
        flat, begins = gather(everyone)
        for pivot in np.flatnonzero(asking).tolist():
            hit = np.flatnonzero(like(pivot, everyone, flat, begins) & (label != label[pivot]))
            some = hit[np.unique(label[hit], return_index=True)[1]]
            a += [pivot] * len(some)
            b += some.tolist()
        return a, b
    left = np.arange(1, len(sets))
    flat, begins = gather(left) if len(left) else (np.empty(0, int), np.empty(0, int))
    reached = [0]
    while len(left):
        pivot = reached.pop()
        hit = like(pivot, left, flat, begins)
        if hit.any():
            found = left[hit].tolist()
            a += [pivot] * len(found)
            b += found
            reached += found
            left = left[~hit]
            if len(left):
                flat, begins = gather(left)
        if not reached and len(left):
            reached, left = [int(left[0])], left[1:]
            if len(left):
                flat, begins = gather(left)
    return a, b
