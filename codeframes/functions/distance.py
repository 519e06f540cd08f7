"""Edit distances of many pairs of texts at once, and an index of texts that finds those within a share of edits.

Distances are bit-parallel: a bit vector holds the differences down one column of the table of distances, and a step
along the other text takes a few operations on whole vectors.  Pairs whose shorter text has the same number of 64-bit
blocks advance together in numpy, a block's carry going to the next; long patterns take a vector as one whole
number.  Characters are code points.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Pairs whose shorter text has at most so many blocks advance together; longer ones alone.
BLOCKS = 8
#: Bytes of one group's table of positions by character.
TABLE_BYTES = 16 << 20
_ONE = np.uint64(1)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The shorter and the longer text without what both begin and end with."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    return a[i : n - j], b[i : len(b) - j]


def _alone(pattern: str, text: str, most: int) -> int:
    """The distance of one pair; -1 if it is above ``most``."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    score, mask, last = len(pattern), (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down = mask, 0
    for left, c in zip(range(len(text) - 1, -1, -1), text, strict=True):
        same = where.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (mask & ~(across | up)), up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        if score - left > most:
            return -1
        rise, fall = (rise << 1 | 1) & mask, (fall << 1) & mask
        up, down = fall | (mask & ~(vertical | rise)), rise & vertical
    return score if score <= most else -1


def _together(patterns: list[str], texts: list[str], blocks: int) -> np.ndarray:
    """The distances of pairs whose patterns have ``blocks`` blocks, texts by falling length."""
    n, sizes = len(patterns), np.fromiter(map(len, patterns), np.int64, len(patterns))
    lengths = np.fromiter(map(len, texts), np.int64, n)
    points = lambda ts: np.frombuffer("".join(ts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat, other = points(patterns), points(texts)
    letters, code = np.unique(flat, return_inverse=True)
    # where each character stands in each pattern; the last row is that of all other characters
    table = np.zeros((len(letters) + 1, blocks, n), np.uint64)
    pair, at = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    np.bitwise_or.at(table, (code, at // 64, pair), _ONE << (at % 64).astype(np.uint64))
    place = np.minimum(np.searchsorted(letters, other), len(letters) - 1)
    place[letters[place] != other] = len(letters)
    steps = np.full((int(lengths.max()), n), len(letters))
    pair_of = np.repeat(np.arange(n), lengths)
    steps[np.arange(len(other)) - np.repeat(np.cumsum(lengths) - lengths, lengths), pair_of] = place
    score, last = sizes.copy(), ((sizes - 1) % 64).astype(np.uint64)
    up, down = np.full((blocks, n), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((blocks, n), np.uint64)
    top = np.uint64(63)
    alive = np.searchsorted(-lengths, -np.arange(len(steps)), "left")
    every = np.arange(n)
    for j, k in enumerate(alive.tolist()):
        seen = table[steps[j, :k], :, every[:k]]
        rise_in, fall_in = np.full(k, _ONE), np.zeros(k, np.uint64)
        for w in range(blocks):
            p, m, same = up[w, :k], down[w, :k], seen[:, w]
            vertical = same | m
            same = same | fall_in
            across = (((same & p) + p) ^ p) | same
            rise, fall = m | ~(across | p), p & across
            if w == blocks - 1:
                score[:k] += ((rise >> last[:k]) & _ONE).astype(np.int64) - ((fall >> last[:k]) & _ONE).astype(np.int64)
            rise_out, fall_out = rise >> top, fall >> top
            rise, fall = (rise << _ONE) | rise_in, (fall << _ONE) | fall_in
            up[w, :k], down[w, :k] = fall | ~(vertical | rise), rise & vertical
            rise_in, fall_in = rise_out, fall_out
    return score


def distances(a: list[str], b: list[str], most: list[int] | None = None) -> np.ndarray:
    """The edit distance of each pair; -1 where it is above the pair's ``most``."""
    out = np.full(len(a), -1, np.int64)
    groups: dict[int, list[tuple[str, str, int]]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        limit = max(len(x), len(y)) if most is None else most[i]
        if abs(len(x) - len(y)) > limit:
            continue
        x, y = _trimmed(x, y)
        if not x:
            out[i] = len(y) if len(y) <= limit else -1
            continue
        groups.setdefault(-(-len(x) // 64), []).append((x, y, i))
    for blocks, pairs in groups.items():
        if blocks > BLOCKS or len(pairs) < 8:
            for x, y, i in pairs:
                out[i] = _alone(x, y, len(y) if most is None else most[i])
            continue
        pairs.sort(key=lambda p: -len(p[1]))
        step = max(8, TABLE_BYTES // (8 * blocks * 128))
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            found = _together([p[0] for p in some], [p[1] for p in some], blocks)
            at = np.array([p[2] for p in some])
            out[at] = found if most is None else np.where(found <= np.array([most[i] for i in at]), found, -1)
    return out


def most_edits(longest: int, threshold: float) -> int:
    """The most edits that two texts of that greater length may have to reach the threshold."""
    return min(longest, int((1 - threshold) * longest + 1e-9))


def segments(length: int, threshold: float) -> tuple[int, list[tuple[int, int]]]:
    """How many segments of a text of that length a similar text must hold unchanged, and their (start, size).

    Each edit changes one segment at most, so of ``k + need`` segments ``need`` are left by ``k`` edits, the most that any
    text similar to this one can be away.  Texts too short for that many have none: (0, [])."""
    k = most_edits(int(length / threshold + 1e-9), threshold) if threshold > 0 else length
    need = 1 + k // 4
    count = k + need
    if count > length // 2 and not (k == 0 and length):
        return 0, []
    size, longer = divmod(length, count)
    starts, at = [], 0
    for i in range(count):
        n = size + (i < longer)
        starts.append((at, n))
        at += n
    return need, starts


class SeedIndex:
    """Texts in the order in which they came; ``first`` finds the earliest that is similar to a text.

    A text's windows are looked up among the segments of all seeds.  Seeds of a fitting length that share enough segments
    near their own place are measured, earliest first; no other seed can be similar."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.seeds: list[str] = []
        self.number: dict[str, int] = {}
        self.where: dict[str, array] = {}
        self.sizes: dict[int, int] = {}
        self.short = array("q")
        self.lengths, self.shift, self.need = array("q"), array("q"), array("q")
        self.measured = 0

    def add(self, text: str) -> int:
        k = len(self.seeds)
        self.seeds.append(text)
        self.number.setdefault(text, k)
        need, parts = segments(len(text), self.threshold)
        self.lengths.append(len(text))
        self.need.append(need)
        self.shift.append(most_edits(int(len(text) / self.threshold + 1e-9), self.threshold) if self.threshold > 0 else len(text))
        if not parts:
            self.short.append(k)
        for start, size in parts:
            self.where.setdefault(text[start : start + size], array("q")).append(k << 32 | start)
            self.sizes[size] = self.sizes.get(size, 0) + 1
        return k

    def _near(self, text: str) -> np.ndarray:
        """Seeds that can be similar, by number."""
        found, starts = [], []
        for size in self.sizes:
            for i in range(len(text) - size + 1):
                hit = self.where.get(text[i : i + size])
                if hit is not None:
                    found.append(np.array(hit, np.int64))
                    starts.append(np.full(len(hit), i))
        near = np.array(self.short, np.int64)
        lengths = np.frombuffer(self.lengths, np.int64)
        if found:
            held, at = np.concatenate(found), np.concatenate(starts)
            seed = held >> 32
            held = np.unique(held[np.abs((held & 0xFFFFFFFF) - at) <= np.frombuffer(self.shift, np.int64)[seed]])
            seed, count = np.unique(held >> 32, return_counts=True)
            near = np.union1d(near, seed[count >= np.frombuffer(self.need, np.int64)[seed]])
        n = len(text)
        shorter, longer = np.minimum(lengths[near], n), np.maximum(lengths[near], n)
        return near[shorter + 1e-9 >= self.threshold * longer]

    def first(self, text: str) -> int | None:
        exact = self.number.get(text)
        if not self.seeds:
            return None
        near = self._near(text)
        if exact is not None:
            near = near[near < exact]
        for i in range(0, len(near), 256):
            some = near[i : i + 256]
            longest = np.maximum(np.frombuffer(self.lengths, np.int64)[some], len(text)).tolist()
            self.measured += len(some)
            found = distances([text] * len(some), [self.seeds[k] for k in some.tolist()], [most_edits(m, self.threshold) + 1 for m in longest])
            for k, d, m in zip(some.tolist(), found.tolist(), longest, strict=True):
                if not m or (d >= 0 and 1.0 - d / m >= self.threshold):
                    return k
        return exact
