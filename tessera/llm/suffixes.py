"""Numpy kernels of exact substring search: content anchors of windows, and blockwise suffix sorting by a difference cover.

Anchors. A window of ``length`` bytes is anchored at the leftmost of its byte grams with the least hash, so equal windows
have equal anchors at equal distances, wherever they stand. Consecutive windows with one anchor form a run; its bytes are
its segment. Whatever equals a window therefore lies in a segment of the same anchor class.

Suffix sorting. The classes of a task are laid out as one string. A difference cover D modulo PERIOD holds for any two
places i and j a distance d < PERIOD with i + d and j + d both in the sample (places in D modulo PERIOD). Ranks of the
sample by ``length`` bytes come first, by doubling from PERIOD bytes on (a sample place plus PERIOD is a sample place). Then
one bucket of suffixes at a time is gathered and sorted by PERIOD bytes, and ties are resolved by ranks at that distance:
nothing is compared further, however long the repeats, and only one bucket's suffixes are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: A perfect difference set: every distance modulo 13 is the difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text handled at a time.
BLOCK = 1 << 19
#: Suffixes in a bucket, about.
BUCKET = 1 << 17
PLACE = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Windows:
    """Fingerprints of all windows of ``length`` bytes, modulo 2**64 over random values of bytes."""

    length: int = 200
    seed: int = 1

    @property
    def gram(self) -> int:
        return max(1, self.length * 8 // 25)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return tuple(rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    @cached_property
    def powers(self) -> tuple[np.ndarray, np.ndarray]:
        base = 0x9E3779B97F4A7C15
        size = BLOCK + 2 * self.length
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = b
            both.append(np.multiply.accumulate(p))
        return tuple(both)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.tables[which][data] * self.powers[0][: len(data)], out=total[1:])
        return total

    def anchors(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows in pieces that end at ``ends`` and stand side by side in ``data``.

        First window, windows, the first's distance before its anchor (counted from the largest one), class, segment's print.
        """
        count = len(data) - self.length + 1
        none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        if count <= 0:
            return none
        total = self.sums(data, 0)
        grams = len(data) - self.gram + 1
        hashes = _mixed((total[self.gram :] - total[:grams]) * self.powers[1][:grams])
        width = self.length - self.gram + 1
        packed = (hashes & ~PLACE) | np.arange(grams, dtype=np.uint64)
        full = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        full[:grams] = packed
        grid = full.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & PLACE).astype(np.int64)
        whole = np.zeros(len(data) + 1, dtype=np.int8)  # windows that lie in one piece
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts >= self.length
        np.add.at(whole, starts[long], 1)
        np.add.at(whole, ends[long] - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(whole[:count]))
        if not len(at):
            return none
        place = place[at]
        new = np.concatenate([[True], place[1:] != place[:-1]])
        first = at[new]
        windows = np.diff(np.append(np.flatnonzero(new), len(at)))
        other = self.sums(data, 1)
        segment = (other[first + windows - 1 + self.length] - other[first]) * self.powers[1][first]
        return first, windows, first - place[new] + width - 1, hashes[place[new]], _mixed(segment + windows.astype(np.uint64))

    def blocks(self, data: np.ndarray, grid: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
        """A segment's windows in blocks of ``width`` by their distance to the anchor, the first window's being ``grid``.

        First window, windows, the first's distance, print of the bytes that all windows of a whole block share, print of the
        block's bytes. Equal windows have equal distances, so the blocks that they are in share those bytes, cut off or not.
        """
        count = len(data) - self.length + 1
        one, two = self.sums(data, 0), self.sums(data, 1)
        edge = np.arange(grid // width, (grid + count - 1) // width + 1) * width - grid
        begin, end = np.maximum(edge, 0), np.minimum(edge + width, count)
        low, high = edge + width - 1, edge + self.length
        shared = _mixed((one[high] - one[low]) * self.powers[1][low]).view(np.int64)
        own = _mixed((two[end - 1 + self.length] - two[begin]) * self.powers[1][begin] + (end - begin).astype(np.uint64)).view(np.int64)
        return zip(*(c.tolist() for c in (begin, end - begin, grid + begin, shared, own)))

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, first window, windows, distance, class and segment's print of the runs in texts that stand side by side, some texts at a time.

        A text beyond BLOCK bytes is taken in pieces that overlap by all but one byte of a window.
        """
        row, rows = 0, len(offsets) - 1
        while row < rows:
            if offsets[row + 1] - offsets[row] > BLOCK:
                step = BLOCK - self.length + 1
                for low in range(int(offsets[row]), int(offsets[row + 1]) - self.length + 1, step):
                    piece = data[low : min(low + BLOCK, int(offsets[row + 1]))]
                    first, *others = self.anchors(piece, np.array([len(piece)]))
                    yield np.full(len(first), row), first + low - offsets[row], *others
                row += 1
                continue
            last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
            low = offsets[row]
            first, *others = self.anchors(data[low : offsets[last]], offsets[row + 1 : last + 1] - low)
            of = row + np.searchsorted(offsets[row + 1 : last + 1], first + low, side="right")
            yield of, first + low - offsets[of], *others
            row = last


class CoverSort:
    """Sorts suffixes of one string by their first ``length`` bytes or more, a bucket at a time."""

    def __init__(self, data: np.ndarray, length: int):
        self.length, self.size = length, len(data)
        padded = np.zeros(len(data) + 2 * length + 4 * PERIOD + 16, dtype=np.uint8)
        padded[: len(data)] = data
        words = np.zeros(len(padded) - 7, dtype=np.uint64)
        for i in range(8):
            words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.words = words  # the eight bytes from each place on, first byte highest
        self.delta = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
        self.code = np.full(PERIOD, -1)
        self.code[list(COVER)] = np.arange(len(COVER))
        self.ranks = self._sample_ranks()

    def _head(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.words[places], self.words[places + 8] >> np.uint64(24)

    def _sample_ranks(self) -> np.ndarray:
        periods = self.size // PERIOD + 2
        sample = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        first, second = self._head(sample)
        order = np.lexsort((second, first))
        new = np.concatenate([[False], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        ranks = np.empty(len(sample), dtype=np.int64)
        ranks[order] = np.cumsum(new)
        depth, step = PERIOD, len(COVER)
        while depth < self.length:
            later = np.zeros_like(ranks)
            later[:-step] = ranks[step:] + 1
            ranks = np.unique(ranks * (len(ranks) + 2) + later, return_inverse=True)[1]
            depth, step = depth * 2, step * 2
        return ranks

    def rank(self, places: np.ndarray) -> np.ndarray:
        return self.ranks[places // PERIOD * len(COVER) + self.code[places % PERIOD]]

    def buckets(self, suffixes: np.ndarray) -> Iterator[np.ndarray]:
        """The suffixes in order, a bucket of the first bytes' range at a time."""
        heads = self.words[suffixes]
        count = -(-len(suffixes) // BUCKET)
        cuts = np.unique(np.sort(heads[:: max(1, len(heads) // (64 * count))])[63::64]) if count > 1 else heads[:0]
        bucket = np.searchsorted(cuts, heads, side="right")
        for b in range(len(cuts) + 1):
            yield self._sorted(suffixes[bucket == b])

    def _sorted(self, members: np.ndarray) -> np.ndarray:
        first, second = self._head(members)
        order = np.lexsort((second, first))
        members, first, second = members[order], first[order], second[order]
        same = np.concatenate([[False], (first[1:] == first[:-1]) & (second[1:] == second[:-1])]) if len(members) else np.zeros(0, dtype=bool)
        tied = same | np.append(same[1:], False) if len(same) else same
        at = np.flatnonzero(tied)
        if len(at):
            members[at] = self._resolved(members[at], np.cumsum(~same[at]))
        return members

    def _resolved(self, members: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Members of tied groups (side by side) in order: each one's place is the number of those before it, by classes modulo PERIOD."""
        residue = members % PERIOD
        key = lambda of, d: group[of].astype(np.int64) << 32 | self.rank(members[of] + d)
        classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        before = np.zeros(len(members), dtype=np.int64)
        for b, those in enumerate(classes):
            if not len(those):
                continue
            sorted_keys: dict[int, np.ndarray] = {}
            for a, these in enumerate(classes):
                if len(these):
                    d = int(self.delta[a, b])
                    if d not in sorted_keys:
                        sorted_keys[d] = np.sort(key(those, d))
                    before[these] += np.searchsorted(sorted_keys[d], key(these, d))
        return members[np.argsort(before, kind="stable")]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``length`` bytes from the places are the same: the exact check of neighbours."""
        alike = np.ones(len(a), dtype=bool)
        for i in range(0, self.length, 8):
            shift = np.uint64(8 * max(0, 8 - (self.length - i)))
            alike &= self.words[a + i] >> shift == self.words[b + i] >> shift
        return alike


def repeated(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each window of each segment, whether the same bytes start at another place in the segments too."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes) - sizes
    sorter = CoverSort(np.frombuffer(b"".join(segments), dtype=np.uint8), length)
    suffixes = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts, sizes)])
    twice = np.zeros(sizes.sum() + 1, dtype=bool)
    for part in sorter.buckets(suffixes):  # equal windows have equal first bytes: they never part between buckets
        alike = sorter.equal(part[:-1], part[1:])
        twice[part[:-1][alike]] = True
        twice[part[1:][alike]] = True
    return [twice[s : s + n - length + 1] for s, n in zip(starts, sizes)]
