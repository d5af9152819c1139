"""Run-length grammars by recompression, and how far two places of a sequence agree.

Rounds alternate. A block round replaces every maximal run of one symbol by a symbol for (symbol, length). A pair
round deals the symbols into left and right ones by a hash and replaces every left symbol followed by a right one by
a symbol for the pair. Equal contents get equal names, whatever stands around them, but for their rims. The rounds
end when a sequence is about as short as there are texts in it; lengths shrink by a constant factor a round on average.

Two equal stretches are thus cut alike but for a few symbols a level at their ends. To see how far two places agree, both
climb: on each level they step over equal symbols until both are at the start of a symbol of the next one. Where they
differ they come down again, over what is still equal. That is a number of steps in the order of the levels, and exact: a step is
taken over equal names only, equal names stand for equal stretches, and on the last level a name is a word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MIX = 0x9E3779B97F4A7C15
MOST_LEVELS = 200


class Level(NamedTuple):
    """Symbols of a level; how many words each stands for; the place of each in the next level, and where that level's symbols begin here."""

    names: np.ndarray
    sizes: np.ndarray
    up: np.ndarray
    begins: np.ndarray
    blocks: bool


def coin(names: np.ndarray, seed: int) -> np.ndarray:
    """Whether a symbol is a left one in round seed."""
    mixed = (names.astype(np.uint64) + np.uint64((seed + 1) * MIX % 2**64)) * np.uint64(MIX)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX) >> np.uint64(40)).astype(np.int64) & 1 == 0


class Grammar:
    """The levels over a sequence of numbers, which begins and ends with numbers that occur once, as do those between its texts."""

    def __init__(self, words: np.ndarray, texts: int = 1) -> None:
        self.levels: list[Level] = []
        names = np.unique(words, return_inverse=True)[1].astype(np.int64)
        sizes = np.ones(len(names), np.int64)
        seed = 0
        while len(names) > 2 * texts + 2 and len(self.levels) < MOST_LEVELS:
            alike = names[1:] == names[:-1]
            blocks = bool(alike.any())
            begin = np.ones(len(names), bool)
            if blocks:
                begin[1:] = ~alike
                begins = np.append(np.flatnonzero(begin), len(names))
                contents = (names[begins[:-1]] << 32) | np.diff(begins)
            else:
                left = coin(names, seed)
                seed += 1
                begin[1:] = ~(left[:-1] & ~left[1:])
                begins = np.append(np.flatnonzero(begin), len(names))
                two = np.diff(begins) == 2
                contents = (names[begins[:-1]] + 1) << 32
                contents[two] |= names[begins[:-1][two] + 1] + 1
            self.levels.append(Level(names, sizes, np.cumsum(begin) - 1, begins, blocks))
            sizes = np.add.reduceat(sizes, begins[:-1])
            names = np.unique(contents, return_inverse=True)[1].astype(np.int64)
        self.levels.append(Level(names, sizes, np.zeros(0, np.int64), np.zeros(0, np.int64), False))

    def agree(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many words from places i and j on (step 1) or back (step -1), these included, are equal; i and j differ and no text lies between them that is not theirs."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        length = np.zeros(len(a), np.int64)
        reached = np.full(len(a), len(self.levels) - 1)  # the level on which each was found to differ
        climbing = np.arange(len(a))
        for t, level in enumerate(self.levels[:-1]):
            self._over_equal(level, a, b, length, climbing, step, stop=True)
            even = self._at_edge(level, a[climbing], step) & self._at_edge(level, b[climbing], step)
            reached[climbing[~even]] = t
            climbing = climbing[even]
            a[climbing], b[climbing] = level.up[a[climbing]], level.up[b[climbing]]
            if not len(climbing):
                break
        for t in range(len(self.levels) - 1, -1, -1):
            level, here = self.levels[t], np.flatnonzero(reached >= t)
            if not len(here):
                continue
            if t < len(self.levels) - 1:
                down = here[reached[here] > t]
                if step > 0:
                    a[down], b[down] = level.begins[a[down]], level.begins[b[down]]
                else:
                    a[down], b[down] = level.begins[a[down] + 1] - 1, level.begins[b[down] + 1] - 1
            self._over_equal(level, a, b, length, here, step, stop=False)
        return length

    @staticmethod
    def _at_edge(level: Level, x: np.ndarray, step: int) -> np.ndarray:
        """Whether x is where, seen in the direction of step, a symbol of the next level begins."""
        return level.begins[level.up[x]] == x if step > 0 else level.begins[level.up[x] + 1] == x + 1

    def _over_equal(self, level: Level, a: np.ndarray, b: np.ndarray, length: np.ndarray, which: np.ndarray, step: int, stop: bool) -> None:
        """Moves those of a and b over equal symbols; with stop, only until both are at an edge of the next level."""
        while len(which):
            x, y = a[which], b[which]
            on = level.names[x] == level.names[y]
            if stop:
                on &= ~(self._at_edge(level, x, step) & self._at_edge(level, y, step))
            which, x, y = which[on], x[on], y[on]
            if level.blocks:  # over what is left of the shorter block at once
                rest = lambda z: level.begins[level.up[z] + 1] - z if step > 0 else z - level.begins[level.up[z]] + 1
                n = np.minimum(rest(x), rest(y))
            else:
                n = np.ones(len(which), np.int64)
            length[which] += n * level.sizes[x]
            a[which], b[which] = x + step * n, y + step * n
