"""Context-tree weighting over binary-decomposed bytes (Willems et al. 1995), as array functions.

A symbol is a byte of the text, or END after its last one; it is coded as 8 binary choices, and each choice has its own
context tree over the DEPTH bytes before (0 where the text has not begun). A *gram* is the whole number
of context and symbol, the symbol in its lowest byte. A node is a context of some depth and the bits of the symbol that
are known; it has a count of zeros and of ones, and its weighted probability is the mean of its
Krichevsky-Trofimov probability and the product of its children's.
"""

from __future__ import annotations

import numpy as np

from . import arrays as A

DEPTH, END = 5, 255
LOG2 = float(np.log(2))


def grams(block: A.Block, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every symbol of every row, and where each row's begin."""
    size = np.diff(block.off) + 1
    first = np.zeros(block.n + 1, np.int64)
    np.cumsum(size, out=first[1:])
    symbol = np.full(first[-1], END, np.uint8)
    body = np.ones(first[-1], bool)
    body[first[1:] - 1] = False
    symbol[body] = block.data
    at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    out = symbol.astype(np.int64)
    for k in range(1, depth + 1):
        before = np.zeros(len(symbol), np.int64)
        before[k:] = symbol[:-k]
        before[at < k] = 0
        out |= before << 8 * k
    return out, first


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y
    for k in range(8):
        out -= np.log(x + k)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any one sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - float(np.log(np.pi))


def bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[grams, 8]: number of the node within its symbol's binary tree, and the bit that is coded there."""
    symbol = (gram & 255)[:, None]
    j = np.arange(8)
    return (1 << j) | symbol >> (8 - j), symbol >> (7 - j) & 1


class Level:
    """Nodes of one depth: sorted keys, counts, log of weighted probability, weight of stopping there."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        self.log = kt if below is None else np.logaddexp(kt, below) - LOG2
        self.stop = np.ones(len(key)) if below is None else np.exp(np.minimum(0, kt - LOG2 - self.log))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(key.shape, np.int64), np.zeros(key.shape, bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def gathered(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the columns."""
    uniq, back = np.unique(key, return_inverse=True)
    return uniq, *(np.bincount(back, c, len(uniq)) for c in columns)


def node_key(gram: np.ndarray, depth: int, node: np.ndarray) -> np.ndarray:
    return ((gram >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8 | node


def grow(gram: np.ndarray, count: np.ndarray, top: int, depth: int = DEPTH) -> list[Level]:
    """Levels top..depth of the trees of the grams (those with count 0 are left out)."""
    gram, count = gram[count > 0], count[count > 0]
    node, bit = bits(gram)
    many = np.repeat(count, 8)
    one = bit.ravel() == 1
    levels: list[Level] = []
    for d in range(depth, top - 1, -1):
        key, zeros, ones = gathered(node_key(gram, d, node).ravel(), many * ~one, many * one)
        below = None
        if levels:
            child = levels[-1]
            parent = ((child.key >> 8) & ((1 << 8 * d) - 1)) << 8 | child.key & 255
            at = np.searchsorted(key, parent)
            below = np.bincount(at, child.log, len(key))
        levels.append(Level(key, zeros, ones, below))
    return levels[::-1]


def lengths(gram: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Code length in bits of each gram's symbol; levels: depths 0, 1, ... of the trees.

    A context that was never seen has no subtree to weight, so its parent's estimate stands.
    """
    node, bit = bits(gram)
    p, below = np.full(node.shape, 0.5), np.zeros(node.shape, bool)
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        at, seen = level.find(node_key(gram, d, node))
        if len(level.key):
            hit = np.where(bit == 1, level.ones[at], level.zeros[at]) + 0.5
            kt = np.where(seen, hit / (level.zeros[at] + level.ones[at] + 1.0), 0.5)
            stop = np.where(below, level.stop[at], 1.0)
            p = np.where(seen, stop * kt + (1 - stop) * p, 0.5)
        below = seen
    return -np.log2(p).sum(axis=1)
