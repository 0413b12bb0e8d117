"""Skip-gram with hierarchical softmax on one part of the texts (numpy).

The method of Spark ML's Word2Vec: every word predicts the words around it along the path of a Huffman
tree.  The tree is built from runs of equally frequent words, of which N words have at most sqrt(2 N),
and kept as segments, so neither the driver nor a task holds the whole vocabulary: a task looks up the
paths of its own words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np

#: Of Spark ML's Word2Vec: words on either side, first learning rate, bound of the exponent.
WINDOW, RATE, MAX_EXP = 5, 0.025, 6.0
#: Positions whose gradients are added up before vectors move, and positions prepared at once.
BATCH, CHUNK = 64, 16384


def huffman(runs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree of ``runs`` ``(weight, number of leaves)``, weights ascending.  Leaves are numbered in
    that order, inner nodes after them as they are made; the last is the root.  Returned as segments
    ``(first, shift, parent)``: node ``j`` of a segment has ``at = j - first + shift``, the parent
    ``parent + at // 2`` and the code ``at % 2``."""
    leaves, inner, found = deque(), deque(), []
    made = 0
    for weight, n in runs:
        leaves.append([weight, n, made])
        made += n

    def head():
        return leaves if leaves and (not inner or leaves[0][0] <= inner[0][0]) else inner

    def add(weight, n):
        nonlocal made
        if inner and inner[-1][0] == weight and inner[-1][1] + inner[-1][2] == made:
            inner[-1][1] += n
        else:
            inner.append([weight, n, made])
        made += n

    while len(leaves) + len(inner) > 1 or head() and head()[0][1] > 1:
        queue = head()
        weight, n, first = queue[0]
        if n > 1:  # all that weigh the least are joined in pairs
            found.append((first, 0, made))
            queue[0][1:] = [n % 2, first + n // 2 * 2]
            if not n % 2:
                queue.popleft()
            add(2 * weight, n // 2)
        else:
            queue.popleft()
            other = head()[0]
            found += [(first, 0, made), (other[2], 1, made)]
            both = weight + other[0]
            other[1:] = [other[1] - 1, other[2] + 1]
            if not other[1]:
                head().popleft()
            add(both, 1)
    found.sort()
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0].copy(), out[:, 1].copy(), out[:, 2].copy()


def paths(leaves: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], root: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes above each leaf (-1 beyond the root) and its codes there, a row a leaf."""
    first, shift, parent = tree
    node, nodes, codes = leaves.astype(np.int64), [], []
    while (on := node != root).any() and len(first):
        k = np.searchsorted(first, node, "right") - 1
        at = node - first[k] + shift[k]
        node = np.where(on, parent[k] + at // 2, root)
        nodes.append(np.where(on, node, -1))
        codes.append(np.where(on, at % 2, 0).astype(np.int8))
    if not nodes:
        return np.empty((len(leaves), 0), np.int64), np.empty((len(leaves), 0), np.int8)
    return np.stack(nodes, 1), np.stack(codes, 1)


def first_vectors(leaves: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors before training: the same for a word in every part, evenly spread over +-0.5 / dim."""
    x = leaves.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) + 0.5) / 2**24 - 0.5) / dim


def _groups(index: np.ndarray, none: int, of: np.ndarray, first: np.ndarray, left: np.ndarray, width: np.ndarray
            ) -> tuple[np.ndarray, ...]:
    """Where gradients are to be added up, batch by batch.  ``of``: the batch of each row of ``index``; ``first``,
    ``left``, ``width``: first row of each batch, first column and number of columns it uses.  Entries sorted by
    (batch, index), starts of equal ones, their index, and where batches begin in both."""
    row, col = np.nonzero(index != none)
    in_batch = of[row]
    # sorted as one number: batch, index, place in the batch's gradients
    key = in_batch.astype(np.uint64) << np.uint64(48) | index[row, col].astype(np.uint64) << np.uint64(16)
    key |= ((row - first[in_batch]) * width[in_batch] + col - left[in_batch]).astype(np.uint64)
    key.sort()
    at, key = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    batches = np.arange(len(first) + 1).astype(np.uint64) << np.uint64(32)
    rows = np.searchsorted(key, batches)
    key = key[start]
    return at, start, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), rows, np.searchsorted(key, batches)


def _add(to: np.ndarray, grad: np.ndarray, groups: tuple[np.ndarray, ...], k: int) -> None:
    at, start, index, rows, ends = groups
    a, b = ends[k], ends[k + 1]
    if a < b:
        index, dim = index[a:b], to.shape[1]
        part = grad.reshape(-1, dim).take(at[rows[k]:rows[k + 1]], axis=0)
        # pairs of numbers are added as one complex number, and rows written as one item: same values, fewer steps
        part = np.add.reduceat(part.view(np.complex64), start[a:b] - rows[k], axis=0).view(np.float32)
        part += to.take(index, axis=0)
        to.view(f"V{4 * dim}")[:, 0][index] = part.view(f"V{4 * dim}")[:, 0]


def train(words: np.ndarray, ends: np.ndarray, leaves: np.ndarray, tree, root: int, dim: int, total: int,
          parts: int, part: int, seed: int, batch: int = BATCH, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the sentences of a part.  ``words``: positions in ``leaves`` of all words, one sentence after
    the other, which stop at ``ends``; ``total``: words of all parts.  Of each ``chunk`` of positions, those with one
    window and with short or long paths are taken together, in random order (not finer: a batch of one
    frequent word would move its vectors too far at once).  Returns the vectors of ``leaves`` and how often
    each was moved."""
    nodes, codes = paths(leaves, tree, root)
    known, local = np.unique(nodes, return_inverse=True)
    none, local = len(known), local.reshape(nodes.shape)
    if none and known[0] < 0:  # below the others: the places beyond the root go to the row after the last
        none -= 1
        local = np.where(local == 0, none, local - 1)
    local, length = local.astype(np.int32), (nodes >= 0).sum(1)
    del nodes, known
    v, n = len(leaves), len(words)
    even = dim + dim % 2  # a column of zeros stays zero
    syn0, syn1 = np.zeros((v + 1, even), np.float32), np.zeros((none + 1, even), np.float32)
    syn0[:v, :dim] = first_vectors(leaves, dim, seed)
    moved = np.zeros(v + 1, np.int64)
    rng = np.random.default_rng([seed & 0xFFFFFFFF, part])
    around = np.r_[-WINDOW:0, 1:WINDOW + 1]
    begins = np.r_[0, ends[:-1]]
    for lo in range(0, n if local.shape[1] else 0, chunk):
        rate = np.float32(max(RATE * (1 - parts * lo / (total + 1)), RATE * 0.0001))
        pos = np.arange(lo, min(lo + chunk, n))
        reach = WINDOW - rng.integers(0, WINDOW, len(pos))
        deep = length[words[pos]]
        kind = 2 * reach + (deep > np.median(deep))
        order = np.lexsort((rng.random(len(pos)), kind))
        pos, reach, kind = pos[order], reach[order], kind[order]
        centre, sentence = words[pos], np.searchsorted(ends, pos, "right")
        near = pos[:, None] + around
        seen = ((near >= begins[sentence][:, None]) & (near < ends[sentence][:, None])
                & (np.abs(around) <= reach[:, None]))
        near = np.where(seen, words[np.clip(near, 0, n - 1)], v)
        moved += np.bincount(near.ravel(), minlength=v + 1)
        path, wanted = local[centre], 1 - codes[centre].astype(np.float32)

        new = np.r_[True, kind[1:] != kind[:-1]]
        at = np.arange(len(pos))
        begin = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % batch == 0))
        of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(pos)]))
        wide, long = reach[begin], np.maximum.reduceat(length[centre], begin)
        by_word = _groups(near, v, of, begin, WINDOW - wide, 2 * wide)
        by_node = _groups(path, none, of, begin, np.zeros_like(long), long)
        for k in rng.permutation(len(begin)):
            i, j = begin[k], begin[k + 1] if k + 1 < len(begin) else len(pos)
            # places without a neighbour or a node hold zeros: they add nothing to the others' gradients
            x = syn0.take(near[i:j, WINDOW - wide[k]:WINDOW + wide[k]], axis=0)
            y = syn1.take(path[i:j, :long[k]], axis=0)
            f = x @ y.transpose(0, 2, 1)
            with np.errstate(over="ignore"):
                g = np.exp(-f)
            g += 1
            np.divide(-rate, g, out=g)
            g += (rate * wanted[i:j, :long[k]])[:, None, :]
            if (far := np.abs(f) >= MAX_EXP).any():
                g[far] = 0
            _add(syn0, g @ y, by_word, k)
            _add(syn1, g.transpose(0, 2, 1) @ x, by_node, k)
    return syn0[:v, :dim], moved[:v]
