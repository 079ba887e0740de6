"""Simple-8b word-aligned coding, vectorised over blocks.

A 64-bit word holds a 4-bit selector in its top bits and up to 60 payload bits: as
many values of one width as fit. Selector 0 is the escape: the next word is one raw
64-bit value (for values of more than 60 bits). Blocks of ``BLOCK`` values are coded
on their own, and ``offsets`` give each block's first word, so that blocks can be
decoded alone and all blocks at once.
"""

from __future__ import annotations

import numpy as np

# Counts and widths by selector 1..14; count * width <= 60.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

BLOCK = 1024


_BITS16 = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    out = _BITS16[(v & np.uint64(0xFFFF)).astype(np.uint16)]
    for k in (16, 32, 48):
        high = v >> np.uint64(k)
        big = np.flatnonzero(high)
        if not len(big):
            break
        out[big] = _BITS16[(high[big] & np.uint64(0xFFFF)).astype(np.uint16)] + k
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, first word of each block uint32); the last block may be short."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    end_of_block = np.minimum((np.arange(n) // block + 1) * block, n)
    room = (end_of_block - np.arange(n)).astype(np.int32)
    # top[i]: bits of the widest of the next ``have`` values, widened run by run. A longer
    # run has a narrower width, so what fits one selector fits all with shorter runs: the
    # choice is 14 less the number of further selectors that fit.
    top, have = _bits(v), 1
    choice = np.where(top <= int(WIDTHS[14]), np.uint8(14), np.uint8(0))
    for s in range(13, 0, -1):
        want = int(COUNTS[s])
        while have < want:
            step = min(have, want - have)
            np.maximum(top[: n - step], top[step:], out=top[: n - step])
            have += step
        fits = (top <= int(WIDTHS[s])) & (room >= want)
        if not fits.any():
            break
        choice -= fits.view(np.uint8)
    step_of = np.where(choice == 0, 1, COUNTS[choice])
    # all blocks walk at once from their first value
    n_blocks = -(-n // block)
    at = np.arange(n_blocks) * block
    stop = np.minimum(at + block, n)
    live = np.arange(n_blocks)
    starts, owner = [], []
    while len(live):
        here = at[live]
        starts.append(here)
        owner.append(live)
        at[live] = here + step_of[here]
        live = live[at[live] < stop[live]]
    start = np.sort(np.concatenate(starts))  # blocks are disjoint ranges
    sel = choice[start]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        which = np.flatnonzero(sel == s)
        if len(which):
            word = words[place[which]]
            for j in range(int(COUNTS[s])):
                word |= v[start[which] + j] << np.uint64(j * int(WIDTHS[s]))
            words[place[which]] = word
    raw = np.flatnonzero(sel == 0)
    words[place[raw] + 1] = v[start[raw]]
    first = np.searchsorted(start, np.arange(n_blocks) * block)
    return words, place[first].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values that :func:`encode` coded."""
    w = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(w), bool)
    if (sel == 0).any():  # the word after an escape is no head, whatever its top bits say
        for k in np.flatnonzero(sel == 0):
            if head[k]:
                head[k + 1] = False
    at = np.flatnonzero(head)
    s = sel[at]
    count = np.where(s == 0, 1, COUNTS[s])
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for k in range(1, 15):
        which = np.flatnonzero(s == k)
        if len(which):
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            word = w[at[which]]
            for j in range(int(COUNTS[k])):
                out[start[which] + j] = (word >> np.uint64(j * int(WIDTHS[k]))) & mask
    raw = np.flatnonzero(s == 0)
    out[start[raw]] = w[at[raw] + 1]
    if len(out) != n:
        raise ValueError(f"{len(out)} values decoded, {n} expected")
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, k: int, block: int = BLOCK) -> np.ndarray:
    """One block's values, by its offset."""
    lo = int(offsets[k])
    hi = int(offsets[k + 1]) if k + 1 < len(offsets) else len(words)
    return decode(words[lo:hi], np.zeros(1, np.uint32), min(block, n - k * block), block)
