"""Simple-8b: word-aligned coding of integers, several to a 64-bit word.

The low 4 bits of a word select how many values its other 60 bits hold and how wide they are. Selector 0 is
the escape: its value, of 60 bits or more, stands whole in a word of its own behind the packed words of the
block. Blocks of BLOCK values start at word offsets that the caller stores, so any block decodes alone and
many decode at once. Encoding takes, at each place, the selector that holds most values.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values in a word by selector, and their bits; selector 0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
MOST = int(COUNT.max())


#: The narrowest width for a number of bits; 64, which no selector has, for more than 60.
FIT = np.array([0, *(int(WIDTH[1:][WIDTH[1:] >= b].min()) if b <= 60 else 64 for b in range(1, 66))], np.uint8)


#: The same by value, for values below 2^16.
SMALL = FIT[np.frexp(np.arange(1 << 16, dtype=np.float64))[1]]


def bit_width(x: np.ndarray) -> np.ndarray:
    """The narrowest width that holds each value. Values of more than 53 bits may get the next one, as they pass
    through floating point, which rounds up at most."""
    if x.size and x.max() < len(SMALL):
        return SMALL[x]
    return FIT[np.frexp(x.astype(np.float64))[1]]


def _selectors(width: np.ndarray) -> np.ndarray:
    """At each place of each row the selector that holds most of the values from there on."""
    most = {1: width}

    def window(n: int) -> np.ndarray:
        if n not in most:
            half = 1 << ((n - 1).bit_length() - 1)
            a, b = window(half), window(n - half)
            high = a.copy()
            np.maximum(a[:, :-half], b[:, half:], out=high[:, :-half])
            most[n] = high
        return most[n]

    best = np.zeros(width.shape, np.uint8)
    dense = (window(8)[:, : BLOCK - 8] <= WIDTH[7]).any()  # else none of more than 8 values fits, but for a block's end
    for s in range(len(COUNT) - 1, 0, -1):
        if dense or COUNT[s] <= 8:
            np.copyto(best, s, where=window(int(COUNT[s])) <= WIDTH[s])
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and per block the number of its words; the last block may be short. Values are unsigned."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.zeros((blocks, BLOCK + MOST), values.dtype)
    flat = np.zeros(blocks * BLOCK, values.dtype)
    flat[:n] = values
    x[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = _selectors(bit_width(x)).ravel()
    taken = COUNT.astype(np.int32)[best]
    first = np.zeros(len(best), bool)
    width = BLOCK + MOST
    end = np.arange(blocks) * width + BLOCK
    end[-1] -= blocks * BLOCK - n
    at = np.arange(blocks) * width
    while len(at):
        first[at] = True
        at = at + taken[at]
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    start = np.flatnonzero(first)
    row = start // width
    sel = best[start]
    word = sel.astype(np.uint64)
    flat = x.ravel()
    for s in range(1, len(COUNT)):
        of = np.flatnonzero(sel == s)
        if len(of):
            from_, whole = start[of], np.zeros(len(of), np.uint64)
            for k in range(COUNT[s]):
                whole |= flat[from_ + k].astype(np.uint64) << np.uint64(4 + WIDTH[s] * k)
            word[of] |= whole
    escaped = np.flatnonzero(sel == 0)
    words_of = np.bincount(row, minlength=blocks)
    if len(escaped):
        extra = np.bincount(row[escaped], minlength=blocks)
        owner = np.concatenate([row, row[escaped]])
        order = np.argsort(owner, kind="stable")
        word, words_of = np.concatenate([word, flat[start[escaped]].astype(np.uint64)])[order], words_of + extra
    return word, words_of


def decode(words: np.ndarray, words_of: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive whole blocks; all but the last have BLOCK values."""
    blocks = len(words_of)
    if not blocks:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(blocks), words_of)
    sel = np.minimum((words & np.uint64(15)).astype(np.int64), len(COUNT) - 1)  # whole words of escaped values have any bits
    count = COUNT[sel]
    first = np.concatenate([[0], np.cumsum(words_of)])[:-1]
    before = np.cumsum(count) - count
    col = before - before[first][owner]
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    packed = col < size[owner]  # behind these stand the escaped values
    out = np.zeros((blocks, BLOCK + MOST), np.uint64)
    flat, start = out.ravel(), owner * out.shape[1] + col
    for s in range(1, len(COUNT)):
        of = np.flatnonzero(packed & (sel == s))
        if len(of):
            shift = (4 + WIDTH[s] * np.arange(COUNT[s])).astype(np.uint64)
            flat[start[of][:, None] + np.arange(COUNT[s])] = (words[of][:, None] >> shift) & np.uint64((1 << int(WIDTH[s])) - 1)
    escaped = np.flatnonzero(packed & (sel == 0))
    if len(escaped):
        flat[start[escaped]] = words[~packed]
    return out[:, :BLOCK].ravel()[:n]
