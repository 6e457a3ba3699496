"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A 64-bit word holds a 4-bit selector (top) and as many equally wide values as fit below it, the first lowest. Values are
coded in blocks of at most ``BLOCK``; each block begins a new word and its place is kept, so blocks decode independently.
A value of more than 60 bits is an escape: selector 0, then the value itself in the next word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (values in a word, bits of each) of selectors 1 to 15; selector 0 is the escape.
SELECTORS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 1024
_PAD = SELECTORS[0][0]
_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_COUNT = np.array([1] + [c for c, _ in SELECTORS], dtype=np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value: 0 for 0, 64 at most."""
    if not len(values) or int(values.max()) < 1 << 16:
        return _SHORT[values]
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, words before each block) of each array of values; an empty array has no block.

    All blocks are coded side by side: sliding maxima of the widths tell the fullest selector at every position, then one
    step a word follows each block's chain of words.
    """
    blocks, owner = [], []
    for k, part in enumerate(parts):
        part = np.asarray(part, dtype=np.uint64)
        for at in range(0, len(part), BLOCK):
            blocks.append(part[at : at + BLOCK])
            owner.append(k)
    words: list[list[np.ndarray]] = [[] for _ in parts]
    for at in range(0, len(blocks), 256):
        for k, w in zip(owner[at : at + 256], _encode_blocks(blocks[at : at + 256]), strict=True):
            words[k].append(w)
    out = []
    for ws in words:
        starts = np.cumsum([0] + [len(w) for w in ws])[:-1].astype(np.uint32) if ws else np.zeros(0, np.uint32)
        out.append((np.concatenate(ws) if ws else np.zeros(0, np.uint64), starts))
    return out


def _encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    n = np.array([len(b) for b in blocks])
    most = int(n.max())
    vals = np.zeros((len(blocks), most + _PAD), dtype=np.uint64)
    for k, b in enumerate(blocks):
        vals[k, : len(b)] = b
    top = {1: _widths(vals.ravel()).reshape(vals.shape)}
    for k in (1, 2, 4, 8, 16, 32):
        a = top[k]
        top[2 * k] = np.maximum(a[:, :-k], a[:, k:])
    best = np.zeros((len(blocks), most), dtype=np.uint8)  # the selector at each position; 0: escape
    for s in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[s - 1]
        k = 1 << (count.bit_length() - 1)
        wide = top[k][:, :most] if k == count else np.maximum(top[k][:, :most], top[k][:, count - k : count - k + most])
        best[wide <= bits] = s
    lane, pos = np.arange(len(blocks)), np.zeros(len(blocks), dtype=np.int64)
    lanes, starts, sels = [], [], []
    while len(lane):
        s = best[lane, pos[lane]]
        lanes.append(lane)
        starts.append(pos[lane])
        sels.append(s)
        pos[lane] += _COUNT[s]
        lane = lane[pos[lane] < n[lane]]
    step = np.repeat(np.arange(len(lanes)), [len(x) for x in lanes])
    lane, start, sel = np.concatenate(lanes), np.concatenate(starts), np.concatenate(sels)
    order = np.lexsort((step, lane))
    lane, start, sel = lane[order], start[order], sel[order]
    word = np.zeros(len(sel), dtype=np.uint64)
    place, flat = lane * vals.shape[1] + start, vals.ravel()
    for s in np.unique(sel):
        at = np.flatnonzero(sel == s)
        if s == 0:
            continue
        count, bits = SELECTORS[s - 1]
        w = np.full(len(at), s, dtype=np.uint64) << np.uint64(60)
        if bits:
            own = place[at]
            for j in range(count):
                w |= flat[own + j] << np.uint64(j * bits)
        word[at] = w
    escapes = np.flatnonzero(sel == 0)
    if len(escapes):
        word = np.insert(word, escapes + 1, vals[lane[escapes], start[escapes]])
        lane = np.insert(lane, escapes + 1, lane[escapes])
    return np.split(word, np.cumsum(np.bincount(lane, minlength=len(blocks)))[:-1])


def block_sizes(n: int) -> np.ndarray:
    """Values in each block of an array of ``n``."""
    return np.diff(np.append(np.arange(0, n, BLOCK), n)) if n else np.zeros(0, np.int64)


def decode(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all blocks in ``words``: ``starts`` has the words before each block, ``sizes`` its values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for at in np.flatnonzero(sel == 0).tolist():
        if not raw[at]:
            raw[at + 1] = True
    count = np.where(raw, 0, _COUNT[sel])
    off = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(off[-1]), dtype=np.uint64)
    for s in np.unique(sel[~raw]):
        at = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[off[at]] = words[at + 1]
            continue
        width, bits = SELECTORS[s - 1]
        if not bits:
            continue
        w, mask = words[at] & np.uint64((1 << 60) - 1), np.uint64((1 << bits) - 1)
        for j in range(width):
            out[off[at] + j] = (w >> np.uint64(j * bits)) & mask
    begins = off[np.asarray(starts, dtype=np.int64)]
    sizes = np.asarray(sizes, dtype=np.int64)
    spare = np.append(begins[1:], off[-1]) - begins - sizes  # the last word of a block may run on
    if not spare.any():
        return out
    keep = np.ones(len(out), dtype=bool)
    for b, k in zip((begins + sizes)[spare > 0].tolist(), spare[spare > 0].tolist(), strict=True):
        keep[b : b + k] = False
    return out[keep]
