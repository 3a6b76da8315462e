"""Numpy helpers that hash the words of many texts at once, straight from Arrow buffers."""

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
PIECE_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Classes of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 signs.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[SPACES] = 0
CLASSES[48:58] = CLASSES[65:91] = CLASSES[97:123] = 1
CLASSES[128:] = 1


def mix(x):
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def pieces(texts, limit=PIECE_BYTES):
    """Yield (first row, last row + 1, bytes, starts) of an Arrow string array.

    Runs of rows hold at most ``limit`` bytes, or a single text that is longer.
    Null texts have no bytes.
    """
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def word_hashes(data, starts, lower=False, runs=False):
    """(hash of each word, its row) for the texts of one piece.

    ``lower`` folds A-Z. ``runs`` cuts words further where letters meet signs.
    """
    if lower:
        data = LOWER[data]
    kind = CLASSES[data] if runs else (~SPACES[data]).astype(np.uint8)
    filled = kind > 0
    begins = filled.copy()
    if data.size:
        begins[1:] &= kind[1:] != kind[:-1]
        edges = starts[1:-1]
        edges = edges[edges < data.size]
        begins[edges] = filled[edges]
    at = np.flatnonzero(begins)
    if not at.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.searchsorted(starts, at, "right") - 1
    step = np.arange(data.size) - np.repeat(at, np.diff(np.append(at, data.size))) \
        if at[0] == 0 else np.concatenate([
            np.zeros(at[0], np.int64),
            np.arange(at[0], data.size) - np.repeat(at, np.diff(np.append(at, data.size)))])
    powers = np.cumprod(np.full(int(step.max()) + 1, _BASE))
    value = _BYTES[data] * powers[step]
    value[~filled] = 0
    return mix(np.add.reduceat(value, at)), rows


def joined(hashes, rows, n):
    """(hash of each window of n words, its row); windows stay inside a row."""
    if hashes.size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = rows[n - 1:] == rows[:hashes.size - n + 1]
    out = np.zeros(hashes.size - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + hashes[k:hashes.size - n + 1 + k] + _GOLD)
    return out[whole], rows[:hashes.size - n + 1][whole]
