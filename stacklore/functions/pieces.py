"""Short pieces of texts as numbers, many texts at a time from Arrow buffers.

A piece is one to LONGEST bytes in a row; its number holds the bytes and, above them, how many
they are. A text holds another only if it holds all the other's pieces: UTF-8 never matches
inside a letter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONGEST = 7
SLICE_BYTES = 4 << 20
FILTER_BITS = 25
_MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _spots(codes):
    """The two bits of each code in a filter."""
    return [(codes * np.uint64(m)) >> np.uint64(64 - FILTER_BITS) for m in _MIXERS]


def piece_filter(pieces: DataFrame):
    """(bits, sizes) of the column ``piece``: all its pieces and few others pass the bits.

    What the driver takes is one number per bit at most, however many pieces there are.
    """
    top = 1 << FILTER_BITS  # numbers from here on name sizes

    def mark(batches):
        for batch in batches:
            codes = batch.column("piece").to_numpy().view(np.uint64)
            marks = np.unique(np.concatenate([*_spots(codes), (codes >> np.uint64(56)) + np.uint64(top)]))
            yield pa.RecordBatch.from_arrays([pa.array(marks.astype(np.int32))], ["mark"])

    found = pieces.select("piece").mapInArrow(mark, "mark int").distinct().toArrow()
    found = found.column("mark").to_numpy()
    marks = np.zeros(top, bool)
    marks[found[found < top]] = True
    return np.packbits(marks, bitorder="little"), sorted(int(s) - top for s in found[found >= top])


def _passing(codes, bits):
    """Where the codes pass the filter."""
    at = np.arange(len(codes))
    for number in range(len(_MIXERS)):
        spot = _spots(codes[at])[number]
        at = at[(bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _slices(batch, text):
    """(rows, bytes, ends) of runs of rows with SLICE_BYTES of text, or a single longer one."""
    column = batch.column(text).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def _row_codes(data, ends, size, bits):
    """(row, code) of each piece of this size, or of those that pass the bits."""
    places = len(data) - size + 1
    if places <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(places, np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | data[k:k + places]
    code |= np.uint64(size << 56)
    at = np.arange(places) if bits is None else _passing(code, bits)
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + size <= ends[row + 1]
    return row[inside], code[at[inside]]


def _once(row, code):
    """Each pair of row and code once, in order."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def text_pieces(rows: DataFrame, keys, text, only=None, whole=False) -> DataFrame:
    """``keys`` and ``piece`` for the pieces of the column ``text``, each once a row.

    ``only`` (a ``piece_filter``) leaves its pieces and few others. With ``whole``, texts of
    LONGEST bytes or more have pieces of that size only and shorter ones are their own piece.
    """
    def cut(batches):
        bits, sizes = only or (None, range(1, LONGEST + 1))
        for batch in batches:
            for part, data, ends in _slices(batch, text):
                found = []
                for size in sizes:
                    row, code = _row_codes(data, ends, size, bits)
                    if whole and size < LONGEST:
                        own = np.diff(ends)[row] == size
                        row, code = row[own], code[own]
                    found.append(_once(row, code))
                if not found:
                    continue
                take = pa.array(np.concatenate([r for r, _ in found]))
                codes = np.concatenate([c for _, c in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(take) for k in keys] + [pa.array(codes)], [*keys, "piece"])

    kept = rows.select(*keys, text)
    schema = ", ".join(f"{k} {dict(kept.dtypes)[k]}" for k in keys)
    return kept.mapInArrow(cut, f"{schema}, piece long")
