"""Simple-8b: ids packed into 64-bit words, and the segment file built on it.

The top four bits of a word are its selector, which says how many values of how
many bits the other sixty hold.  Selector 0 stands for a run of zeros; selector
1 is the escape, for one value of more than sixty bits, kept in a side list.
Values are coded in blocks of 1,024; a table of word offsets lets any block, or
all of them at once, be decoded without reading the words before it.

A segment codes ids by their rank of frequency in the segment, as ranks need
far fewer bits than ids; the rank table is part of the segment.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the coding: values in a word, and bits of each, by selector.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ZEROS, ESCAPE, SINGLE = 0, 1, 15
BLOCK = 1024
_PAD = 240


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _choices(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Selector of the fullest word that may start at each position; rows are blocks, padded with zeros."""
    width = BLOCK

    def wider(a: np.ndarray, n: int, b: np.ndarray) -> np.ndarray:
        """Greatest of a's window and b's window that starts n later."""
        out = a.copy()
        np.maximum(a[:, : a.shape[1] - n], b[:, n : n + a.shape[1] - n], out=out[:, : a.shape[1] - n])
        return out

    chosen = np.where(bits[:, :width] > 60, ESCAPE, SINGLE).astype(np.uint8)
    window, size = bits, 1
    for selector in range(SINGLE - 1, ESCAPE, -1):
        n = int(COUNTS[selector])
        while size < n:
            step = min(size, n - size)
            window, size = wider(window, step, window), size + step
        np.putmask(chosen, window[:, :width] <= BITS[selector], selector)
    while size < COUNTS[ZEROS]:
        step = min(size, int(COUNTS[ZEROS]) - size)
        window, size = wider(window, step, window), size + step
    np.putmask(chosen, window[:, :width] == 0, ZEROS)
    return chosen


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and one past the last, escaped values)."""
    n = len(values)
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK + _PAD), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(rows, BLOCK)
    used = np.minimum(BLOCK, n - BLOCK * np.arange(rows))
    chosen = _choices(grid, _bit_lengths(grid))
    lane, at = np.arange(rows), np.zeros(rows, np.int64)
    lanes, starts, selectors = [], [], []
    while len(lane):
        s = chosen[lane, at]
        lanes.append(lane)
        starts.append(at)
        selectors.append(s)
        at = at + COUNTS[s]
        open_ = at < used[lane]
        lane, at = lane[open_], at[open_]
    if not lanes:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    lane, at, selector = np.concatenate(lanes), np.concatenate(starts), np.concatenate(selectors)
    order = np.argsort(lane, kind="stable")
    lane, at, selector = lane[order], at[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    cells, where = grid.reshape(-1), lane * (BLOCK + _PAD) + at
    for s in range(ESCAPE + 1, SINGLE + 1):
        own = np.flatnonzero(selector == s)
        for j in range(int(COUNTS[s])):
            words[own] |= cells[where[own] + j] << np.uint64(j * BITS[s])
    own = np.flatnonzero(selector == ESCAPE)
    escaped = cells[where[own]]
    words[own] |= np.arange(len(own), dtype=np.uint64)
    return words, np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=rows))]).astype(np.uint32), escaped


def decode(words: np.ndarray, block_words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n values of :func:`encode`, all blocks at once."""
    rows = len(block_words) - 1
    out = np.zeros(rows * BLOCK, np.uint64)
    if not n:
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    run = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    first = block_words[:-1].astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(block_words.astype(np.int64)))
    at = run - run[first][row] + row * BLOCK
    limit = (row + 1) * BLOCK
    for s in range(ESCAPE + 1, SINGLE + 1):
        own = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            if j:  # the last word of a block may be part empty
                own = own[at[own] + j < limit[own]]
            out[at[own] + j] = words[own] >> np.uint64(j * BITS[s]) & mask
    own = np.flatnonzero(selector == ESCAPE)
    out[at[own]] = escaped[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


MAGIC = b"QLS8"
_HEAD = struct.Struct("<4sIQQQQQQ")  # magic, version, documents, ids, ranks, blocks, words, escaped values
RANKED_BELOW = 1 << 24


def pack_segment(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: documents' ids, whether they are known, their counts, and all ids in order."""
    ids = ids.astype(np.uint64)
    table = np.zeros(0, np.uint64)
    codes = ids
    if len(ids) and int(ids.max()) < RANKED_BELOW:
        often = np.bincount(ids.astype(np.int64))
        order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        rank = np.zeros(len(often), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        codes, table = rank[ids.astype(np.int64)], order.astype(np.uint64)
    words, blocks, escaped = encode(codes)
    head = _HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(table), len(blocks), len(words), len(escaped))
    parts = (doc_ids.astype("<i8"), known.astype(np.uint8), counts.astype("<u8"), table.astype("<u4"), blocks.astype("<u4"), words.astype("<u8"), escaped.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def unpack_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`pack_segment` was given."""
    magic, _, docs, n, ranks, blocks, words, escaped = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at, out = _HEAD.size, []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", ranks), ("<u4", blocks), ("<u8", words), ("<u8", escaped)):
        part = np.frombuffer(raw, kind, size, at)
        out.append(part)
        at += part.nbytes
    doc_ids, known, counts, table, offsets, coded, side = out
    codes = decode(coded, offsets, side, n)
    ids = table.astype(np.uint64)[codes.astype(np.int64)] if len(table) else codes
    return doc_ids.astype(np.int64), known.astype(bool), counts.astype(np.int64), ids
