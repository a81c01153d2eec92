"""Byte-pair encoding of many words at once, in numpy.

Words of one length are rows of a table.  In each step every word that still has
a pair of the vocabulary merges its first pair of least rank, as the library does
word by word; ranks of pairs are looked up in a hash table of all merges.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .tokens import Encoder, encoder, kept, ragged

#: No rank, and no token.
NONE = 65_535
#: Slots of the hash table, as a power of two; at most a fifth is taken by vocabularies of less than 2 ** 16 tokens.
SLOT_BITS = 19
#: Bytes of the longest word that is a row of a table; longer ones go to the library.
LONGEST = 64
_MULTIPLIER = np.uint32(2_654_435_769)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {b: chr(b) for b in own}
    for b in range(256):
        if b not in found:
            found[b] = chr(256 + len(found) - len(own))
    return [found[b] for b in range(256)]


class WordBPE:
    """Ids of words of letters, by the merges of a byte-level vocabulary with a suffix for the end of a word."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        characters = byte_characters()
        self.inner = np.array([vocab.get(c, NONE) for c in characters], np.uint16)
        self.last = np.array([vocab.get(c + suffix, NONE) for c in characters], np.uint16)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        self.keys = np.full(1 << SLOT_BITS, 0xFFFF_FFFF, np.uint32)
        self.ranks = np.full(1 << SLOT_BITS, NONE, np.uint16)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.ranks[slot[left]] == NONE]
            some = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[some]], self.ranks[slot[some]] = key[some], some
            left = np.setdiff1d(left, some, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)

    @staticmethod
    def able(tokenizer) -> bool:
        """Whether words are encoded by merges alone, as here."""
        model = json.loads(tokenizer.to_str())["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token"))
        small = max(len(model["vocab"]), len(model.get("merges", ())), max(model["vocab"].values(), default=0)) < NONE if isinstance(model.get("vocab"), dict) else False
        return model["type"] == "BPE" and plain and small and bool(model.get("end_of_word_suffix"))

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLIER) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where they don't merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right
        slot = self._slot(key)
        out = self.ranks.take(slot)
        miss = np.flatnonzero((self.keys.take(slot) != key) & (out != NONE))
        while len(miss):
            slot = (slot[miss] if len(slot) != len(miss) else slot) + 1 & ((1 << SLOT_BITS) - 1)
            found, same = self.ranks.take(slot), self.keys.take(slot) == key[miss]
            out[miss] = np.where(same, found, NONE)
            go_on = ~same & (found != NONE)
            miss, slot = miss[go_on], slot[go_on]
        return out

    def _rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and each word's number of them, of words of one length as rows of bytes."""
        n, size = raw.shape
        width = size + 2  # a place that no token has on both sides
        tokens = np.full((n, width), NONE, np.uint16)
        tokens[:, 1:-2] = self.inner[raw[:, :-1]]
        tokens[:, -2] = self.last[raw[:, -1]]
        ranks = np.full((n, width), NONE, np.uint16)
        ranks[:, 1:-2] = self.rank(tokens[:, 1:-2].reshape(-1), tokens[:, 2:-1].reshape(-1)).reshape(n, -1)
        after = np.empty((n, width), np.int32)
        after[:] = np.arange(1, width + 1)
        before = np.empty((n, width), np.int32)
        before[:] = np.arange(-1, width - 1)
        tokens, flat, after, before = (x.reshape(-1) for x in (tokens, ranks, after, before))
        rows, current = np.arange(n), ranks
        while len(rows):
            at = current.argmin(1)
            base = rows * width
            here = base + at
            rank = flat.take(here)
            some = np.flatnonzero(rank != NONE)
            if len(some) < len(rows):
                rows, base, here, rank = rows[some], base[some], here[some], rank[some]
                if not len(rows):
                    break
            gone = base + after.take(here)
            then, ago = after.take(gone), before.take(here)
            next_at, last_at = base + then, base + ago
            token = self.product.take(rank)
            tokens[here] = token
            tokens[gone] = NONE
            flat[gone] = NONE
            after[here] = then
            before[next_at] = here - base
            flat[here] = self.rank(token, tokens.take(next_at))
            flat[last_at] = self.rank(tokens.take(last_at), token)
            current = ranks if len(rows) == n else ranks.take(rows, 0)
        kept = tokens != NONE
        return tokens[kept], kept.reshape(n, width).sum(1)

    def encode(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, at_once: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in small letters, end to end, and each word's number of them, of words as places of a buffer."""
        order = np.argsort(size, kind="stable")
        counts, flats = np.zeros(len(size), np.int64), []
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            for a in range(0, len(part), at_once):
                some = part[a : a + at_once]
                ids, counts[some] = self._rows(raw[starts[some][:, None] + np.arange(size[some[0]])])
                flats.append(ids)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint16)
        first = np.empty(len(size), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(first, counts)].astype(np.uint32), counts


class WordEncoder:
    """Ids of distinct words without blanks, each encoded for itself: words of letters, with or without a stop, all at once, others by the codec."""

    def __init__(self, codec: Encoder):
        self.codec = codec
        self.table = WordBPE(codec.tokenizer) if WordBPE.able(codec.tokenizer) else None
        self.stops = {m: codec.encode_units([m])[0] for m in (b".", b",")}

    def encode(self, column: pa.Array, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and each word's number of them, of a binary column of words with so many bytes after each."""
        if self.table is None or not len(column):
            return self.codec.encode_units([w[: len(w) - tail] for w in column.to_pylist()])
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2].to_pybytes().lower(), np.uint8).copy()
        starts, ends = offsets[:-1], offsets[1:] - tail
        size = ends - starts
        letter = (raw >= 97) & (raw <= 122)
        high = np.flatnonzero(raw[:-1] == 0xC3)  # letters of Latin-1
        high = high[(raw[high + 1] >= 0x80) & (raw[high + 1] <= 0xBF) & (raw[high + 1] != 0x97) & (raw[high + 1] != 0xB7)]
        letter[high] = letter[high + 1] = True
        capital = high[raw[high + 1] < 0x9F] + 1
        raw[capital] += 0x20
        run = np.concatenate([[0], np.cumsum(~letter)])
        others = run[ends] - run[starts]
        last = np.where(size > 0, raw[np.maximum(ends - 1, 0)], 0)
        stop = np.where((others == 1) & (size > 1) & ((last == 44) | (last == 46)), last, 0)
        plain = ((others == 0) | (stop > 0)) & (size > 0) & (size <= LONGEST)
        stop[~plain] = 0
        by_letters, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, counts = self.table.encode(raw, starts[by_letters], size[by_letters] - (stop[by_letters] > 0))
        more, more_counts = self.codec.encode_units([w[: len(w) - tail] for w in column.take(pa.array(rest)).to_pylist()])
        lengths = np.empty(len(column), np.int64)
        lengths[by_letters], lengths[rest] = counts, more_counts
        whole = lengths + (stop > 0)
        first = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), np.uint32)
        out[ragged(first[by_letters], counts)] = ids
        out[ragged(first[rest], more_counts)] = more
        for mark, own in self.stops.items():
            at = np.flatnonzero(stop == mark[0])
            out[first[at] + lengths[at]] = own[0]
        return out, whole


def word_encoder(vocabulary: str, memo_units: int) -> WordEncoder:
    """The process-wide encoder of words by a vocabulary file."""
    codec, key = encoder(vocabulary, memo_units), ("words", vocabulary, memo_units)
    loaded = kept("encoder")
    if key not in loaded:
        loaded[key] = WordEncoder(codec)
    return loaded[key]
