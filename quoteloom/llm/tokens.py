"""Memoised whole-text encoding with the ``tokenizers`` library.

A pre-tokeniser never joins text across the start of a run of blanks, nor across
a full stop or comma that follows a letter and precedes a blank.  A text whose
only white space is spaces and newlines is therefore the concatenation of
*units* cut there, and its ids are the concatenation of the units' ids.  Units
are cut and counted column-wise (numpy byte classes, Arrow dictionaries); each
worker process keeps a bounded memo from unit to ids, and only unseen units
reach the library.  Texts with any other white space or control character, and
texts that hold the string of an added token such as ``<|endoftext|>``, are
encoded whole by the library, whose own treatment of such strings stands.
"""

from __future__ import annotations

import ctypes
import os
import platform
import re
import sys
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Between unseen units of one library call; no merge of either vocabulary holds it.
_MARK = "\x01"
#: Between texts of one buffer.
_END = 2
_ODD = re.compile("[\\x00-\\x08\\x0b-\\x1f\\x7f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028-\\u202f\\u205f-\\u2060\\u3000\\ufeff]")
#: UTF-8 of what _ODD holds outside ASCII, or its first bytes.
_ODD_BYTES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf"]

# byte classes
_OTHER, _BLANK, _LETTER, _STOP, _BAD, _HIGH = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[:32] = _BAD
    table[127] = _BAD
    table[[10, 32, _END]] = _BLANK
    for a, z in ((65, 90), (97, 122)):
        table[a : z + 1] = _LETTER
    table[[44, 46]] = _STOP
    table[128:192] = _HIGH
    return table


_CLASS = _classes()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and platform.libc_ver()[0] == "glibc" else None

_kept: dict[str, dict] = {}


def give_back_memory() -> None:
    """Return freed memory to the machine: workers live as long as their executor, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def kept(owner: str) -> dict:
    """What a worker keeps of this operator from task to task; what another one left is let go.

    Workers outlive their stage, so that the tables of all stages would add up in each.
    """
    if owner not in _kept:
        _kept.clear()
        give_back_memory()
        _kept[owner] = {}
    return _kept[owner]


def keep_memory(array: int = 4_000_000, free: int = 32_000_000) -> None:
    """Let arrays up to so many bytes reuse what earlier ones left, as mapping each anew costs more than small steps take."""
    if _libc is not None:
        _libc.mallopt(-3, array)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, free)  # M_TRIM_THRESHOLD


def vocabulary_path(name: str) -> str:
    """Where the named public vocabulary file lies; an absolute path is kept."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Starts of units in a buffer of texts that each end in ``_END``."""
    cls = _CLASS[raw]
    blank = cls == _BLANK
    before = np.empty_like(blank)  # of the byte before
    before[0], before[1:] = True, blank[:-1]
    after = np.empty_like(blank)
    after[-1], after[:-1] = True, blank[1:]
    cut = blank & ~before
    lone = (raw == 10) & ~before & ~after
    cut[1:] |= lone[:-1]  # a lone newline is a unit of its own
    stop = np.flatnonzero((cls == _STOP) & after)
    stop = stop[stop >= 2]
    one, two = raw[stop - 1], raw[stop - 2]
    letter = (cls[stop - 1] == _LETTER) | ((cls[stop - 1] == _HIGH) & (two == 0xC3) & (one != 0x97) & (one != 0xB7))
    cut[stop[letter]] = True
    ends = np.flatnonzero(raw == _END)
    cut[ends] = True
    cut[ends[:-1] + 1] = True
    cut[0] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of whole texts; null encodes as the empty text.

    ``memo_units`` bounds the memo; on reaching it the memo is emptied, which
    costs time only.  ``batch_bytes`` bounds the text held as units at a time.
    """

    def __init__(self, vocabulary: str, memo_units: int = 500_000, batch_bytes: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # in any case of letters, as a normaliser may run before the strings are looked for
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        start = os.path.commonprefix(added) if added else b""
        self.added_start = start if start == start.swapcase() else b""  # looked for before the pattern, which is slower
        self.memo_units, self.batch_bytes = memo_units, batch_bytes
        self.keeps_blanks = self._library([" a"])[0] != self._library(["a"])[0]
        self.join = _MARK if self.keeps_blanks else f" {_MARK} "
        self.mark = self._library([f"a{self.join}a"])[0][1]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.alone = re.compile(rb"'|.*[ \n]\Z", re.DOTALL).match
        self.plain = re.compile((b" " if self.keeps_blanks else b" ?") + rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
        self.stopped = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]")
        self.marks = np.zeros(self.vocab_size, bool)  # of ids that open (with a blank) or close a word
        for token, i in self.tokenizer.get_vocab().items():
            self.marks[i] = token.startswith("\u0120") if self.keeps_blanks else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.lengths = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.uint32)
        self.stored = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes], plain: bool = False, alone: bool = False) -> None:
        """Encode units and add them to the memo in order.

        Plain units, words of letters alone, are one pre-token each: in one text
        the vocabulary's own word marks tell them apart.  Between others goes a
        separator.  Blanks that end a text and words that begin with an
        apostrophe are encoded alone, as their neighbours change how they are cut.
        """
        for at in range(0, len(units), 65_536):
            some = units[at : at + 65_536]
            groups = [some[i : i + 512] for i in range(0, len(some), 512)]
            flats, counts = [], []
            tail = self.join.encode()
            glue = b"" if self.keeps_blanks else b" "
            joined = [[]] * len(groups) if alone else self._library([(glue.join(g) if plain else tail.join(g) + tail).decode() for g in groups])
            for group, ids in zip(groups, joined):
                flat = np.array(ids, np.uint32)
                marks = np.flatnonzero(self.marks[flat] if plain else flat == self.mark)
                if len(marks) == len(group) and plain:
                    edges = np.append(marks, len(flat)) if self.keeps_blanks else np.concatenate([[0], marks + 1])
                    counts.append(np.diff(edges))
                    flats.append(flat)
                elif len(marks) == len(group):
                    counts.append(np.diff(marks, prepend=-1) - 1)
                    flats.append(np.delete(flat, marks))
                else:
                    own = self._library([u.decode() for u in group])
                    counts.append(np.array([len(x) for x in own]))
                    flats.append(np.array([i for x in own for i in x], np.uint32))
            flat, count = np.concatenate(flats), np.concatenate(counts)
            n, known = len(some), len(self.memo)
            if known + n > len(self.lengths):
                more = max(n, len(self.lengths))
                self.lengths = np.concatenate([self.lengths, np.zeros(more, np.int32)])
                self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
            if self.stored + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(max(len(flat), len(self.store)), np.uint32)])
            self.lengths[known : known + n] = count
            self.starts[known : known + n] = self.stored + np.cumsum(count) - count
            self.store[self.stored : self.stored + len(flat)] = flat
            self.stored += len(flat)
            self.memo.update(zip(some, range(known, known + n)))

    def _slots(self, units: list[bytes], end: bytes | None = None) -> np.ndarray:
        """Places of distinct units in the memo, learnt where they are new; -1 for ``end``."""
        if len(self.memo) + len(units) > self.memo_units and self.memo:
            self._forget()
        slots = np.fromiter(map(self.memo.get, units, repeat(-1)), np.int64, len(units))
        is_plain = self.plain.fullmatch
        plain, other, alone = [], [], []
        for i in np.flatnonzero(slots < 0).tolist():
            if is_plain(units[i]):
                plain.append(i)
            elif units[i] != end:
                (alone if self.alone(units[i]) else other).append(i)
        for new in (plain, other, alone):
            slots[new] = np.arange(len(self.memo), len(self.memo) + len(new))
            self._learn([units[i] for i in new], new is plain, new is alone)
        return slots

    def _encode_buffer(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and count by text, of texts without odd characters."""
        end = bytes([_END])
        data = end.join(texts) + end
        if not self.keeps_blanks:
            data = data.translate(_LOWER)
        raw = np.frombuffer(data, np.uint8)
        starts = _cuts(raw)
        offsets = np.empty(len(starts) + 1, np.int32)
        offsets[:-1], offsets[-1] = starts, len(raw)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy(zero_copy_only=False)
        slots = self._slots(distinct, end)
        lengths = np.where(slots < 0, 0, self.lengths[slots])[which].astype(np.int64)
        ids = self.store[ragged(self.starts[slots][which], lengths)]
        run = np.cumsum(lengths)
        at = run[np.flatnonzero(slots[which] < 0)]
        return ids, np.diff(at, prepend=0)

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without blanks, each encoded for itself, end to end, and each one's count.

        A stop or comma after letters is a pre-token of its own, so the word
        before it is looked up alone.
        """
        is_stopped = self.stopped.fullmatch
        stop = np.fromiter((u[-1] if is_stopped(u) else 0 for u in units), np.uint8, len(units))
        place: dict[bytes, int] = {}
        base = np.fromiter((place.setdefault(u[:-1] if s else u, len(place)) for u, s in zip(units, stop.tolist())), np.int64, len(units))
        slots = self._slots(list(place))[base]
        extra = (stop > 0).astype(np.int64)
        lengths = self.lengths[slots].astype(np.int64)
        whole = lengths + extra
        out = np.empty(int(whole.sum()), np.uint32)
        first = np.cumsum(whole) - whole
        out[ragged(first, lengths)] = self.store[ragged(self.starts[slots], lengths)]
        for byte in np.unique(stop[stop > 0]).tolist():
            (mark,) = self._library([chr(byte)])[0]
            own = stop == byte
            out[first[own] + lengths[own]] = mark
        return out, whole

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and each row's count of them."""
        rows = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        ids, counts = [], np.zeros(len(rows), np.int64)
        at = 0
        while at < len(rows):
            size, to = len(rows[at]), at + 1
            while to < len(rows) and size + len(rows[to]) <= self.batch_bytes:
                size += len(rows[to])
                to += 1
            part = rows[at:to]
            odd = [i for i, t in enumerate(part) if self._is_odd(t) or self._has_added(t)]
            whole_only = set(odd)
            clean = [b"" if i in whole_only else t for i, t in enumerate(part)] if odd else part
            flat, count = self._encode_buffer(clean)
            if odd:
                whole = {i: np.array(x, np.uint32) for i, x in zip(odd, self._library([part[i].decode() for i in odd]))}
                ends = np.cumsum(count)
                pieces = [whole.get(i, flat[e - c : e]) for i, (c, e) in enumerate(zip(count.tolist(), ends.tolist()))]
                flat, count = np.concatenate(pieces).astype(np.uint32), np.array([len(p) for p in pieces])
            ids.append(flat)
            counts[at:to] = count
            at = to
        give_back_memory()
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), counts

    def _has_added(self, text: bytes) -> bool:
        return self.added is not None and self.added_start in text and self.added(text) is not None

    @staticmethod
    def _is_odd(text: bytes) -> bool:
        if text.isascii():
            return bool(_ODD_ASCII.search(text))
        return bool(_ODD_ASCII.search(text)) or (any(b in text for b in _ODD_BYTES) and bool(_ODD.search(text.decode())))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []


_ODD_ASCII = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]")


def encoder(vocabulary: str, memo_units: int = 500_000, batch_bytes: int = 4_000_000) -> Encoder:
    """The process-wide encoder of a vocabulary file."""
    loaded, key = kept("encoder"), (vocabulary, memo_units, batch_bytes)
    if key not in loaded:
        loaded[key] = Encoder(*key)
    return loaded[key]


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
