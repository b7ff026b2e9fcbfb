"""Texts as units, plain words and the signs behind them, held in arrays.

For tokenizers that drop white space, put letters in lower case and split letters from signs. Python sees
each distinct unit of a window once; their occurrences stay in numpy and Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text whose units are held at once: at most this, and a quarter of what the table of units may hold if that is
#: less, but never under ``LEAST_WINDOW``. A chunk without white space is never cut.
WINDOW_BYTES = 2 << 20
LEAST_WINDOW = 64 << 10
#: Characters of new units that are encoded at once.
FILL_CHARS = 64 << 10
#: Signs that may stand behind a plain word.
SIGNS = b",.!?;:*$%&#|"

#: White space that ends a chunk.
GAPS = b" \n\t"

_GAP, _LETTER, _SIGN, _OTHER = range(4)
#: What a byte is. Bytes behind 0xC3, the first byte of À to ÿ, are looked at on their own.
_KIND = bytes(_GAP if b in GAPS else _SIGN if b in SIGNS else _LETTER if b == 0xC3 or bytes([b]).isalpha() else _OTHER for b in range(256))

_BEGINS, _ODD, _CUT = 1, 2, 4
#: What a byte means, by 4 * its kind + the kind of the byte before: its chunk begins, its chunk is not plain, a sign ends the word.
_MEANING = bytearray(256)
for _k in (_LETTER, _SIGN, _OTHER):
    _MEANING[4 * _k + _GAP] |= _BEGINS
for _k in (*range(4 * _OTHER, 4 * _OTHER + 4), 4 * _LETTER + _SIGN, 4 * _SIGN + _GAP):
    _MEANING[_k] |= _ODD
_MEANING[4 * _SIGN + _LETTER] |= _CUT


def split_units(data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The units of UTF-8 bytes, and for each of ``starts`` (where texts start in them) how many units come before.

    Chunks lie between spaces, line ends and tabs. One of letters A-Z, a-z, À to ÿ and then ``SIGNS`` gives two
    units, the letters in lower case and the signs, if any; every other chunk is a unit as it stands.
    """
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(starts), np.int64)
    raw = bytearray(data)
    kind, plain = np.frombuffer(raw.translate(_KIND), np.uint8), np.frombuffer(raw.lower(), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        letter = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
        kind[lead + 1] = np.where(letter, _LETTER, _OTHER)
        plain[lead + 1] = np.where(letter & (second < 0x9F), second | 0x20, second)
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[0] = before[starts[starts < len(data)]] = _GAP
    meaning = np.frombuffer((kind << 2 | before).tobytes().translate(_MEANING), np.uint8)
    begins = (meaning & _BEGINS).view(bool)
    cuts, odd = np.flatnonzero((meaning & _CUT) != 0), np.flatnonzero((meaning & _ODD) != 0)
    if len(odd):
        chunks = np.flatnonzero(begins)
        odd_chunk = np.zeros(len(chunks), bool)
        odd_chunk[np.searchsorted(chunks, odd, "right") - 1] = True
        cuts = cuts[~odd_chunk[np.searchsorted(chunks, cuts, "right") - 1]]
        np.copyto(plain[chunks[0] :], data[chunks[0] :], where=np.repeat(odd_chunk, np.diff(chunks, append=len(data))))
    begins[cuts] = True
    counted = np.searchsorted(np.flatnonzero(begins), starts)
    kept = kind != _GAP
    flat = plain[kept]
    ends = np.append(np.flatnonzero(begins[kept]), len(flat)).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(flat)), counted


def windows(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end before white space."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            gaps = np.flatnonzero(np.isin(data[at + 1 : end], list(GAPS)))
            if len(gaps):
                end = at + 1 + int(gaps[-1])
            else:
                while end < len(data) and data[end] not in GAPS:
                    end += 1
        yield at, min(end, len(data))
        at = end


class UnitTable:
    """Ids of the units met so far, one behind the other; emptied where their keys outgrow ``table_bytes``."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], table_bytes: int):
        self.encode, self.table_bytes = encode, table_bytes
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.held = 0
        self.ids = np.empty(0, "<u4")
        self.ends = np.zeros(1, np.int64)  # slot k has ids[ends[k] : ends[k + 1]]

    def fill(self, units: list[str]) -> np.ndarray:
        """The slots of distinct units; those not known are encoded in batches of bounded size."""
        slots = np.fromiter(map(self.slots.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(slots < 0)
        missing = [units[i] for i in new.tolist()]
        size = sum(map(len, missing))
        if self.held + size > self.table_bytes and self.slots:
            self.clear()
            new, missing, size = np.arange(len(units)), units, sum(map(len, units))
        slots[new] = np.arange(len(self.slots), len(self.slots) + len(new))
        self.slots.update(zip(missing, slots[new].tolist(), strict=True))
        self.held += size
        found: list[bytes] = []
        start, chars = 0, 0
        for i, unit in enumerate(missing):
            chars += len(unit)
            if chars >= FILL_CHARS or i + 1 == len(missing):
                found += self.encode(missing[start : i + 1])
                start, chars = i + 1, 0
        if found:
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + sizes.cumsum()])
        return slots

    def window(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 bytes, and for each of ``starts`` how many come before."""
        units, counted = split_units(data, starts)
        coded = units.dictionary_encode()
        slots = self.fill(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        begin = self.ends[slots]
        sizes = self.ends[slots + 1] - begin
        before = np.concatenate([[0], sizes.cumsum()])
        return self.ids[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1])], before[counted]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and the places where texts begin and the last one ends. A null text has none."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, held = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        places = np.empty(len(bounds), np.int64)
        found, total = [np.empty(0, "<u4")], 0
        for a, b in windows(data, min(WINDOW_BYTES, max(LEAST_WINDOW, self.table_bytes // 4))):
            lo, hi = np.searchsorted(bounds, [a, b])
            ids, before = self.window(data[a:b], bounds[lo:hi] - a)
            places[lo:hi] = total + before
            found.append(ids)
            total += len(ids)
        places[np.searchsorted(bounds, len(data)) :] = total
        return np.concatenate(found), places
